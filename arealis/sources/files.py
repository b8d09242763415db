"""File scans, schema repair and the drop folder."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import presets as P
from ..functions.text import slug, tight_key
from ..operators.keys import area_frame, attach_area, key_columns, match_alias, match_column


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
               infer: bool = False) -> DataFrame:
    """CSV with a header or parquet, by extension.

    A schema is preferred: inferring one reads a CSV twice.
    """
    if path.lower().rstrip("/").endswith(".parquet"):
        return spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", infer).csv(path)


def list_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """``(path, length)`` of the files under a folder; contents are not read."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True)
            .option("pathGlobFilter", glob).load(root).select("path", "length"))


def indicator_rows(df: DataFrame, column: str, carry: list[str] = ()) -> DataFrame:
    """Tidy rows of ``[meta, [observations]]`` texts; unreadable texts and empty values go."""
    obs = ("array<struct<indicator:struct<id:string,value:string>,country:struct<id:string,value:string>,"
           "date:string,value:double>>")
    second = F.get(F.from_json(column, "array<string>"), F.lit(1))
    rows = df.select(*carry, F.explode(F.from_json(second, obs)).alias("o")).where(F.col("o.value").isNotNull())
    return rows.select(*carry, F.col("o.indicator.id").alias("indicator"),
                       F.col("o.indicator.value").alias("indicator_name"),
                       F.col("o.country.id").alias("country"),
                       F.col("o.date").try_cast("int").alias("year"), F.col("o.value").alias("value"))


def indicator_panel(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Observations of all files, one whole file a text, ordered by indicator and year."""
    return indicator_rows(spark.read.text(paths, wholetext=True), "value").orderBy(
        F.col("indicator").asc_nulls_last(), F.col("year").asc_nulls_last())


def union_domains(tables: dict[str, DataFrame], area_code: int, code_aliases=P.AREA_CODE_ALIASES,
                  tag: str = "domain") -> DataFrame | None:
    """One area's rows of several tables with differing columns, tagged with the table's name.

    Tables without an area-code column are skipped; columns that a table lacks are null.
    """
    parts = []
    for name, df in sorted(tables.items()):
        code = match_column(df.columns, [re.escape(a) for a in code_aliases], lambda c: c.strip().lower())
        if code is not None:
            mine = df.where(F.col(f"`{code}`").try_cast("double") == area_code)
            parts.append(mine.select(*[F.col(f"`{c}`").alias("area_code" if c == code else c) for c in df.columns],
                                     F.lit(name).alias(tag)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None


def route_layers(sources: DataFrame, registry: DataFrame, default: str = "core") -> DataFrame:
    """``(source, layer)`` of folder names by a registry ``(key, layer)``.

    Compared on letters and digits only: the registry key that begins the name, or begins with it, and shares most
    letters wins; then the first key by name.
    """
    left = sources.select("source").distinct().withColumn("__s", tight_key("source"))
    right = registry.select("key", "layer", tight_key("key").alias("__k")).where("__k <> ''")
    # names that begin alike share their first letter, which makes this an equi-join
    near = (F.left("__s", F.lit(1)) == F.left("__k", F.lit(1))) & (
        F.startswith("__s", F.col("__k")) | F.startswith("__k", F.col("__s")))
    order = F.struct(-F.least(F.length("__s"), F.length("__k")), F.abs(F.length("__s") - F.length("__k")), "key")
    return (left.join(right, near, "left").groupBy("source").agg(F.min_by("layer", order).alias("layer"))
            .select("source", F.coalesce("layer", F.lit(default)).alias("layer")))


def table_name(source: str, path: str) -> str:
    stem = path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]
    return f"{source}__{re.sub('[^0-9a-zA-Z]+', '_', stem).strip('_').lower()}"


def file_groups(spark: SparkSession, root: str) -> list[tuple[DataFrame, list[tuple[str, str]]]]:
    """CSVs under a folder, one scan for all that have the same header: (rows, [(path, file)]).

    Rows have the file's columns as texts, ``__file`` and ``__at`` (the order of its records). Headers of all files are
    read in one pass; files without a line are left out. Records must not run over line ends.
    """
    files = {r["file_path"]: r["path"] for r in spark.read.format("binaryFile").option("recursiveFileLookup", True)
             .option("pathGlobFilter", "*.csv").load(root).select("path", "_metadata.file_path").collect()}
    if not files:
        return []
    lines = spark.read.text(sorted(files.values())).where(F.col("_metadata.file_block_start") == 0)
    first = lines.select("_metadata.file_path", "value", F.monotonically_increasing_id().alias("at")).groupBy("file_path").agg(
        F.min_by("value", "at").alias("header"))
    by_header: dict[str, list[str]] = {}
    for r in first.orderBy("file_path").collect():
        by_header.setdefault(r["header"], []).append(r["file_path"])
    groups = []
    for of in by_header.values():
        reader = spark.read.option("header", True)
        schema = reader.csv(files[of[0]]).schema
        rows = reader.schema(schema).csv([files[f] for f in of])
        groups.append((rows.withColumns({
            "__file": F.col("_metadata.file_path"),
            "__at": F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())}), [(files[f], f) for f in of]))
    return groups


def strip_tag_rows(df: DataFrame) -> DataFrame:
    """Drop the first record of every file of a group when more than half of its cells are ``#`` tags."""
    cells = [c for c in df.columns if c not in ("__file", "__at")]
    tags = _tags(df, cells)
    first = df.groupBy("__file").agg(F.min("__at").alias("__first"))  # a row per file
    return df.join(first, "__file").where(~((tags > len(cells) / 2.0) & (F.col("__at") == F.col("__first")))).drop("__first")


def ingest_folder(spark: SparkSession, root: str, out: str, layer_of: dict[str, str],
                  crosswalk: DataFrame | None = None, skip: tuple[str, ...] = ()) -> list[tuple[str, str, str]]:
    """Write every CSV under ``root/<source>/`` as ``out/layer=<layer>/table=<source>__<stem>``.

    Area code and name are added where a key column is found. Files with the same header are scanned and written
    together, so there are a few jobs per header, however many files; the driver holds the list of files and each one's
    key column. Of files that give the same table the last by path stands. Gives (layer, table, path).
    """
    base = root.rstrip("/").rsplit("/", 1)[-1]
    inside = F.regexp_extract("path", rf"{re.escape(base)}/(.+)$", 1)
    files = list_files(spark, root, "*.csv").select("path", F.substring_index(inside, "/", 1).alias("source")).where(
        F.contains(inside, F.lit("/")) & ~F.col("source").isin("", *skip))
    registry = spark.createDataFrame(list(layer_of.items()), "key string, layer string")
    tables = {(r["layer"], table_name(r["source"], r["path"])): r["path"]
              for r in files.join(route_layers(files, registry), "source").orderBy("path").collect()}
    target_of = {path: place for place, path in tables.items()}
    keys = None if crosswalk is None else area_frame(crosswalk, spark)
    written = []
    for rows, members in file_groups(spark, root):
        wanted = [(f, *target_of[p]) for p, f in members if p in target_of]
        if not wanted:
            continue
        places = spark.createDataFrame(wanted, "__file string, layer string, table string")
        rows = strip_tag_rows(rows.join(places.select("__file"), "__file", "left_semi"))
        columns = [c for c in rows.columns if c not in ("__file", "__at")]
        key_of = {} if keys is None else {r["__file"]: r["column"] for r in key_columns(rows, keys, columns).collect()}
        for column in sorted({key_of.get(f) for f, _, _ in wanted}, key=lambda c: (c is not None, c)):
            mine = [w for w in wanted if key_of.get(w[0]) == column]
            part = rows.join(spark.createDataFrame(mine, places.schema).withColumnsRenamed(
                {"layer": "__layer", "table": "__table"}), "__file")
            if column is not None:
                part = attach_area(part, crosswalk, column)
            # a file's own columns of these names would hide the folders
            own = {c: f"{c}_" for c in part.columns if c.lower() in ("layer", "table")}
            part = part.drop("__file", "__at").withColumnsRenamed(own).withColumnsRenamed({"__layer": "layer", "__table": "table"})
            (part.repartition("layer", "table").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("layer", "table").parquet(out))
            written += [(layer, table, f"{out.rstrip('/')}/layer={layer}/table={table}") for _, layer, table in mine]
    return sorted(written)


def folder_table(spark: SparkSession, roots: list[str], tag: str = "file") -> DataFrame | None:
    """All CSVs of the first folder that has any, tagged with their names; columns a file lacks are null.

    Name a single file in ``roots`` to read only that.
    """
    for root in roots:
        try:
            groups = file_groups(spark, root)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        parts = [rows.withColumn(tag, F.url_decode(F.replace(F.substring_index("__file", "/", -1), F.lit("+"), F.lit("%2B"))))
                 .drop("__file", "__at") for rows, _ in groups]
        if parts:
            return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return None


def _tags(df: DataFrame, cells: list[str]):
    return reduce(lambda a, b: a + b, [
        F.coalesce(F.startswith(F.trim(F.col(f"`{c}`").cast("string")), F.lit("#")).cast("int"), F.lit(0)) for c in cells])


def strip_tag_row(df: DataFrame, order: str) -> DataFrame:
    """Drop the first record, by ``order``, when more than half of its cells are ``#`` tags."""
    cells = [c for c in df.columns if c != order]
    tags = _tags(df, cells)
    first = df.agg(F.min(order).alias("m")).scalar()
    return df.where(~((tags > len(cells) / 2.0) & (F.col(order) == first)))


def raster_columns(df: DataFrame, stem: str = "stem") -> DataFrame:
    """Add ``column``: the known name of a nutrient raster's file, else the slug of its stem marked as this source's."""
    names = df.sparkSession.createDataFrame(list(P.RASTER_NAMES.items()), "__slug string, __name string")
    marked = F.when(F.endswith("__slug", F.lit("isda")), F.col("__slug")).otherwise(F.concat("__slug", F.lit("_isda")))
    return (df.withColumn("__slug", slug(F.regexp_replace(F.lower(stem), "^isda_", ""))).join(names, "__slug", "left")
            .withColumn("column", F.coalesce("__name", marked)).drop("__slug", "__name"))


def point_columns(columns: list[str]) -> tuple[str | None, str | None, dict[str, str]]:
    """Latitude, longitude and the nutrient columns of a point table."""
    lat, lon = match_alias(columns, P.LAT_ALIASES), match_alias(columns, P.LON_ALIASES)
    found = {n: match_alias(columns, a, suffix=False) for n, a in P.NUTRIENT_ALIASES.items()}
    return lat, lon, {n: c for n, c in found.items() if c}
