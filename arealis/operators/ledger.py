"""Provenance ledger, source registry and table sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import presets as P
from ..functions.numeric import round_half_even
from .order import keep_last

LEDGER = T.StructType([
    *[T.StructField(c, T.StringType()) for c in (
        "run_id", "layer", "source_key", "title", "publisher", "mirror", "access", "license", "url",
        "local_path", "sha256")],
    T.StructField("bytes", T.LongType()), T.StructField("status", T.StringType()),
    T.StructField("message", T.StringType()), T.StructField("extracted_at", T.TimestampType())])
STATUSES = ("ok", "manual", "skipped", "failed")


def flatten_registry(spark: SparkSession, layers: dict[str, dict[str, dict]]) -> DataFrame:
    """Source registry (layer -> key -> metadata) as rows."""
    rows = [(layer, key, *[_text(meta.get(c)) for c in P.REGISTRY_COLUMNS[2:-1]], _first_url(meta))
            for layer, sources in layers.items() for key, meta in (sources or {}).items()]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in P.REGISTRY_COLUMNS))


def _text(v) -> str | None:
    return None if v is None else str(v)


def _first_url(meta: dict) -> str | None:
    return next((str(meta[k]) for k in P.URL_KEYS if meta.get(k)), None)


def ledger_rows(spark: SparkSession, records: list[dict]) -> DataFrame:
    """Records as ledger rows; absent fields are missing and an unknown status is refused."""
    bad = [r.get("status") for r in records if r.get("status") not in STATUSES]
    if bad:
        raise ValueError(f"unknown status {bad[0]!r}")
    return spark.createDataFrame([tuple(r.get(f.name) for f in LEDGER.fields) for r in records], LEDGER)


def as_ledger(df: DataFrame) -> DataFrame:
    """Any table with some ledger columns, brought to the ledger's schema."""
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in LEDGER.fields])


def append(df: DataFrame, path: str) -> None:
    as_ledger(df).write.mode("append").parquet(path)


SIDECAR = ("source_key string, layer string, title string, publisher string, access string, license string, "
           "pdf_path string, url string, sha256 string, message string, extracted_at string, bytes bigint, "
           "pages bigint, verification_anchors bigint, csv_outputs array<string>, anchors_missing array<string>")


def read_sidecars(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Sidecar files with their path; files that are no JSON give no row."""
    return (spark.read.schema(SIDECAR).option("multiLine", True).json(paths)
            .withColumn("path", F.col("_metadata.file_path")).where(F.col("source_key").isNotNull()))


def sidecar_rows(sidecars: DataFrame, run_id: str = "local") -> DataFrame:
    """One current ledger row per source key; of several sidecars the last path wins.

    A checksum makes the status ok, its absence manual.
    """
    n_csv = F.coalesce(F.size("csv_outputs"), F.lit(0))
    anchors = F.coalesce("verification_anchors", F.lit(0))
    verified = anchors - F.coalesce(F.size("anchors_missing"), F.lit(0))
    composed = F.concat(F.lit("local extract: "), F.coalesce(F.col("pages").cast("string"), F.lit("?")),
                        F.lit(" pages, "), n_csv.cast("string"), F.lit(" CSV tables, anchors "),
                        verified.cast("string"), F.lit("/"), anchors.cast("string"), F.lit(" verified"))
    given = F.nullif(F.col("message"), F.lit(""))
    rows = keep_last(sidecars, ["source_key"], [F.col("path")])
    return as_ledger(rows.select(
        F.lit(run_id).alias("run_id"), F.coalesce("layer", F.lit("core")).alias("layer"), "source_key",
        F.coalesce("title", "source_key").alias("title"), F.coalesce("publisher", F.lit("")).alias("publisher"),
        F.coalesce("access", F.lit("local")).alias("access"), "license",
        F.coalesce(F.nullif(F.col("pdf_path"), F.lit("")), F.col("url")).alias("url"),
        F.col("pdf_path").alias("local_path"), "sha256", "bytes",
        F.when(F.coalesce("sha256", F.lit("")) != "", "ok").otherwise("manual").alias("status"),
        F.coalesce(given, composed).alias("message"),
        F.try_to_timestamp("extracted_at").alias("extracted_at")))


def upsert(ledger: DataFrame, current: DataFrame, key: str = "source_key") -> DataFrame:
    """The ledger with all rows of the given keys replaced by the current ones."""
    return ledger.join(current.select(key).distinct(), key, "left_anti").select(*ledger.columns).unionByName(
        current.select(*ledger.columns))


def status_counts(ledger: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return ledger.groupBy(*by, "status").agg(F.count(F.lit(1)).alias("n"))


def keys_with_status(ledger: DataFrame, status: str) -> DataFrame:
    return ledger.where(F.col("status") == status).select("source_key").distinct().orderBy("source_key")


def gate_sources(registry: DataFrame, allowed: tuple[str, ...], only_open: bool = True) -> DataFrame:
    """Registry with a status: sources that are not openly accessible are skipped."""
    skip = F.lit(only_open) & ~F.coalesce(F.col("access").isin(*allowed), F.lit(False))
    return registry.withColumns({
        "status": F.when(skip, "skipped").otherwise("selected"),
        "message": F.when(skip, F.concat(F.lit("only_open: access="), F.coalesce("access", F.lit(""))))})


def rounded(df: DataFrame, digits: int | dict[str, int], half_even: bool = True) -> DataFrame:
    """Floating-point columns rounded for publication."""
    def how(c: str, d: int) -> Column:
        return round_half_even(c, d) if half_even else F.round(c, d)

    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    plan = {c: digits for c in floats} if isinstance(digits, int) else {
        c: d for c, d in digits.items() if c in floats}
    return df.withColumns({c: how(c, d) for c, d in plan.items()}) if plan else df


def publish(df: DataFrame, path: str, fmt: str = "parquet", digits: int | dict[str, int] | None = None,
            partition_by: list[str] = ()) -> None:
    """Replace a published table. A CSV carries its header."""
    out = df if digits is None else rounded(df, digits)
    writer = out.write.mode("overwrite").partitionBy(*partition_by) if partition_by else out.write.mode("overwrite")
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def manifest(ledger: DataFrame, path: str) -> None:
    """Ledger as JSON lines."""
    ledger.write.mode("overwrite").json(path)


def seed_or_override(spark: SparkSession, override_folder: str | None, seed: DataFrame) -> DataFrame:
    """The CSVs of the override folder when there are any, else the seed table."""
    from ..sources.files import folder_table

    found = folder_table(spark, [override_folder], tag="file") if override_folder else None
    return seed if found is None else found
