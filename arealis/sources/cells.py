"""Printed tables given as cells: (doc_id, page, table_no, row_no, col_no, text).

A table is named by (doc_id, page, table_no). Windows run over header cells or inside pages;
what has to be carried across pages goes through ``fill_forward``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import presets as P
from ..functions.parse import composition_cell, millions, number_cell
from ..functions.text import name_key
from ..operators.keys import key_table
from ..operators.order import fill_forward, keep_first, null_safe_join

TABLE = ["doc_id", "page", "table_no"]


def _known(crosswalk: DataFrame, key: str, as_name: str) -> DataFrame:
    return crosswalk.select(F.col(key).alias(as_name)).where(
        F.col(as_name).isNotNull() & (F.col(as_name) != "")).distinct()


def _one_line(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "\n", " "))


def unrotate(cells: DataFrame, wider_than: int = 20) -> DataFrame:
    """Turn tables whose first row is unusually wide: text reversed, columns become rows and
    the old rows run from right to left."""
    shape = cells.groupBy(*TABLE).agg(
        F.count(F.when(F.col("row_no") == 0, 1)).alias("__width"), F.max("row_no").alias("__last"))
    out = null_safe_join(cells, shape, TABLE)
    turn = F.col("__width") > wider_than
    return out.select(
        *TABLE, F.when(turn, F.col("col_no")).otherwise(F.col("row_no")).alias("row_no"),
        F.when(turn, F.col("__last") - F.col("row_no")).otherwise(F.col("col_no")).alias("col_no"),
        F.when(turn, F.reverse("text")).otherwise(F.col("text")).alias("text"))


def _row_cells(cells: DataFrame) -> DataFrame:
    """The rows of each table as one array of lower-case cells, in column order."""
    return cells.groupBy(*TABLE, "row_no").agg(
        F.array_sort(F.collect_list(F.struct("col_no", F.lower(F.trim(F.coalesce("text", F.lit(""))))
                                             .alias("text")))).alias("cells"))


def header_row(cells: DataFrame, area_word: str = "county", data_words=P.DATA_WORDS,
               at_least: int = 3) -> DataFrame:
    """(table, header_row): the first row with three or more filled cells that names areas and
    some measure; 0 where there is none."""
    row = _row_cells(cells).withColumn("filled", F.filter(
        F.transform("cells", lambda c: c["text"]), lambda t: (t != "") & (t != "nan")))
    joined = F.array_join("filled", " ")
    names = F.contains(joined, F.lit(area_word))
    measures = F.exists(F.array(*[F.lit(w) for w in data_words]), lambda w: F.contains(joined, w))
    ok = (F.size("filled") >= at_least) & names & measures
    return row.groupBy(*TABLE).agg(F.coalesce(F.min(F.when(ok, F.col("row_no"))), F.lit(0))
                                   .alias("header_row"))


def map_header_columns(cells: DataFrame, at_least: int = 3, words=P.HEADER_WORDS,
                       bars=None) -> DataFrame:
    """(table, header_row, col_no, canon): columns of each table's header by keyword.

    Names are placed in order, each on the first free cell that holds one of its words. The
    header is the first row with three or more filled cells and some measure.
    """
    bars = P.HEADER_BARS if bars is None else bars
    row = _row_cells(cells)
    row = row.withColumn("filled", F.size(F.filter("cells", lambda c: c["text"] != "")))
    specs = F.array(*[F.struct(
        F.lit(canon).alias("canon"), F.array(*[F.lit(k) for k in keywords]).alias("words"),
        F.lit(bars.get(canon)).cast("string").alias("bar")) for canon, keywords in words])

    def place(taken: Column, spec: Column) -> Column:
        """Give the name its first cell that holds a keyword, not the bar, and is still free."""
        free = F.filter("cells", lambda c: (
            F.exists(spec["words"], lambda w: F.contains(c["text"], w))
            & F.coalesce(~F.contains(c["text"], spec["bar"]), F.lit(True))
            & ~F.exists(taken, lambda t: t["col_no"] == c["col_no"])))
        first = F.transform(F.slice(free, 1, 1), lambda c: F.struct(
            c["col_no"].cast("int").alias("col_no"), spec["canon"].alias("canon")))
        return F.concat(taken, first)

    found = F.aggregate(specs, F.array().cast("array<struct<col_no:int,canon:string>>"), place)
    row = row.withColumn("found", found)
    found = F.col("found")
    measures = F.exists(found, lambda p: ~p["canon"].isin("county", "subcounty"))
    heads = (row.where(measures & (F.col("filled") >= at_least))
             .groupBy(*TABLE).agg(F.min_by("found", "row_no").alias("found"),
                                  F.min("row_no").alias("header_row")))
    return heads.select(*TABLE, "header_row", F.explode("found").alias("f")).select(
        *TABLE, "header_row", "f.col_no", "f.canon")


def classify_rows(cells: DataFrame, crosswalk: DataFrame, area_wins: bool = True,
                  measures: list[str] | None = None, **kw) -> tuple[DataFrame, DataFrame]:
    """Area and sub-area records of name-keyed tables, with codes from the crosswalk.

    The row's name decides; ``area_wins`` settles names that are both. The first record of a
    name is kept.
    """
    measures = measures or [c for c, _ in P.HEADER_WORDS if c not in ("county", "subcounty")]
    heads = map_header_columns(cells, **kw)
    name_col = heads.groupBy(*TABLE, "header_row").agg(F.coalesce(
        F.max(F.when(F.col("canon") == "subcounty", F.col("col_no"))),
        F.max(F.when(F.col("canon") == "county", F.col("col_no"))), F.lit(0)).alias("__name"))
    wanted = name_col.select(*TABLE, "header_row", F.col("__name").alias("col_no"),
                             F.lit("__name").alias("canon")).unionByName(
        heads.where(F.col("canon").isin(*measures)))
    body = cells.join(wanted, [*TABLE, "col_no"]).where(F.col("row_no") > F.col("header_row"))
    rows = body.groupBy(*TABLE, "row_no").agg(
        F.max(F.when(F.col("canon") == "__name", F.col("text"))).alias("__text"),
        *[F.max(F.when(F.col("canon") == m, number_cell("text"))).alias(m) for m in measures])
    rows = rows.withColumn("key", name_key(_one_line(F.col("__text")))).drop("__text")
    rows = rows.join(_known(crosswalk, "county_norm", "key").withColumn("__a", F.lit(True)), "key", "left")
    rows = rows.join(_known(crosswalk, "subcounty_norm", "key").withColumn("__s", F.lit(True)), "key", "left")
    is_area, is_sub = F.coalesce("__a", F.lit(False)), F.coalesce("__s", F.lit(False))
    is_area, is_sub = (is_area, is_sub & ~is_area) if area_wins else (is_area & ~is_sub, is_sub)
    some = F.greatest(*[F.col(m).isNotNull() for m in measures], F.lit(False))
    order = [F.col(c) for c in (*TABLE, "row_no")]

    def finish(which: Column, key: str, carry: tuple[str, ...]) -> DataFrame:
        one = keep_first(rows.where(which & some).select(F.col("key").alias(key), *TABLE, "row_no", *measures),
                         [key], order)
        return one.join(key_table(crosswalk, key, carry), key, "left").select(key, *measures, *carry)

    return (finish(is_area, "county_norm", ("county_code", "county_name")),
            finish(is_sub, "subcounty_norm",
                   ("subcounty_code", "subcounty_name", "county_code", "county_name")))


def two_tier_crops(cells: DataFrame, keys: DataFrame, key: str = "county_norm", item: str = "doc_id",
                   skip=P.SKIP_NAMES) -> DataFrame:
    """(item, name, year, area_ha, production_mt) from tables with years over Area/Production.

    A year holds for the cells to its right until the next one. Of several cells for the same
    name and year the last counts.
    """
    head = cells.where(F.col("row_no") < 2).groupBy(*TABLE, "col_no").agg(
        F.trim(F.coalesce(F.max(F.when(F.col("row_no") == 0, F.col("text"))), F.lit(""))).alias("h1"),
        F.lower(F.trim(F.coalesce(F.max(F.when(F.col("row_no") == 1, F.col("text"))), F.lit("")))).alias("h2"))
    year = F.coalesce(*[F.nullif(F.regexp_extract(h, r"((?:19|20)\d{2})", 1), F.lit("")) for h in ("h1", "h2")])
    along = (Window.partitionBy(*TABLE).orderBy("col_no")
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    kind = (F.when((F.col("col_no") == 0) | F.contains(F.lower("h1"), F.lit("county"))
                   | F.contains("h2", F.lit("county")), F.lit(None))
            .when(F.contains("h2", F.lit("area")), "area").when(F.contains("h2", F.lit("prod")), "production"))
    spec = head.select(*TABLE, "col_no", kind.alias("kind"),
                       F.last(year, ignorenulls=True).over(along).try_cast("int").alias("year"))
    spec = spec.where(F.col("kind").isNotNull() & F.col("year").isNotNull())
    body = cells.where(F.col("row_no") >= 2)
    names = body.where(F.col("col_no") == 0).select(*TABLE, "row_no", _one_line(F.col("text")).alias("name"))
    low = F.lower("name")
    barred = F.lit(False)
    for w in skip:
        barred = barred | F.startswith(low, F.lit(w))
    names = (names.where((F.col("name") != "") & ~barred).withColumn("__k", name_key("name"))
             .join(_known(keys, key, "__k"), "__k", "left_semi").drop("__k"))
    cells_in = body.join(spec, [*TABLE, "col_no"]).join(names, [*TABLE, "row_no"])
    at = F.struct("page", "table_no", "row_no", "col_no")
    value = {k: F.max_by(number_cell("text"), F.when(F.col("kind") == k, at)) for k in ("area", "production")}
    out = cells_in.groupBy(item, "name", "year").agg(
        value["area"].alias("area_ha"), value["production"].alias("production_mt"))
    return out.where(F.col("area_ha").isNotNull() | F.col("production_mt").isNotNull())


def _named(spec: DataFrame, column: str, rules, name: str) -> DataFrame:
    """Join each row to the first rule whose words ``column`` holds; none: null."""
    low = F.lower(F.col(column))
    found = F.filter(F.array(*[F.struct(F.lit(w).alias("words"), F.lit(n).alias("name")) for w, n in rules]),
                     lambda r: F.contains(low, r["words"]))
    return spec.withColumn(name, F.get(found, F.lit(0))["name"])


AG_COLUMNS = [f"{m}_{t}" for m in ("ag_land_ha", "farming_households")
              for t in ("total", "subsistence", "commercial")]


def sectioned_table(cells: DataFrame, crosswalk: DataFrame, skip_keys: tuple[str, ...] = (),
                    columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Area and sub-area records of a table with a two-row header and area rows as sections.

    A name that is both area and sub-area is the sub-area only right inside its own section.
    """
    columns = columns or AG_COLUMNS
    top = _row_cells(cells)
    named = F.contains(F.array_join(F.transform("cells", lambda c: c["text"]), " "), F.lit("county"))
    hrow = top.groupBy(*TABLE).agg(F.coalesce(F.min(F.when(named, F.col("row_no"))), F.lit(0)).alias("__h"))
    tagged = null_safe_join(cells, hrow, TABLE)
    head = tagged.where(F.col("row_no").between(F.col("__h"), F.col("__h") + 1)).groupBy(
        *TABLE, "__h", "col_no").agg(
        F.nullif(F.trim(F.max(F.when(F.col("row_no") == F.col("__h"), F.col("text")))), F.lit("")).alias("g"),
        F.trim(F.coalesce(F.max(F.when(F.col("row_no") == F.col("__h") + 1, F.col("text"))), F.lit(""))).alias("s"))
    along = (Window.partitionBy(*TABLE).orderBy("col_no")
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    head = head.withColumn("g", F.coalesce(F.last("g", ignorenulls=True).over(along), F.lit("")))
    two = F.max(F.lower("s").rlike("subsist|commerc")).over(Window.partitionBy(*TABLE))
    head = _named(_named(head, "g", P.SECTION_MEASURES, "__measure"), "s", P.SECTION_USES, "__use")
    measure = F.coalesce("__measure", F.concat(F.lit("col_"), F.col("col_no").cast("string")))
    spec = head.select(*TABLE, "col_no", F.concat_ws("_", measure, "__use").alias("canon"),
                       (F.col("__h") + F.when(two, 2).otherwise(1)).alias("__start"))
    body = cells.join(spec, [*TABLE, "col_no"]).where(F.col("row_no") >= F.col("__start"))
    rows = body.groupBy(*TABLE, "row_no").agg(
        F.max(F.when(F.col("col_no") == 0, F.col("text"))).alias("__name"),
        *[F.max_by(number_cell("text"), F.when((F.col("canon") == c) & (F.col("col_no") > 0), F.col("col_no")))
          .alias(c) for c in columns])
    rows = rows.withColumn("key", name_key("__name")).where(~F.col("key").isin("", *skip_keys)).drop("__name")
    rows = rows.join(_known(crosswalk, "county_norm", "key").withColumn("__a", F.lit(True)), "key", "left")
    rows = rows.join(_known(crosswalk, "subcounty_norm", "key").withColumn("__s", F.lit(True)), "key", "left")
    rows = rows.withColumn("__section", F.when(F.col("__a"), F.col("key")))
    rows = fill_forward(rows, ["doc_id"], "page", ["table_no", "row_no"], ["__section"], exclusive=True)
    own = F.coalesce(F.col("__section") == F.col("key"), F.lit(False))
    sub = F.coalesce("__s", F.lit(False)) & (F.col("__a").isNull() | own)
    area = F.coalesce("__a", F.lit(False)) & ~sub
    order = [F.col(c) for c in (*TABLE, "row_no")]

    def finish(which, key, carry):
        one = keep_first(rows.where(which).select(F.col("key").alias(key), *TABLE, "row_no", *columns), [key], order)
        return one.join(key_table(crosswalk, key, carry), key).select(key, *columns, *carry)

    return (finish(area, "county_norm", ("county_code", "county_name")),
            finish(sub, "subcounty_norm", ("subcounty_code", "subcounty_name", "county_code", "county_name")))


def composition_rows(cells: DataFrame, page_heads: DataFrame, blocks=None) -> dict[str, DataFrame]:
    """Composition records per block: (food_code, food_group, food_name, columns.., ordinal).

    The words of a page's heading choose its block; two-digit rows name the group for the
    rows that follow in that block, five-digit rows are records.
    """
    blocks = P.COMPOSITION_BLOCKS if blocks is None else blocks
    head = F.lower("head")
    which = F.lit(None).cast("string")
    for name, spec in reversed(list(blocks.items())):
        has = F.lit(True)
        for w in spec["detect"]:
            has = has & F.contains(head, F.lit(w))
        which = F.when(has, name).otherwise(which)
    pages = page_heads.select("doc_id", "page", which.alias("block")).where(F.col("block").isNotNull())
    width = 2 + max(len(s["cols"]) for s in blocks.values())
    rows = cells.join(pages, ["doc_id", "page"]).groupBy("block", *TABLE, "row_no").agg(*[
        F.max(F.when(F.col("col_no") == i, F.col("text"))).alias(f"c{i}") for i in range(width)])
    code, name = F.trim("c0"), F.coalesce(_one_line(F.col("c1")), F.lit(""))
    rows = rows.withColumns({
        "food_code": F.when(code.rlike(r"^\d{5}$"), code), "food_name": name,
        "food_group": F.when(code.rlike(r"^\d{2}$"), F.trim(F.concat_ws(" ", code, name)))})
    rows = rows.where(F.col("food_code").isNotNull() | F.col("food_group").isNotNull())
    rows = fill_forward(rows, ["doc_id", "block"], "page", ["table_no", "row_no"], ["food_group"])
    records = rows.where(F.col("food_code").isNotNull())
    ordinal = F.struct(*TABLE, "row_no").alias("ordinal")
    return {b: records.where(F.col("block") == b).select(
        "food_code", "food_group", "food_name",
        *[composition_cell(f"c{i + 2}").alias(c) for i, c in enumerate(spec["cols"])], ordinal)
        for b, spec in blocks.items()}


NUMBER = r"([-+]?\d[\d,]*\.?\d*)"


def department_rows(cells: DataFrame, page_texts: DataFrame, label: str = r"(?i)^\s*agric",
                    heading: str = r"\b([A-Z][a-zA-Z' ]+?)\s+County\b") -> DataFrame:
    """(doc_id, county, alloc, spent): the first matching department row of each area.

    The area is the latest heading on this page or an earlier one; the first two numbers of
    the row are allocation and spending, in millions.
    """
    found = F.trim(F.regexp_extract("text", heading, 1))
    pages = page_texts.select("doc_id", "page", F.nullif(found, F.lit("")).alias("county"))
    pages = pages.withColumn("__block", F.floor(F.col("page") / 10_000))
    pages = fill_forward(pages, ["doc_id"], "__block", ["page"], ["county"]).drop("__block")
    labels = cells.where((F.col("col_no") == 0) & F.coalesce("text", F.lit("")).rlike(label)).select(
        *TABLE, "row_no")
    rest = (cells.where(F.col("col_no") > 0).join(labels, [*TABLE, "row_no"], "left_semi")
            .groupBy(*TABLE, "row_no").agg(F.array_sort(F.collect_list(F.struct(
                "col_no", F.coalesce("text", F.lit("")).alias("text")))).alias("cells")))
    numbers = F.flatten(F.transform("cells", lambda c: F.regexp_extract_all(c["text"], F.lit(NUMBER), 1)))
    rows = (rest.withColumn("n", numbers).where(F.size("n") >= 2)
            .select(*TABLE, "row_no", millions(F.get("n", F.lit(0))).alias("ag_budget_alloc_kes_m"),
                    millions(F.get("n", F.lit(1))).alias("ag_expenditure_kes_m"))
            .join(pages, ["doc_id", "page"]).where(
                F.col("county").isNotNull() & F.col("ag_budget_alloc_kes_m").isNotNull()
                & F.col("ag_expenditure_kes_m").isNotNull())
            .withColumn("__k", F.lower("county")))
    one = keep_first(rows, ["doc_id", "__k"], [F.col("page"), F.col("table_no"), F.col("row_no")])
    return one.select("doc_id", "county", "ag_budget_alloc_kes_m", "ag_expenditure_kes_m")
