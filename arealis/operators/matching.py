"""Rule-based matching of items to reference records, and nutrient supply."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import presets as P
from ..functions.numeric import safe_ratio
from ..functions.text import tight_key
from ..session import cut_lineage
from .aggregates import latest
from .indices import composite_index
from .order import exact_quantiles, keep_first


def preference_score(name: Column, preferred=P.PREFERRED_WORDS, processed=P.PROCESSED_WORDS) -> Column:
    """Two points per preferred word in the name, one off per processed form."""
    points = [F.contains(name, F.lit(w)).cast("int") * 2 for w in preferred]
    points += [F.contains(name, F.lit(w)).cast("int") * -1 for w in processed]
    return reduce(lambda a, b: a + b, points)


def match_items(items: DataFrame, records: DataFrame, item: str, record_name: str,
                ordinal: str, rules=None, preferred=P.PREFERRED_WORDS,
                processed=P.PROCESSED_WORDS) -> DataFrame:
    """Best reference record of every distinct item, as (item, all record columns).

    An item matches the records whose tight name holds one of its words and none of its
    barred words; an item without a rule is its own word. Best score first, then order of
    appearance. Holding a word is tested as an equi-join: the names are cut into pieces of
    the word lengths that occur, so items and records are never paired off wholesale.
    """
    rules = P.FOOD_RULES if rules is None else rules
    spark = items.sparkSession
    listed = spark.createDataFrame(
        [(k, list(words), list(barred)) for k, (words, barred) in rules.items()],
        "key string, words array<string>, barred array<string>")
    wanted = (
        items.select(item).distinct().where(F.col(item).isNotNull())
        .withColumn("key", tight_key(item)).where("key <> ''")
        .join(listed, "key", "left")
        .select(item, F.explode(F.coalesce("words", F.array("key"))).alias("word"),
                F.coalesce("barred", F.array().cast("array<string>")).alias("barred")))
    lengths = wanted.agg(F.collect_set(F.length("word")).alias("l")).scalar()

    cols = records.columns
    named = records.withColumn("__name", tight_key(record_name)).withColumn(
        "__score", preference_score(F.col("__name"), preferred, processed))
    sized = named.withColumn("__n", F.explode(lengths)).where(F.col("__n") <= F.length("__name"))
    pieces = F.transform(F.sequence(F.lit(1), F.length("__name") - F.col("__n") + 1),
                         lambda p: F.substring(F.col("__name"), p, F.col("__n")))
    cut = sized.withColumn("word", F.explode(F.array_distinct(pieces)))
    # the planner does not see how the pieces multiply, so neither side is broadcast on a guess
    hits = wanted.join(cut.hint("merge"), "word").where(
        ~F.exists("barred", lambda b: F.contains(F.col("__name"), b)))
    best = F.max_by(F.struct(*cols), F.struct("__score", -F.col(ordinal)))
    return hits.groupBy(item).agg(best.alias("__r")).select(item, "__r.*")


def edible_fraction(records: DataFrame, column: str = "edible_factor") -> Column:
    """Edible part in 0.1..1: a table of percentages is scaled, a missing value is 1."""
    median = exact_quantiles(records, [], column, {"q": 0.5}).select("q").scalar()
    scale = F.when(median > 1.5, F.lit(100.0)).otherwise(F.lit(1.0))
    part = F.coalesce(F.col(column).cast("double") / scale, F.lit(1.0))
    return F.greatest(F.lit(0.1), F.least(F.lit(1.0), part))


def nutrient_supply(production: DataFrame, composition: DataFrame, population: DataFrame,
                    by: str = "county_code", item: str = "crop", amount: str = "production_mt",
                    period: str = "year", name: str = "food_name", ordinal: str = "ordinal",
                    people: str = "population_total", rules=None) -> DataFrame:
    """Nutrients supplied per head and day and per 1000 kcal, and their composite index.

    Supply is production in grams, times the edible part, times content per gram, summed over
    the items that match a food. Production is added up per item before it is joined.
    """
    foods = composition.withColumn("__edible", edible_fraction(composition))
    if {"vit_a_rae_mcg", "vit_a_re_mcg"} <= set(foods.columns):
        foods = foods.withColumn("vit_a_rae_mcg", F.coalesce("vit_a_rae_mcg", "vit_a_re_mcg"))

    def per_gram(column: str) -> Column:
        if column not in foods.columns:
            return F.lit(0.0)
        return F.coalesce(F.col(column).try_cast("double") / 100.0, F.lit(0.0))

    foods = foods.select(name, ordinal, "__edible",
                         *[per_gram(src).alias(f"g_{k}") for k, src in P.NUTRIENTS.items()])
    rows = (latest(production, period).where(F.col(amount) > 0)
            .groupBy(by, item).agg(F.sum(amount).alias("__t"), F.count(F.lit(1)).alias("__n")))
    matched = match_items(rows, foods, item, name, ordinal, rules)
    grams = F.col("__t") * 1_000_000.0 * F.col("__edible")
    supply = rows.join(matched, item).groupBy(by).agg(
        F.sum("__n").alias("n_crops_matched"),
        *[F.sum(grams * F.col(f"g_{k}")).alias(f"s_{k}") for k in P.NUTRIENTS])
    heads = keep_first(population.select(by, F.col(people).try_cast("double").alias("__people")),
                       [by], [F.col("__people")])
    joined = supply.join(heads, by, "left")
    per_head = {P.PER_CAPITA_NAMES[k]: safe_ratio(F.col(f"s_{k}"), F.col("__people") * 365.0)
                for k in P.NUTRIENTS}
    per_kcal = {P.PER_CAPITA_NAMES[k].replace("_pc_day", "_per_1000kcal"):
                safe_ratio(f"s_{k}", "s_energy_kcal") * 1000.0
                for k in P.NUTRIENTS if k != "energy_kcal"}
    out = joined.select(by, "n_crops_matched",
                        *[c.alias(n) for n, c in {**per_head, **per_kcal}.items()])
    # one row per area from here on: written once, so the index does not repeat the work above
    return composite_index(cut_lineage(out), [P.PER_CAPITA_NAMES[k] for k in P.DENSITY_NUTRIENTS],
                           "food_nutrient_density_index", at_least=1)
