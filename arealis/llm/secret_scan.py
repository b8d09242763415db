"""Secret scans: credentials told from copied examples by how many owners and repositories hold them.

Assignments, access keys and hex strings are always reported. Besides these, long tokens are candidates; whether one is
reported is decided by the corpus: the hashes of all values are counted by distinct owners and repositories. A value
that several owners have is an example that people copy; one that belongs to a single owner and looks drawn at random is
that owner's credential.

DataFrame functions only. Places come from the lengths of what stands between matches, summed in a window over one
document's matches, so that a document with many matches costs no more than sorting them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

KINDS = ("assign", "access", "hex", "owned")
BASE = KINDS[:3]


def _either_case(words: str) -> str:
    """ASCII letters of a pattern in either case; engines fold letters beyond ASCII each in their own way."""
    return "".join(f"[{c.upper()}{c}]" if c.isascii() and c.isalpha() else c for c in words)


ASSIGN = _either_case("(password|passwd|secret|token|api_?key)") + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PATTERNS = {
    "assign": ASSIGN,
    "access": "AKIA[A-Z0-9]{16,}",  # the first of a run has the longest rest, so the bound may stand in the pattern
    "hex": "[0-9a-f]{24,}",
    "owned": "[A-Za-z0-9+/_=-]{20,}",
}
LEAST_VALUE = 6  # code points of an assigned value
LEAST_LETTERS = 8  # different characters of a value that looks drawn at random
PLACEHOLDERS = _either_case("(example|sample|changeme|placeholder|dummy|xxxx|your_)")
MAX_OWNERS = 1
MAX_REPOSITORIES = 100


def matches(text: Column) -> Column:
    """Leftmost non-overlapping matches of every kind: kind, number, characters since the one before, string."""
    def of(kind: int) -> Column:
        pattern = PATTERNS[KINDS[kind]]
        hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g).cast("long"))
        # zipped, not indexed: a split inside a lambda would be made again for every match
        both = F.when(text.rlike(pattern), F.arrays_zip(gaps.alias("gap"), hits.alias("hit")))
        return F.transform(both, lambda z, i: F.struct(F.lit(kind).alias("kind"), i.alias("number"),
                                                       z["gap"].alias("gap"), z["hit"].alias("hit")))

    found = F.flatten(F.array_compact(F.array(*map(of, range(len(KINDS))))))
    return F.filter(found, lambda m: m["hit"].isNotNull())  # behind the last match there is a gap only


def looks_random(value: Column) -> Column:
    """Letters and digits, several different characters, no placeholder word."""
    return (value.rlike("[A-Za-z]") & value.rlike("[0-9]") & ~value.rlike(PLACEHOLDERS)
            & (F.size(F.array_distinct(F.split(value, ""))) >= LEAST_LETTERS))


def placed_matches(found: DataFrame) -> DataFrame:
    """A row per match of a stored table (row, owner, repository, found): places, value hash, its looks.

    Places count code points, the end is exclusive. Assignments with too short a value are gone, and so are tokens
    that touch a match of another kind.
    """
    hits = found.select("row", "owner", "repository", F.explode("found").alias("m")).select(
        "row", "owner", "repository", "m.*")
    upto = Window.partitionBy("row", "kind").orderBy("number")
    hits = hits.withColumn("end", F.sum(F.col("gap") + F.length("hit")).over(upto))
    hits = hits.withColumn("start", F.col("end") - F.length("hit"))
    value = F.when(F.col("kind") == 0, F.regexp_extract("hit", ASSIGN, 2)).otherwise(F.col("hit"))
    hits = hits.withColumn("value", value).filter((F.col("kind") != 0) | (F.length("value") >= LEAST_VALUE))
    base = F.col("kind") < len(BASE)
    by_place = Window.partitionBy("row").orderBy("start", "kind")
    before = F.max(F.when(base, F.col("end"))).over(by_place.rowsBetween(Window.unboundedPreceding, 0))
    after = F.min(F.when(base, F.col("start"))).over(by_place.rowsBetween(0, Window.unboundedFollowing))
    hits = hits.withColumns({"before": before, "after": after})
    touched = (F.coalesce(F.col("before"), F.lit(-1)) > F.col("start")) | (F.coalesce(F.col("after"), F.col("end"))
                                                                           < F.col("end"))
    return hits.filter(base | ~touched).select(
        "row", "owner", "repository", "kind", "start", "end", F.sha2("value", 256).alias("value_sha256"),
        looks_random(F.col("value")).alias("random"))


def ownership(hits: DataFrame) -> DataFrame:
    """Distinct owners and repositories of every value hash.

    Three aggregates with map-side partials: a value that everybody copies is counted where its rows lie.
    """
    held = hits.select("value_sha256", "owner", "repository").distinct()
    by_owner = held.groupBy("value_sha256", "owner").agg(F.count("*").alias("n"))
    return by_owner.groupBy("value_sha256").agg(F.sum("n").alias("n_repositories"), F.count("*").alias("n_owners"))


def secret_report(df: DataFrame, text: str = "text", key: str = "doc_id", owner: str = "source",
                  repository: str = "doc_id", max_owners: int = MAX_OWNERS,
                  max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """``(key, secrets)`` for every row: an array in the order of start and kind.

    Each has kind, start, end, value_sha256, n_repositories, n_owners and a verdict: ``copied`` with more owners or
    repositories than allowed, else ``live`` if it looks drawn at random, else ``plain``. Tokens of kind ``owned`` are
    there only if they are live. A null text is an empty one; a null owner or repository counts as one; repeated rows
    give repeated results but count as one repository; other columns, of whatever name, are not read; an empty table
    gives no rows.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    found = stored(df.select(
        F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").alias("key"),
        F.col(f"`{owner}`").alias("owner"), F.col(f"`{repository}`").alias("repository"),
        matches(body).alias("found")))
    hits = stored(placed_matches(found))
    copied = (F.col("n_owners") > max_owners) | (F.col("n_repositories") > max_repositories)
    verdict = F.when(copied, "copied").when(F.col("random"), "live").otherwise("plain")
    judged = hits.join(ownership(hits), "value_sha256").withColumn("verdict", verdict).filter(
        (F.col("kind") < len(BASE)) | (F.col("verdict") == "live"))
    entry = F.struct("start", "kind", "end", "value_sha256", "n_repositories", "n_owners", "verdict")
    told = judged.select("row", entry.alias("secret"))
    everyone = found.select("row", "key", F.lit(None).cast(told.schema["secret"].dataType).alias("secret"))
    both = everyone.unionByName(told.withColumn("key", F.lit(None).cast(found.schema["key"].dataType)))
    per_row = both.groupBy("row").agg(F.max("key").alias("key"), F.sort_array(F.collect_list("secret")).alias("found"))
    names = F.array(*map(F.lit, KINDS))
    return per_row.select(
        F.col("key").alias(key),
        F.transform("found", lambda s: F.struct(
            names[s["kind"]].alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
            s["value_sha256"].alias("value_sha256"), s["n_repositories"].alias("n_repositories"),
            s["n_owners"].alias("n_owners"), s["verdict"].alias("verdict"))).alias("secrets"))


def listed(secrets: Column) -> Column:
    """``kind:start:end`` of every secret, comma-joined."""
    return F.array_join(F.transform(secrets, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                                                   s["end"].cast("string"))), ",")


def counted(secrets: Column, field: str, value: str) -> Column:
    return F.size(F.filter(secrets, lambda s: s[field] == value)).cast("long")
