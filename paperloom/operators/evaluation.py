"""Retrieval and decision metrics, and the gates over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .selection import nearest_rank


def ratio(condition: Column, places: int = 4) -> Column:
    """The share of rows that meet the condition, half-even rounded; 0 for none."""
    share = F.avg(F.when(F.coalesce(condition, F.lit(False)), F.lit(1.0)).otherwise(F.lit(0.0)))
    return F.coalesce(F.bround(share, places), F.lit(0.0))


def least_score(negative_scores: DataFrame, score: str = "score") -> DataFrame:
    """(least): just above the best score of queries that should find nothing; from 0 without any."""
    return negative_scores.agg(F.bround(F.coalesce(F.max(score), F.lit(0.0)) + 1e-6, 6).alias("least"))


def expected_ranks(hits: DataFrame, expected: DataFrame, case: str = "case_id", item: str = "source_id") -> DataFrame:
    """(case, rank): the best rank of an expected item, 0 if none was found. ``hits`` has case, item, rank; ``expected`` case, item."""
    found = expected.join(hits.select(case, item, "rank"), [case, item], "left")
    return found.groupBy(case).agg(F.coalesce(F.min("rank"), F.lit(0)).alias("rank"))


def recall_and_mrr(ranks: DataFrame, top: int = 5) -> DataFrame:
    """(cases, recall, mrr) at ``top``."""
    inside = F.col("rank").between(1, top)
    gain = F.when(inside, 1.0 / F.col("rank")).otherwise(F.lit(0.0))
    return ranks.agg(F.count(F.lit(1)).alias("cases"), ratio(inside).alias("recall"), F.coalesce(F.bround(F.avg(gain), 4), F.lit(0.0)).alias("mrr"))


def p95(value: str, places: int = 3) -> Column:
    """Nearest-rank 95th percentile; null without rows."""
    return F.bround(F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {value})"), places)


def durations(rows: DataFrame, operation: str, seconds: str) -> DataFrame:
    """(operation, runs, p95, longest, total). The percentile is found by counts over ranges, so no group's values are held together."""
    totals = rows.groupBy(operation).agg(F.count(F.lit(1)).alias("runs"), F.max(seconds).alias("longest"), F.sum(seconds).alias("total"))
    ranked = nearest_rank(rows, [operation], seconds, 95, "p95").withColumnRenamed(operation, "__operation")
    joined = totals.join(ranked, F.col(operation).eqNullSafe(F.col("__operation")))
    return joined.select(operation, "runs", F.bround("p95", 3).alias("p95"), "longest", "total")


def decide(candidates: DataFrame, case: str = "case_id", item: str = "source_id") -> DataFrame:
    """(case, decision, item): the only candidate, or abstention for none or several. ``candidates`` has a null item for none."""
    grouped = candidates.groupBy(case).agg(F.count_distinct(item).alias("n"), F.max(item).alias("only"))
    one = F.col("n") == 1
    return grouped.select(case, F.when(one, F.lit("Suggested")).otherwise(F.lit("InsufficientEvidence")).alias("decision"), F.when(one, F.col("only")).alias(item))


def decision_scores(decisions: DataFrame, expected: DataFrame, case: str = "case_id", item: str = "source_id") -> DataFrame:
    """(accuracy over cases to be suggested, abstention over the others)."""
    want = expected.select(case, F.col("decision").alias("want"), F.col(item).alias("want_item"))
    both = want.join(decisions, case, "left")
    right = (F.col("want") == "Suggested") & (F.col("decision") == "Suggested") & F.col(item).eqNullSafe(F.col("want_item"))
    return both.agg(
        F.bround(F.try_divide(F.count_if(right), F.count_if(F.col("want") == "Suggested")), 4).alias("accuracy"),
        F.bround(F.try_divide(F.count_if((F.col("want") != "Suggested") & (F.col("decision") != "Suggested")), F.count_if(F.col("want") != "Suggested")), 4).alias("abstention"),
    )


def leaks(texts: DataFrame, fragments: DataFrame, text: str = "text", fragment: str = "fragment") -> DataFrame:
    """(texts, leaking): how many texts hold a fragment, without regard to case. Blank fragments are in every text.

    A fragment's inner words are whole words of any text that holds it, so its longest pair
    of neighbouring inner words is its seed: texts and fragments meet by a join of seeds,
    and only pairs that met are compared. Fragments without such a pair are looked for in
    each text; they are phrases of a few words.
    """
    asked = fragments.select(F.lower(fragment).alias("fragment")).filter("fragment IS NOT NULL").distinct()
    inner = asked.select("fragment", _neighbours(F.regexp_extract_all("fragment", F.lit(r"(?<=\s)\S+(?=\s)"), F.lit(0))).alias("pairs"))
    longest = F.array_max(F.transform("pairs", lambda p: F.struct((F.length(p["a"]) + F.length(p["b"])).alias("n"), p.alias("p"))))["p"]
    seeded = inner.filter(F.size("pairs") > 0).select("fragment", F.xxhash64(longest["a"], longest["b"]).alias("seed"))
    short = inner.filter(F.size("pairs") <= 0).select("fragment")

    lowered = texts.select(F.lower(F.coalesce(text, F.lit(""))).alias("text"))
    keyed = lowered.select("text", F.xxhash64("text").alias("found"), F.length("text").alias("size"))
    pairs = keyed.select("found", "size", F.explode(_neighbours(F.split(F.trim("text"), r"\s+"))).alias("p"))
    met = pairs.select("found", "size", F.xxhash64("p.a", "p.b").alias("seed")).join(seeded, "seed").select("found", "size", "fragment").distinct()
    held = lambda f: F.contains(F.col("text"), f)
    by_seed = keyed.join(met, ["found", "size"]).filter(held(F.col("fragment"))).select("found", "size")
    marked = by_seed.unionByName(keyed.join(short, held(F.col("fragment")), "left_semi").select("found", "size")).distinct()
    leaking = keyed.select("found", "size").join(marked, ["found", "size"], "left_semi").agg(F.count(F.lit(1)).alias("leaking"))
    return keyed.agg(F.count(F.lit(1)).alias("texts")).join(leaking)  # one row each


def _neighbours(words: Column) -> Column:
    """Structs (a, b) of each word and the next."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.arrays_zip(F.slice(words, F.lit(1), n).alias("a"), F.slice(words, F.lit(2), n).alias("b"))


def gates(metrics: DataFrame, limits: dict[str, tuple[str, float]]) -> DataFrame:
    """(gate, value, limit, passed) of a one-row table; limits: metric -> (>=, <= or =, bound). A null value fails."""
    rows = []
    for name, (sign, bound) in limits.items():
        value = F.col(name).cast("double")
        ok = {">=": value >= bound, "<=": value <= bound, "=": value == bound}[sign]
        rows.append(F.struct(F.lit(name).alias("gate"), value.alias("value"), F.lit(float(bound)).alias("limit"), F.coalesce(ok, F.lit(False)).alias("passed")))
    return metrics.select(F.explode(F.array(*rows)).alias("g")).select("g.*")


def all_passed(report: DataFrame) -> DataFrame:
    return report.agg(F.bool_and("passed").alias("passed"))


# The gates of an evaluation.
GATES = {"recall": (">=", 0.9), "mrr": (">=", 0.8), "accuracy": (">=", 0.8), "abstention": ("=", 1.0), "schema_validity": (">=", 0.95)}


def ranked(hits: DataFrame, case: str, score: str, item: str) -> DataFrame:
    """``hits`` with their rank in each case, by score and then id."""
    order = Window.partitionBy(case).orderBy(F.col(score).desc(), F.col(item))
    return hits.withColumn("rank", F.row_number().over(order))
