"""Percentiles and far pages against sorting everything; counts of a write; embedding providers; the workbook source."""

import math
import random

import pytest
from pyspark.sql import functions as F

from paperloom.functions.providers import embedding_provider
from paperloom.operators import audit, listing, selection



def rank(values, percent):
    v = sorted(x for x in values if x is not None)
    return v[max(1, -(-len(v) * percent // 100)) - 1] if v else None


@pytest.mark.parametrize("few", [0, 5, 10_000])
def test_nearest_rank(spark, few):
    """Skewed, tied, single, null-only and empty groups, whatever is left to sort."""
    draw = random.Random(few)
    rows = [("many", draw.lognormvariate(0, 3)) for _ in range(700)] + [("ties", draw.choice([1.0, 2.0, 2.5])) for _ in range(90)] + [("one", 4.5), ("none", None), ("same", 7.0), ("same", 7.0), ("same", None)]
    rows += [(None, float(i)) for i in range(40)] + [("wide", x) for x in (-1e300, 1e300, 0.0, 1e-300, 5.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    for percent in (95, 50, 1, 100):
        found = {r.g: r.p for r in selection.nearest_rank(df, ["g"], "v", percent, "p", few=few, ranges=8).collect()}
        assert found == {g: rank([v for k, v in rows if k == g], percent) for g in {k for k, _ in rows}}
    whole = selection.nearest_rank(df, [], "v", 95, "p", few=few, ranges=8).collect()
    assert [r.p for r in whole] == [rank([v for _, v in rows], 95)]
    assert selection.nearest_rank(df.limit(0), ["g"], "v", 95, few=few).count() == 0


def test_nearest_rank_is_percentile_disc(spark):
    df = spark.range(5000).select((F.col("id") % 7).alias("g"), (F.xxhash64("id") % 900 / 8).alias("v"))
    want = df.groupBy("g").agg(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY v)").alias("p"))
    found = selection.nearest_rank(df, ["g"], "v", 95, "p", few=50)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))


KEYS = (("a", True), ("b", False), ("id", False))


def test_far_pages(spark):
    draw = random.Random(6)
    rows = [(draw.choice([None, 1, 2, 3, 3, 3]), draw.choice([None, "x", "y", "đ"]), i) for i in range(900)]
    df = spark.createDataFrame(rows, "a int, b string, id long")
    order = [F.col("a").desc_nulls_last(), F.col("b").asc_nulls_last(), F.col("id")]
    whole = [r.id for r in df.orderBy(*order).collect()]
    for offset, size in ((0, 7), (5, 20), (333, 50), (899, 10), (880, 100), (900, 5), (5000, 5)):
        got = [r.id for r in selection.far_page(df, KEYS, offset, size, few=60, ranges=8).collect()]
        assert got == whole[offset : offset + size], (offset, size)


def test_far_page_of_a_listing(spark, monkeypatch):
    monkeypatch.setattr(listing, "FAR", 100)
    df = spark.range(1000).select((F.col("id") % 10).alias("a"), F.lit("x").alias("b"), "id")
    page = listing.page_of(df, KEYS, 10, 20)
    assert [r.id for r in page.items.collect()] == [r.id for r in df.orderBy(F.col("a").desc(), "id").collect()][180:200] and page.total_count() == 1000


def test_counts_of_a_write(spark, tmp_path):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 50), (4, -1)], "id int, v int")
    out = str(tmp_path / "t")
    counts = audit.audited_write(df, {"small": "v < 10", "positive": "v > 0"}, lambda x: x.write.parquet(out))
    assert counts == {"rows": 4, "small": 1, "positive": 1}
    assert {r.id: r.broken for r in spark.read.parquet(out).collect()} == {1: [], 2: [], 3: ["small"], 4: ["positive"]}


def test_provider_is_loaded_once_and_checked(spark, tmp_path):
    log = str(tmp_path / "loads")

    def client(kind):
        def load():
            with open(log, "a") as f:
                f.write("x")

            def answer(texts):
                vectors = [[float(len(t)), 1.0] for t in texts]
                return {"good": vectors, "few": vectors[1:], "none": None, "wide": [[*v, 0.0] for v in vectors], "nan": [[math.nan, 1.0] for _ in vectors]}[kind]

            return answer

        return load

    texts = spark.range(300).coalesce(1).select("id", F.when(F.col("id") != 7, F.repeat(F.lit("a"), (F.col("id") % 5).cast("int"))).alias("t"))
    found = texts.select("id", embedding_provider(client("good"), 2, request=16)("t").alias("v")).collect()
    assert {r.id: r.v for r in found} == {i: [float(i % 5) if i != 7 else 0.0, 1.0] for i in range(300)}
    assert open(log).read() == "x"
    for kind, said in (("few", "15 embeddings for 16"), ("none", "0 embeddings"), ("wide", "3 dimensions, not 2"), ("nan", "not finite")):
        with pytest.raises(Exception, match=said):
            texts.select(embedding_provider(client(kind), 2, request=16)("t")).collect()
    assert texts.limit(0).select(embedding_provider(client("few"), 2)("t")).count() == 0
