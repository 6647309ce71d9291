"""Overlap joins, vector and text search, and index differences against plain comparisons."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.functions.text import STOP_WORDS
from paperloom.operators import chunking, digests, fulltext, index, search


def terms(text):
    return {w for w in re.findall(r"[^\W_]{2,}", (text or "").lower())} - set(STOP_WORDS)


@pytest.fixture
def texts(spark):
    draw = random.Random(4)
    words = [f"w{i}" for i in range(60)] + ["the"] * 30 + ["và"] * 5
    left = [(i, " ".join(draw.choices(words, k=draw.randint(0, 40)))) for i in range(60)] + [(99, None)]
    right = [(f"r{i}", " ".join(draw.choices(words + ["only here"], k=draw.randint(0, 25)))) for i in range(40)] + [("same", left[3][1]), ("none", None)]
    return spark.createDataFrame(left, "a long, text string"), spark.createDataFrame(right, "b string, text string"), left, right


@pytest.mark.parametrize(("least", "depth"), [(1, 2), (2, 2), (5, 2), (5, 1), (8, 4)])
def test_overlap(texts, least, depth):
    a, b, left, right = texts
    found = {(r.a, r.b, r.shared) for r in search.overlap(a, b, "a", "b", least=least, depth=depth).collect()}
    assert found == {(i, j, n) for i, x in left for j, y in right if (n := len(terms(x) & terms(y))) >= least}


def test_overlap_meets_in_rare_terms_only(spark):
    """Texts that share ten frequent terms and differ in the rest: no pair comes to be compared."""
    common = " ".join(f"common{k}" for k in range(10))
    a = spark.createDataFrame([(i, f"{common} left{i} " + " ".join(f"l{i}x{k}" for k in range(15))) for i in range(200)], "a long, text string")
    b = spark.createDataFrame([(i, f"{common} " + " ".join(f"l{j}x{k}" for j in (i, i + 50) for k in range(6))) for i in range(100)], "b long, text string")
    out = search.overlap(a, b, "a", "b", least=12)
    rows = sorted((r.a, r.b) for r in out.collect())
    assert rows == sorted((j, i) for i in range(100) for j in (i, i + 50))
    made = re.findall(r"number of output rows[^\d]*([\d,]+)", out._jdf.queryExecution().executedPlan().toString())
    assert all(int(n.replace(",", "")) < 10_000 for n in made)


def test_signals_of_all_lengths(spark):
    queries = spark.createDataFrame([(1, "Lập dự-toán kinh phí"), (2, "ab c"), (3, None)], "query_id long, query string")
    asked = queries.select("query_id", search.plain_words(F.col("query")).alias("plain"))
    signals = spark.createDataFrame([("a", "Dự toán"), ("b", "b c"), ("c", "B"), ("d", ""), ("e", "toán kinh phí x"), ("f", None), ("g", "án k"), ("a", "kinh")], "source_id string, phrase string")
    got = {(r.query_id, r.source_id) for r in search.phrase_hits(asked, signals, "query_id", "source_id").collect()}
    assert got == {(1, "a"), (1, "g"), (1, "d"), (2, "b"), (2, "c"), (2, "d")}


def nearest(queries, points, top, but=False):
    out = set()
    unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1)
    for q, v in queries:
        scores = sorted(((-round(float(unit(v) @ unit(p)), 9), i) for i, p in points if not (but and i == q)))
        out |= {(q, i, rank) for rank, (_, i) in enumerate(scores[:top], 1)}
    return out


@pytest.mark.parametrize("spread", [0.05, 3.0])
def test_vector_search_is_exact(spark, monkeypatch, spread):
    """Tight and loose clusters, several blocks of queries and of points."""
    monkeypatch.setattr(index, "QUERY_BLOCK", 15)
    monkeypatch.setattr(index, "POINT_BLOCK", 40)
    rng = np.random.default_rng(7)
    heads = rng.standard_normal((6, 8))
    points = [(i, (heads[i % 6] + spread * rng.standard_normal(8)).astype(np.float32).tolist()) for i in range(400)]
    queries = [(i, points[i][1]) for i in range(0, 400, 9)]
    p = spark.createDataFrame(points, "point_id long, embedding array<float>")
    q = spark.createDataFrame(queries, "query_id long, query array<float>")
    found = index.search(q, p, top=4, but=F.col("query_id") == F.col("point_id"))
    assert {(r.query_id, r.point_id, r["rank"]) for r in found.collect()} == nearest(queries, points, 4, True)
    kept = index.search(q, p, F.col("point_id") % 3 == 0, top=3)
    assert {(r.query_id, r.point_id, r["rank"]) for r in kept.collect()} == nearest(queries, [x for x in points if x[0] % 3 == 0], 3)
    placed, clusters = index.clustered(p, centers=10)
    again = index.search(q, placed.withColumnRenamed("point", "point_id").withColumn("point", F.col("point_id")), top=4, clusters=clusters)
    assert {(r.query_id, r.point_id, r["rank"]) for r in again.collect()} == nearest(queries, points, 4)


def test_tight_clusters_are_left_out():
    rng = np.random.default_rng(2)
    heads = index._unit(rng.standard_normal((12, 30)))
    centers = np.repeat(heads, 5, axis=0)
    clusters = index.Clusters(list(range(60)), centers, np.full(60, 10), np.full(60, 0.999))
    reach = index._reachable(clusters, heads, 5, True, None)
    assert (reach.sum(1) <= 10).all() and all(reach[i, 5 * i] for i in range(12))
    assert index._reachable(clusters, heads, 5, False, None).all()


def test_searches_read_queries_in_tasks(spark):
    """However many queries there are, the plan has one scan of each side, and no query is a literal."""
    p = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(50)], "point_id long, embedding array<float>")
    plans = []
    for n in (3, 40):
        q = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(n)], "query_id long, query array<float>")
        plans.append(index.search(q, p)._jdf.queryExecution().optimizedPlan().toString())
    assert plans[0].count("LogicalRDD") == plans[1].count("LogicalRDD") == 2
    with pytest.raises(ValueError, match="one size"):
        index.search(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "query_id long, query array<float>"), p)


def count_phrase(words, phrase):
    return sum(words[i : i + len(phrase)] == list(phrase) for i in range(len(words)))


def test_text_index(spark, tmp_path):
    draw = random.Random(8)
    vocabulary = ["alpha", "Alps", "beta", "gamma", "delta", "đá", "x1"]
    docs = [(i, " ".join(draw.choices(vocabulary, weights=[1, 1, 5, 3, 2, 1, 1], k=draw.randint(0, 30)))) for i in range(150)] + [(500, None), (501, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    other = spark.createDataFrame([(3, "beta gamma alpha beta gamma")], "id long, body string")
    sources = [("docs", df, "doc_id", "text"), ("notes", other, "id", "body")]
    stored = fulltext.written(fulltext.built(sources), str(tmp_path / "index"))

    def brute(words=(), phrases=(), prefixes=(), top=20):
        out = []
        for name, rows in (("docs", docs), ("notes", [(3, "beta gamma alpha beta gamma")])):
            for i, t in rows:
                w = re.findall(r"[^\W_]+", (t or "").lower())
                parts = [w.count(x.lower()) for x in words] + [count_phrase(w, [y.lower() for y in p]) for p in phrases] + [sum(y.startswith(x.lower()) for y in w) for x in prefixes]
                if all(parts):
                    out.append((-sum(parts), name, str(i)))
        return [(n, i, -s) for s, n, i in sorted(out)[:top]]

    for asked in (
        {"words": ("Beta",)}, {"words": ("beta", "đá")}, {"phrases": (("beta", "gamma"),)}, {"prefixes": ("al",)}, {"words": ("beta",), "phrases": (("beta", "beta"),), "prefixes": ("al", "g"), "top": 3},
        {"phrases": (("gamma", "alpha", "beta"),)}, {"words": ("missing", "beta")}, {"words": ("beta",), "top": 2}, {"words": ("alpha", "beta", "gamma", "delta"), "top": 1},
    ):
        assert [tuple(r) for r in fulltext.search(stored, **asked).collect()] == brute(**asked), asked
    assert "alps" in fulltext.snippets(fulltext.search(stored, words=("alps",), top=1), sources, "Alps").first().snippet.lower()
    for bad in ({}, {"words": ("",)}, {"phrases": ((),)}):
        with pytest.raises(ValueError):
            fulltext.search(stored, **bad)


def scanned(df, name="number of output rows"):
    """Rows that the scans of a plan gave."""
    df.collect()
    plan, rows = df._jdf.queryExecution().executedPlan(), []

    def walk(node):
        for child in [node.executedPlan()] if node.nodeName() == "AdaptiveSparkPlan" else [node.plan()] if "QueryStage" in node.nodeName() else [node.children().apply(i) for i in range(node.children().size())]:
            walk(child)
        if node.nodeName().startswith("Scan parquet"):
            rows.append(node.metrics().apply("numOutputRows").value())

    walk(plan)
    return sum(rows)


def test_a_text_query_reads_its_terms_only(spark, tmp_path):
    rows = [(i, " ".join(f"t{(i * 7 + k) % 400:03}" for k in range(40))) for i in range(400)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    stored = fulltext.written(fulltext.built([("docs", spark.createDataFrame(rows, "id long, text string"), "id", "text")]), str(tmp_path / "index"))
    found = stored.postings.filter(fulltext._any(fulltext.clauses(("t123",), prefixes=("t12",))))
    assert found.count() == 400 and scanned(found) <= stored.postings.count() / 2
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_unchanged_buckets_are_not_read(spark, tmp_path):
    rows = [(i, f"h{i}", None if i % 9 else "x") for i in range(2000)]
    old = spark.createDataFrame(rows, "id long, hash string, note string")
    path, compared = str(tmp_path / "t"), ["hash", "note"]
    digests.written(old, path, "id", compared, 64, 4)
    stored, tree = digests.stored_rows(spark, path), digests.stored_tree(spark, path)
    assert sorted({r.level for r in tree.collect()}) == [0, 1, 2, 3]
    assert digests.changes(old, stored, tree, "id", compared, 64, 4).count() == 0
    assert digests.changed_buckets(tree, digests.tree(old, "id", compared, 64, 4), 64, 4) == []
    new = spark.createDataFrame([(i, "other" if i == 77 else h, n) for i, h, n in rows if i != 5] + [(9999, "h", "x")], old.schema)
    found = digests.changes(new, stored, tree, "id", compared, 64, 4)
    assert {(r.id, r.state) for r in found.collect()} == {(77, "changed"), (5, "stale"), (9999, "new")}
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan and scanned(found) < 2000 * 6 / 64
    swapped = spark.createDataFrame([(i, h, n) if i not in (1, 2) else (i, f"h{3 - i}", n) for i, h, n in rows], old.schema)
    assert {(r.id, r.state) for r in digests.changes(swapped, stored, tree, "id", compared, 64, 4).collect()} == {(1, "changed"), (2, "changed")}


def test_sections_move_no_text(spark):
    df = spark.createDataFrame([(1, "I. One\nx\nII. Two\n\ny z\nABC"), (2, None), (3, " \n "), (4, "plain")], "id long, text string")
    found = chunking.sections(df)
    assert sorted(map(tuple, found.collect())) == [(1, 0, "I. One\nx"), (1, 1, "II. Two\n\ny z"), (1, 2, "ABC"), (4, 0, "plain")]
    long = spark.createDataFrame([(1, "HEAD\n" + " ".join(f"w{i}" for i in range(1000)) + "\nTAIL\nend")], "id long, text string")
    assert [(r.chunk_no, len(r.chunk.split())) for r in chunking.chunks(long).collect()] == [(1, 480), (2, 480), (3, 169), (4, 2)]
    for out in (found, chunking.chunks(df)):
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()




def test_postings_are_made_inside_rows(spark):
    """Without repeated ids nothing is shuffled; rows that share an id are one text's."""
    rows = [(1, "b a b"), (2, ""), (3, None), (4, "đá a"), (None, "c")]
    shape = "id long, text string"
    index = fulltext.built([("docs", spark.createDataFrame(rows, shape), "id", "text")])
    assert "Exchange" not in index.postings._jdf.queryExecution().executedPlan().toString()
    want = {("a", "1", (1,)), ("b", "1", (0, 2)), ("đá", "4", (0,)), ("a", "4", (1,)), ("c", None, (0,))}
    shown = lambda x: {(r.term, r.id, tuple(r.positions)) for r in x.postings.collect()}
    assert shown(index) == want
    again = fulltext.built([("docs", spark.createDataFrame([*rows, (4, "b a"), (None, "c d c")], shape), "id", "text")])
    assert shown(again) == want - {("a", "4", (1,)), ("c", None, (0,))} | {("a", "4", (1, 1)), ("b", "4", (0,)), ("c", None, (0, 0, 2)), ("d", None, (1,))}


def test_overlap_cuts_texts_into_words_once(spark):
    """Its steps read the terms that were written: no step sees a text again."""
    rows = spark.createDataFrame([(i, " ".join(f"w{(i + j) % 50}" for j in range(12))) for i in range(30)], "doc_id long, text string")
    found = search.overlap(rows, rows.withColumnRenamed("doc_id", "item_id"), "doc_id", "item_id", least=6)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan
    assert plan.count("array_intersect") == 1
    words = {r.doc_id: set(r.text.split()) for r in rows.collect()}
    want = {(a, b, len(words[a] & words[b])) for a in words for b in words if len(words[a] & words[b]) >= 6}
    assert {tuple(r) for r in found.collect()} == want
