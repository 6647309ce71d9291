"""The pipeline, stage by stage against plain versions, on the smallest tables."""

import os
import re

import pyarrow as pa
import pytest
from pyspark import SparkContext
from test_jaccard import brute as components_of
from test_mixing import WORD, targets

import corpus_pipeline
from paperloom.llm.classifier import score_quality
from paperloom.llm.common import BATCH_BYTES, local_table, stored, table
from paperloom.llm.decontaminate import MASKS
from paperloom.llm.secrets import RULES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def leaks(doc, item):
    """Whether some aligned stretch of 20 words (or the whole item) has 16 of 20 equal, around a seed hit."""
    for shift in range(-len(item) + 1, len(doc)):
        flags = [x == y for x, y in zip(doc[max(shift, 0) :], item[max(-shift, 0) :], strict=False)]
        need = min(20, len(item))
        if sum(flags) >= 0.8 * need and len(flags) >= need and any(sum(flags[s : s + need]) >= 0.8 * need for s in range(len(flags) - need + 1)):
            if any(all(flags[p + k] for k, bit in enumerate(m) if bit == "1") for m in MASKS for p in range(len(flags) - len(m) + 1)):
                return True
    return False


def test_each_stage_and_the_whole(spark):
    docs = table(spark, SF, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "benchmark", "secrets", "mixing"]

    one = stages["quality"](spark, docs, SF).cache()
    good = {r.doc_id for r in score_quality(docs, table(spark, SF, "labels")).collect() if r.predicted}
    assert one.columns == COLUMNS and {r.doc_id for r in one.collect()} == good and 0 < len(good) < len(rows)

    two = stages["near_duplicates"](spark, one, SF).cache()
    group = {i: c for i, _, c in components_of([(i, rows[i].text) for i in good])}
    assert two.columns == COLUMNS and {r.doc_id for r in two.collect()} == set(group.values())

    three = stages["benchmark"](spark, two, SF).cache()
    bench = [words(r.text) for r in table(spark, SF, "benchmark").collect()]
    vocabulary = {w for b in bench for w in b}
    clean = {r.doc_id for r in two.collect() if not any(leaks(words(r.text), b) for b in bench if len(set(words(r.text)) & set(b) & vocabulary) > 0.5 * len(set(b)))}
    assert three.columns == COLUMNS and {r.doc_id for r in three.collect()} == clean

    four = stages["secrets"](spark, three, SF).cache()
    assert four.columns == COLUMNS and four.count() == three.count()
    for r in four.collect():
        for rule in RULES:
            assert not [m for m in re.finditer(rule.pattern, r.text) if len(m[rule.group]) >= rule.least]
        assert r.n_chars == len(r.text) and (r.text == rows[r.doc_id].text or "[SECRET]" in r.text)

    kept = four.collect()
    sizes = {}
    for r in kept:
        sizes[r.source] = sizes.get(r.source, 0) + len(WORD.findall(r.text))
    want = targets(sizes)
    whole = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in whole} == {r.doc_id for r in kept}
    taken = {s: sum(r.taken for r in whole if r.source == s) for s in sizes}
    assert all(r.target == pytest.approx(want[r.source]) for r in whole)
    assert all(abs(taken[s] - want[s]) <= max(r.size for r in whole if r.source == s) for s in sizes)


def test_no_list_of_the_driver_passes_through_python_workers(spark, monkeypatch):
    def refused(self, *rows, **how):
        raise AssertionError("a list of rows starts Python workers on the executors")

    want = sorted(corpus_pipeline.run(spark, SF).collect())
    monkeypatch.setattr(SparkContext, "parallelize", refused)
    assert sorted(corpus_pipeline.run(spark, SF).collect()) == want
    assert local_table(spark, [], "key long, rules array<string>").collect() == []
    assert local_table(spark, [(1, ["a"]), (2, None)], "key int, rules array<string>").dtypes == [("key", "int"), ("rules", "array<string>")]


def test_batches_are_bounded_by_bytes(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"size": [batch.nbytes]})

    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    texts = spark.range(0, 900, 1, 1).selectExpr("repeat('0123456789', 1000) AS text")
    found = [r.size for r in stored(texts.mapInArrow(sizes, "size long"), "sizes").collect()]
    assert sum(found) > 9_000_000 and max(found) < BATCH_BYTES + 20_000
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before
