import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paperloom.llm import classifier
from paperloom.llm.hashing import text_blocks
from paperloom.llm.classifier import keep_quality, score_quality

RNG = random.Random(9)
GOOD = ["the", "and", "lines", "of", "words", "green", "river", "light", "stone", "every"]


def text(quality, n):
    words = RNG.choices(GOOD, k=n)
    if not quality:  # one bad stretch among good ones
        at = RNG.randrange(max(1, n - 30))
        words[at : at + 30] = ["BUY!!", "###", "$$$"] * 10
    return " ".join(words)


def labels(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, quality int, toxic int, score string")


def corpus(n=400):
    return [(i, i % 3 > 0, text(i % 3 > 0, 40 + i % 400)) for i in range(n)]


def test_held_out_accuracy(spark, documents):
    rows = corpus()
    marks = labels(spark, [(i, int(q), 0) for i, q, _ in rows])
    got = {r.doc_id: r for r in score_quality(documents([(i, t) for i, _, t in rows]), marks).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _, _ in rows)
    held = [(got[i].predicted, int(q)) for i, q, _ in rows if got[i].held_out]
    assert len(held) > 80 and np.mean([a == b for a, b in held]) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())


def test_held_out_labels_are_not_used(spark, documents):
    rows = corpus(150)
    docs = documents([(i, t) for i, _, t in rows])
    out = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    one = labels(spark, [(i, int(q), 0) for i, q, _ in rows])
    two = labels(spark, [(i, int(q) ^ out(i), 1) for i, q, _ in rows])
    first, second = ({r.doc_id: r.score for r in score_quality(docs, marks).collect()} for marks in (one, two))
    assert first == second


def test_edges(spark, documents):
    rows = corpus(120)
    docs = documents([*[(i, t) for i, _, t in rows], (None, rows[1][2]), (1, rows[1][2]), (900, None), (901, ""), (902, "x" * 300_000), (903, "the " * 100_000)])
    marks = labels(spark, [*[(i, int(q), 0) for i, q, _ in rows], (None, 1, 1), (900, None, 0), (2, 0, 0), (2, 1, 0)])
    got = score_quality(docs, marks).collect()
    assert len(got) == 126 and len({r.score for r in got if r.doc_id == 1} | {r.score for r in got if r.doc_id is None}) == 1
    assert {r.score for r in got if r.doc_id in (900, 901)}.__len__() == 1 and all(r.score is not None for r in got)
    kept = keep_quality(docs, marks)
    assert kept.columns == docs.columns and sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(r.doc_id) for r in got if r.predicted)
    assert score_quality(documents([]), marks).count() == 0 and keep_quality(documents([]), marks).count() == 0
    assert {r.score for r in score_quality(docs, labels(spark, [])).collect()} == {0.5}
    assert {r.score for r in score_quality(docs, labels(spark, [(0, 1, 0), (1, 1, 0), (2, 1, 0)])).collect()} == {1.0}


def test_passages():
    words = [f"w{i}" for i in range(150)]
    [(_, _, data, offsets)] = text_blocks(pa.array([" ".join(words), "", "a", "  "]))
    features, begin = classifier.passage_features(data, offsets)
    assert np.diff(begin).tolist() == [3, 1, 1, 1] and features.shape == (6, 266)
    assert features[:3, -1].tolist() == pytest.approx([1.0, 1.0, 22 / 64]) and not features[3].any()


def fitted():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((60, 12)).astype(np.float32)
    begin = np.arange(0, 61, 3)
    y = (np.add.reduceat(x[:, 0], begin[:-1]) > 0).astype(np.float32)
    return classifier.fit(x, begin, y, np.ones(20, np.float32)), x, begin, y


def test_a_fitted_model_tells_its_sample_apart():
    model, x, begin, y = fitted()
    p = model.forward(x, begin)["p"]
    assert ((p > 0.5) == (y > 0.5)).all()
    assert np.allclose(np.add.reduceat(model.forward(x, begin)["a"], begin[:-1]), 1, atol=1e-5)


def test_scores_do_not_depend_on_the_batch():
    rng = random.Random(3)
    texts = [" ".join(rng.choices(GOOD + ["BUY!!", "###"], k=rng.choice([0, 1, 5, 63, 64, 65, 200, 900]))) for _ in range(1000)]
    rows = [classifier.passage_features(*next(iter(text_blocks(pa.array([t]))))[2:]) for t in texts[:200]]
    begin = np.concatenate([[0], np.cumsum([len(f) for f, _ in rows])])
    y = np.array([float("BUY" in t) for t in texts[:200]], np.float32)
    model = classifier.fit(np.concatenate([f for f, _ in rows]), begin, y, np.ones(200, np.float32))
    together = model.scores(pa.array(texts))
    assert [model.scores(pa.array([t]))[0] for t in texts] == together.tolist()
    assert model.scores(pa.array(texts[::-1])).tolist() == together[::-1].tolist()


def test_the_sample_is_bounded(spark, documents, monkeypatch):
    monkeypatch.setattr(classifier, "SAMPLE_PASSAGES", 150)
    rows = corpus(300)
    marks = labels(spark, [(i, int(q), 0) for i, q, _ in rows])
    seen = {}
    monkeypatch.setattr(classifier, "fit", lambda x, begin, y, w: seen.update(passages=len(x), documents=len(y)) or 0.5)
    classifier.train(documents([(i, t) for i, _, t in rows] * 3), marks)
    assert 0 < seen["passages"] <= 150 and seen["documents"] <= 150


def sampled(monkeypatch, documents, spark, rows, cap=150):
    monkeypatch.setattr(classifier, "SAMPLE_PASSAGES", cap)
    seen = {}
    monkeypatch.setattr(classifier, "fit", lambda x, begin, y, w: seen.update(sizes=np.diff(begin).tolist(), y=y.tolist()) or 0.5)
    out = classifier.train(documents([(i, t) for i, _, t in rows]), labels(spark, [(i, int(q), 0) for i, q, _ in rows]))
    return seen, out


def hashed_first(spark, rows):
    ids = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    df = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    return df.orderBy(F.xxhash64("doc_id"), "doc_id").first()[0]


def test_one_long_document_changes_no_other(spark, documents, monkeypatch):
    """The first document by hash, with more passages than all may have together, takes its share and no more."""
    rows = corpus(60)
    first = hashed_first(spark, rows)
    plain, _ = sampled(monkeypatch, documents, spark, rows)
    long = [(i, q, " ".join(f"{t} {k}" for k in range(1500)) if i == first else t) for i, q, t in rows]
    seen, _ = sampled(monkeypatch, documents, spark, long)
    assert set(seen["y"]) == {0.0, 1.0} and max(seen["sizes"]) == 150 // 4
    assert sum(seen["sizes"]) <= 150 and len(seen["y"]) >= len(plain["y"]) - 37


def test_a_single_document_over_the_cap(spark, documents):
    """Two labelled classes never give a constant."""
    rows = [(i, q, t) for i, q, t in corpus(60)]
    first = hashed_first(spark, rows)
    kind = next(q for i, q, _ in rows if i == first)
    marks = [(i, int(q), 0) for i, q, _ in rows if i == first or q != kind]
    texts = [(i, " ".join([t] * 3000) if i == first else t) for i, _, t in rows]
    scores = {r.score for r in score_quality(documents(texts), labels(spark, marks)).collect()}
    assert len(scores) > 30


def test_spread_covers_all_of_a_document():
    assert classifier._spread(5, 9, 4).tolist() == [5, 6, 7, 8]
    assert classifier._spread(10, 1010, 5).tolist() == [10, 260, 510, 759, 1009]
