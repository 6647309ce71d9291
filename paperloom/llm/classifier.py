"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages of 64 words. Each passage is encoded (hashed byte
trigrams and a few shape features, then one learned layer); gated attention gives it a
weight within its document; the weighted sum of the encodings is scored. Only documents
have labels, so which passages matter is learned from them.

The model is fitted on the driver over a bounded sample of labelled documents. Scoring
reads every passage of every document, batch by batch, in the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, broadcast_if_small, local_table, stored
from .hashing import text_blocks, words_in

PASSAGE_WORDS = 64
TRIGRAM_SLOTS = 256
WORD_SLOTS = 256
#: Labelled documents of each class that the model is fitted on, at most.
SAMPLE_PER_CLASS = 1500
#: Passages of all of them together, at most, half of them for each class.
SAMPLE_PASSAGES = 20_000
#: Passages of one document that the model is fitted on, at most: of a longer one so many at even distances, from the first to the last.
DOCUMENT_PASSAGES = 256
#: Passages that are scored at once.
BLOCK = 2048
HIDDEN, GATE = 24, 12
EPOCHS, RATE, DECAY = 120, 0.02, 1e-3

_KINDS = np.full(256, 4, np.int64)  # 0 upper, 1 lower, 2 digit, 3 space, 4 other ASCII, 5 beyond ASCII
_KINDS[ord("A") : ord("Z") + 1] = 0
_KINDS[ord("a") : ord("z") + 1] = 1
_KINDS[ord("0") : ord("9") + 1] = 2
_KINDS[[0x20, *range(0x09, 0x0E)]] = 3
_KINDS[128:] = 5


def passage_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of a block of texts, and the first passage of each text (and the end); no text is without one."""
    starts, _, hashes, first = words_in(data, offsets)
    rows = len(offsets) - 1
    per_row = np.maximum(1, -(-(first[1:] - first[:-1]) // PASSAGE_WORDS))
    begin = np.concatenate([[0], np.cumsum(per_row)])
    total = int(begin[-1])
    # A passage starts at its first word, the first one of a text at the text's start.
    row_of = np.repeat(np.arange(rows), per_row)
    place = np.arange(total) - begin[row_of]
    word = first[row_of] + place * PASSAGE_WORDS
    cut = offsets[row_of].copy()
    later = place > 0
    cut[later] = starts[word[later]]
    length = np.diff(np.append(cut, len(data)))
    passage = np.repeat(np.arange(total), length)

    grams = np.zeros(total * TRIGRAM_SLOTS, np.float32)
    if len(data) > 2:
        d = data.astype(np.uint32)
        code = (d[:-2] * np.uint32(0x9E3779B1) + d[1:-1] * np.uint32(0x85EBCA77) + d[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(24)
        same = passage[:-2] == passage[2:]
        grams = np.bincount(passage[:-2][same] * TRIGRAM_SLOTS + code[same], minlength=total * TRIGRAM_SLOTS)
    grams = np.log1p(grams.reshape(total, TRIGRAM_SLOTS).astype(np.float32))
    grams /= np.maximum(1e-6, np.sqrt((grams * grams).sum(1, keepdims=True)))

    kinds = np.bincount(passage * 6 + _KINDS[data], minlength=total * 6).reshape(total, 6) / np.maximum(1, length)[:, None]
    word_row = np.searchsorted(first, np.arange(len(hashes)), side="right") - 1
    word_passage = begin[word_row] + (np.arange(len(hashes)) - first[word_row]) // PASSAGE_WORDS
    slots = np.bincount(word_passage * WORD_SLOTS + (hashes >> np.uint64(56)).astype(np.int64), minlength=total * WORD_SLOTS).reshape(total, WORD_SLOTS)
    count = slots.sum(1)
    most = np.maximum(1, count)
    shape = np.stack([(slots > 0).sum(1) / most, slots.max(1) / most, length / most / 16, count / PASSAGE_WORDS], axis=1)
    return np.concatenate([grams, kinds, shape], axis=1).astype(np.float32), begin


def in_order(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The product in 64 bits with each sum taken in the order of the columns, so that a row's result doesn't depend on the rows around it."""
    out = np.zeros((len(x), w.shape[1]))
    w = w.astype(np.float64)
    for start in range(0, len(x), BLOCK):
        part, columns = out[start : start + BLOCK], np.ascontiguousarray(x[start : start + BLOCK].T, np.float64)
        for column, weights in zip(columns, w, strict=True):
            part += column[:, None] * weights
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    encode: np.ndarray
    encode_bias: np.ndarray
    gate_tanh: np.ndarray
    gate_sigmoid: np.ndarray
    attend: np.ndarray
    score: np.ndarray
    score_bias: np.ndarray

    def forward(self, features: np.ndarray, begin: np.ndarray, times=np.matmul) -> dict[str, np.ndarray]:
        x = (features - self.mean) / self.scale
        h = np.tanh(times(x, self.encode) + self.encode_bias)
        t, s = np.tanh(times(h, self.gate_tanh)), 1 / (1 + np.exp(-times(h, self.gate_sigmoid)))
        e = times(t * s, self.attend[:, None])[:, 0]
        sizes = np.diff(begin)
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, begin[:-1]), sizes))
        a = e / np.repeat(np.add.reduceat(e, begin[:-1]), sizes)
        z = np.add.reduceat(a[:, None] * h, begin[:-1], axis=0)
        p = 1 / (1 + np.exp(-np.clip(times(z, self.score[:, None])[:, 0] + self.score_bias, -30, 30)))
        return {"x": x, "h": h, "t": t, "s": s, "a": a, "z": z, "p": p}

    def scores(self, texts: pa.Array) -> np.ndarray:
        """A score for each text, the same whatever other texts are scored with it."""
        out = np.zeros(len(texts))
        for row, end, data, offsets in text_blocks(texts):
            features, begin = passage_features(data, offsets)
            out[row:end] = self.forward(features, begin, times=in_order)["p"]
        return out


def fit(features: np.ndarray, begin: np.ndarray, labels: np.ndarray, weights: np.ndarray, seed: int = 9) -> Model:
    """Full-batch Adam on the weighted log loss."""
    rng = np.random.default_rng(seed)
    wide = features.shape[1]
    draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    model = Model(
        features.mean(0), features.std(0) + np.float32(1e-3), draw(wide, HIDDEN), np.zeros(HIDDEN, np.float32),
        draw(HIDDEN, GATE), draw(HIDDEN, GATE), draw(GATE), draw(HIDDEN), np.zeros(1, np.float32),
    )
    names = ("encode", "encode_bias", "gate_tanh", "gate_sigmoid", "attend", "score", "score_bias")
    first, second = ({k: np.zeros_like(getattr(model, k)) for k in names} for _ in range(2))
    weights = weights / weights.sum()
    sizes = np.diff(begin)
    for step in range(1, EPOCHS + 1):
        f = model.forward(features, begin)
        d_out = ((f["p"] - labels) * weights).astype(np.float32)
        d_z = d_out[:, None] * model.score
        d_zp = np.repeat(d_z, sizes, axis=0)
        d_a = (d_zp * f["h"]).sum(1)
        d_e = f["a"] * (d_a - np.repeat(np.add.reduceat(f["a"] * d_a, begin[:-1]), sizes))
        d_gate = d_e[:, None] * model.attend
        d_t, d_s = d_gate * f["s"] * (1 - f["t"] ** 2), d_gate * f["t"] * f["s"] * (1 - f["s"])
        d_h = f["a"][:, None] * d_zp + d_t @ model.gate_tanh.T + d_s @ model.gate_sigmoid.T
        d_pre = d_h * (1 - f["h"] ** 2)
        slopes = {
            "encode": f["x"].T @ d_pre + DECAY * model.encode, "encode_bias": d_pre.sum(0),
            "gate_tanh": f["h"].T @ d_t, "gate_sigmoid": f["h"].T @ d_s, "attend": (f["t"] * f["s"]).T @ d_e,
            "score": f["z"].T @ d_out + DECAY * model.score, "score_bias": np.array([d_out.sum()]),
        }
        for k in names:
            first[k] = 0.9 * first[k] + 0.1 * slopes[k]
            second[k] = 0.99 * second[k] + 0.01 * slopes[k] ** 2
            change = RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
            setattr(model, k, (getattr(model, k) - change).astype(np.float32))
    return model


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _spread(begin: int, end: int, most: int) -> np.ndarray:
    """All places from begin to end, or ``most`` of them at even distances."""
    return np.arange(begin, end) if end - begin <= most else np.linspace(begin, end - 1, most).round().astype(np.int64)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = SAMPLE_PER_CLASS) -> Model | float:
    """A model fitted to the labelled documents that aren't held out; the share of label 1 if only one class has any.

    Of each class, documents are taken in the order of their ids' hashes, ``per_class`` at
    most. A long document counts with ``DOCUMENT_PASSAGES`` passages from all over it; one
    that doesn't fit into what is left of its class's half of ``SAMPLE_PASSAGES`` is passed
    over, and those after it are still tried. Losses are weighted so that the classes count
    as in all labels. Ids with contradicting labels or without a document are left out; of
    an id with several texts the least text counts.
    """
    known = (
        labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.min(label).cast("int").alias("y"), F.max(label).cast("int").alias("other"))
        .filter("y = other").select("doc_id", "y")
    )
    known = broadcast_if_small(stored(known, "labels"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    present = stored(texts.select("doc_id").join(known, "doc_id").distinct(), "present")
    totals = {y: n for y, n in present.groupBy("y").count().collect()}  # two rows at most
    if len(totals) < 2:
        return float(next(iter(totals), 0.5))
    sample = None
    for y in (0, 1):
        part = present.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        sample = part if sample is None else sample.unionByName(part)
    # A row per id of the sample, and never more.
    chosen = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    passages = F.greatest(F.ceil(F.regexp_count("text", F.lit(WORD)) / PASSAGE_WORDS), F.lit(1)).cast("int")
    chosen = stored(chosen.withColumn("passages", passages), "sample")
    most = min(DOCUMENT_PASSAGES, max(1, SAMPLE_PASSAGES // 4))
    left, taken = {0: SAMPLE_PASSAGES // 2, 1: SAMPLE_PASSAGES // 2}, []
    for r in chosen.select("doc_id", "y", "passages").orderBy(F.xxhash64("doc_id"), "doc_id").collect():  # 2 * per_class rows at most
        size = min(r.passages, most)
        if size <= left[r.y]:
            left[r.y] -= size
            taken.append((r.doc_id,))
    fits = local_table(docs.sparkSession, taken, "doc_id long")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in text_blocks(batch.column("text")):
                features, begin = passage_features(data, offsets)
                packed = [features[_spread(a, b, most)].tobytes() for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(row, end - row) for c in ("doc_id", "y")), pa.array(packed, pa.binary())], names=["doc_id", "y", "features"]
                )

    rows = chosen.join(F.broadcast(fits), "doc_id").select("doc_id", "y", "text").mapInArrow(encode, "doc_id long, y int, features binary")
    found = {r.doc_id: r for r in rows.collect()}  # bounded: SAMPLE_PASSAGES passages of 2 * per_class documents at most
    ordered = [found[k] for k in sorted(found)]
    y = np.array([r.y for r in ordered], np.float32)
    wide = TRIGRAM_SLOTS + 6 + 4
    bags = [np.frombuffer(r.features, np.float32).reshape(-1, wide) for r in ordered]
    begin = np.concatenate([[0], np.cumsum([len(b) for b in bags])])
    features = np.concatenate(bags)
    del found, ordered, bags
    weights = np.where(y == 1, totals[1] / max(1, (y == 1).sum()), totals[0] / max(1, (y == 0).sum())).astype(np.float32)
    return fit(features, begin, y, weights)


def _scores(model: Model | float, texts: pa.Array) -> np.ndarray:
    return np.full(len(texts), model) if isinstance(model, float) else model.scores(texts)


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """(doc_id, held_out, score, predicted): a row per input row.

    Scores depend on the text alone. Null texts are empty; an empty text is one passage
    without words. A null doc_id isn't held out and has no label. Repeated rows get equal
    scores. Without labels of both classes every score is the one label's, or 0.5 without
    any. An empty table gives no rows; other columns are not read.
    """
    model = train(docs, labels, label, per_class)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_scores(model, batch.column("text")))], names=["doc_id", "score"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = slim.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, as they are."""
    model = train(docs, labels, label, per_class)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(model, batch.column("text")) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
