import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paperloom.llm import jaccard
from paperloom.llm.graph import components
from paperloom.llm.hashing import shingle_sets
from paperloom.llm.jaccard import keep_one, near_duplicates

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def brute(rows, percent=75):
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            both = len(a & b)
            if i is not None and j is not None and a and b and 100 * both >= percent * (len(a) + len(b) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None and s else find(i) if s else i) for i, s in sets), key=str)


def compare(documents, rows, percent=75):
    got = near_duplicates(documents(rows), percent).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, percent)


@pytest.mark.parametrize("percent", [75, 50])
def test_chains_of_edits(documents, percent):
    rng = random.Random(percent)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    shared = [word() for _ in range(30)]
    rows, n = [], 0
    for _ in range(12):
        words = [word() for _ in range(rng.randint(20, 120))] + shared
        for _ in range(rng.randint(1, 8)):
            rows.append((n * 7 % 1009, " ".join(words)))
            n += 1
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = word()
    compare(documents, rows, percent)


def test_large_group_of_near_copies(documents):
    rng = random.Random(1)
    base = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(80)]
    rows = [(1000 + i, " ".join([*base[: i % 80], f"x{i}", *base[i % 80 + 1 :]])) for i in range(150)]
    rows += [(3000 + i, " ".join(base)) for i in range(40)] + [(5000 + i, " ".join(base[:40]) + f" y{i}") for i in range(5)]
    compare(documents, rows)


def test_edges(documents):
    long = " ".join(f"w{i % 9973}" for i in range(120_000))
    rows = [
        (1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "ONE  two"), (6, "one two three"), (7, long), (8, long + " end"), (9, "É e f g h i"), (10, "é e f g h i"),
        (11, "same same same same same same"), (12, "same same same same same"), (None, "one two"), (None, None), (4, "one two"), (13, "a b c d e f"), (14, "a b c d e f"),
    ]
    compare(documents, rows)
    assert near_duplicates(documents([])).count() == 0


def test_repeated_ids_with_several_texts(documents):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    got = {(r.doc_id, r.component_id) for r in near_duplicates(documents([(5, a), (5, b), (3, a), (9, b)])).collect()}
    assert got == {(5, 3), (3, 3), (9, 3)}


def test_keep_one(documents):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    docs = documents([(5, a), (3, a + " x"), (9, b), (9, b), (None, a), (1, "")])
    kept = keep_one(docs)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "9", "None"] and kept.columns == docs.columns
    assert keep_one(documents([])).count() == 0


def test_threshold_is_exact(documents):
    words = [f"w{i}" for i in range(16)]  # 12 shingles
    rows = [(1, " ".join(words)), (2, " ".join([*words, "a", "b", "c", "d"])), (3, " ".join([*words, "a", "b", "c", "d", "e"]))]
    assert 100 * 12 == 75 * 16
    compare(documents, rows)


def test_components(spark):
    path = [(i, i + 1) for i in range(100, 160)]
    star = [(500, 501 + i) for i in range(50)]
    links = [*path, *star, (7, 7), (160, 20), (20, 160), (900, 550)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 20 for i in range(100, 161)}, **{501 + i: 500 for i in range(50)}, 900: 500}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sets_of_words():
    texts = ["A b  c d E f", "a b c d e f", "a b", "b a", "", None, "x" * 3_000_000 + " y"]
    sets = [s for _, s in shingle_sets(pa.array(texts))]
    assert np.array_equal(sets[0], sets[1]) and [len(s) for s in sets] == [2, 2, 1, 1, 0, 0, 1] and sets[2][0] != sets[3][0]


def test_templated_texts_make_few_rows(spark, documents):
    """Texts of 6 of 30 sentences share shingles everywhere and are not similar: the rows of the joins stay in proportion to the texts."""
    draw = random.Random(30)
    sentences = [" ".join(f"s{i}w{j}" for j in range(14)) for i in range(30)]
    made = {}
    for n in (300, 600):
        docs = jaccard._prepared(documents([(i, " ".join(draw.sample(sentences, 6))) for i in range(n)]))
        summaries = jaccard.set_summaries(docs, 5)
        sets = jaccard.open_sets(docs, summaries, summaries.select("node"), 5)
        met = jaccard.rare_prefixes(sets, 75)
        every = met.alias("a").join(met.alias("b"), (F.col("a.token") == F.col("b.token")) & (F.col("a.node") < F.col("b.node"))).count()
        made[n] = jaccard.meetings(met, met, 75, "node").count()
        assert every > 10 * n and made[n] <= n
