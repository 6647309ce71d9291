import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from paperloom.llm import hashing, substrings
from paperloom.llm.substrings import remove_repeats


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans, start = [], None
        for i, g in enumerate([*gone, False]):
            if g and start is None:
                start = i
            elif not g and start is not None:
                spans.append((start, i))
                start = None
        out.append((len(b), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


def compare(documents, texts, length, gap, bits=64):
    got = {r.doc_id: (r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in remove_repeats(documents(list(enumerate(texts))), length, gap, bits).collect()}
    want = brute(texts, length)
    assert [got[i] for i in range(len(texts))] == want


@pytest.mark.parametrize("length, gap", [(20, 7), (20, 12), (50, 16)])
def test_random_overlaps(documents, length, gap):
    rng = random.Random(length + gap)
    blocks = ["".join(rng.choices("abcé", k=rng.randint(5, 80))) for _ in range(25)]
    texts = ["".join(rng.choices(blocks, k=rng.randint(0, 6))) for _ in range(120)]
    texts += ["a" * 200, "ab" * 100, "a" * (length - 1), "a" * length, "", None]
    compare(documents, texts, length, gap)


@pytest.mark.parametrize("bits", [1, 6])
def test_colliding_ranks_remove_nothing(documents, bits):
    """With ranks of a few bits most strings share buckets; the bytes removed are the same."""
    rng = random.Random(bits)
    blocks = ["".join(rng.choices("abcdefghé", k=rng.randint(5, 80))) for _ in range(30)]
    texts = ["".join(rng.choices(blocks, k=rng.randint(0, 4))) for _ in range(60)] + ["a" * 90, "", None]
    compare(documents, texts, 20, 7, bits)


def test_exact_edges(documents):
    rng = random.Random(3)
    unit = "".join(rng.choices("abcdefghijklmnop", k=60))
    fresh = lambda n: "".join(rng.choices("qrstuvwxyz", k=n))
    texts = [fresh(30) + unit + fresh(30), fresh(11) + unit + fresh(5), fresh(9) + unit[1:] + fresh(9), fresh(9) + unit[:-1] + fresh(3), unit[:30] + fresh(40)]
    compare(documents, texts, 60, 20)


def test_repeated_rows_and_nulls(documents):
    text = "".join(random.Random(5).choices("abcdef", k=300))
    rows = [(1, text), (1, text), (None, "z" + text[:100]), (2, None), (None, None)]
    got = sorted(((r.doc_id, r.n_bytes, len(r.kept)) for r in remove_repeats(documents(rows), 100, 30).collect()), key=str)
    assert got == sorted([(1, 300, 0), (1, 300, 0), (None, 101, 1), (2, 0, 0), (None, 0, 0)], key=str)
    assert remove_repeats(documents([]), 100, 30).count() == 0


def test_very_long_texts_in_pieces(documents):
    rng = np.random.default_rng(2)
    body = "".join(chr(97 + x) for x in rng.integers(0, 26, 3 * hashing.BLOCK_BYTES))
    part = body[hashing.BLOCK_BYTES - 500 : hashing.BLOCK_BYTES + 700]
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in remove_repeats(documents([(1, body), (2, "0" + part), (3, part[:399])])).collect()}
    assert got == {1: [(hashing.BLOCK_BYTES - 500, hashing.BLOCK_BYTES + 700)], 2: [(1, 1201)], 3: []}


def test_equal_strings_share_a_sample_position():
    rng = np.random.default_rng(7)
    unit = rng.integers(97, 123, 600, dtype=np.uint8)
    seen = []
    for before in (0, 13, 250):
        data = np.concatenate([rng.integers(48, 58, before, dtype=np.uint8), unit])
        row, rank, low, high, _, _ = substrings.block_runs(data, np.array([0, len(data)]), 400, 128)
        inside = low >= before
        seen.append(set(rank[inside].tolist()))
    assert len(set.intersection(*seen)) == min(map(len, seen))


def test_blocks_of_sliced_arrays():
    texts = pa.array(["skip", "ab", None, "", "cé"]).slice(1)
    got = [(a, b, bytes(d), o.tolist()) for a, b, d, o in hashing.text_blocks(texts, 3)]
    assert [g[:3] for g in got] == [(0, 3, b"ab"), (3, 4, "cé".encode())] and got[0][3] == [0, 2, 2, 2]


@pytest.mark.parametrize("key_bits", [0, 2])
def test_documents_of_one_key_are_told_apart(documents, key_bits):
    rng = random.Random(key_bits)
    pool = ["".join(rng.choices("abcd", k=60)) for _ in range(6)]
    rows = [(i, "".join(rng.choices(pool, k=rng.randint(0, 4))) + str(i)) for i in range(40)] + [(3, pool[0]), (3, pool[0]), (None, pool[1] + pool[0])]
    whole = sorted(map(str, remove_repeats(documents(rows), 30, 9).collect()))
    assert sorted(map(str, remove_repeats(documents(rows), 30, 9, key_bits=key_bits).collect())) == whole


def test_joins_of_hot_strings_can_be_split(documents):
    """Both sides of the last joins are stored tables: a join on what an aggregate has dealt can't be split."""
    text = "".join(random.Random(8).choices("abcdefgh", k=300))
    rows = [(i, f"{i:04d}" * (i % 3) + text + f"{i:04d}") for i in range(40)]
    starts = substrings.repeated_starts(substrings._keyed(documents(rows)), 40, 12)
    assert "Aggregate" not in starts._jdf.queryExecution().optimizedPlan().toString()
    assert starts.select("key").distinct().count() == 40
