"""Token counts against the library's own encoding of whole texts."""

import os
import random

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from paperloom.llm.tokens import PreTokens, count_tokens, widespread

WORDS = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", " \t\n", "The quick brown fox's don't they'll 1234 3.14", "naïve café Ünïcödé ŠTRASSE İstanbul ΑΣ ﬁne", "日本語テキスト と 한국어", "a b c　d\u0085e", "é ́x KK",
    "<|endoftext|>", "a<|startoftext|>b <|endoftext|><|ENDOFTEXT|> x<|endoftext|>", "< |endoftext|> <|endof text|>", "\x00\x01 \x0b\x0c\r end", "👩‍👩‍👧 🇫🇷 ok!!! ...", "x" * 30_000, "word " * 5000, "ab12cd_ef--gh((i))" * 40, "'s 's't're x'S", "#@!" * 3000,
]


def run(documents, docs, **options):
    return sorted(map(tuple, count_tokens(documents(docs), options.pop("path", WORDS), **options).collect()), key=str)


def expected(docs, path=WORDS, limit=2048):
    t = Tokenizer.from_file(path)
    n = [len(e.ids) for e in t.encode_batch([text or "" for _, text in docs], add_special_tokens=False)]
    return sorted(((d, len((text or "").encode()), k, k > limit) for (d, text), k in zip(docs, n, strict=True)), key=str)


def random_docs(seed, n):
    draw = random.Random(seed)
    letters = "abcdefghij éàÖß\n\t  .,;'-<|>0123456789  日本́"
    return [(i, "".join(draw.choice(letters) for _ in range(draw.randrange(400)))) for i in range(n)]


def test_odd_texts(documents):
    docs = list(enumerate(TEXTS))
    assert run(documents, docs) == expected(docs)


@pytest.mark.parametrize("most_bytes", [0, 2000, 1 << 24])
def test_rare_and_common_pretokens(documents, most_bytes):
    """All pre-tokens rare, some, none: the counts are the same."""
    docs = random_docs(13, 150) + [(200 + i, "some words that all documents have") for i in range(50)]
    assert run(documents, docs, most_bytes=most_bytes) == expected(docs)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json"])
def test_tokenizers_that_keep_white_space(documents, name):
    path = public_tokenizers.path(name)
    docs = random_docs(14, 60) + list(enumerate(TEXTS, 100))
    assert run(documents, docs, path=path) == expected(docs, path)


def test_repeated_rows_and_null_ids(documents):
    docs = [(1, "one two"), (1, "one two"), (1, "one two three"), (None, "one"), (None, "one"), (None, None), (2, None)]
    assert run(documents, docs, limit=2) == expected(docs, limit=2)
    assert run(documents, []) == []


def test_each_pretoken_once(spark):
    """Frequencies are of distinct pre-tokens, with one empty one a row."""
    import pyarrow as pa

    cutter = PreTokens(open(WORDS, encoding="utf-8").read())
    assert cutter.spaced
    offsets, tokens, counts = cutter.frequencies(pa.array(["the cat, the CAT.", "", " cat "]))
    rows = [dict(zip(tokens.to_pylist()[a:b], counts[a:b].tolist(), strict=True)) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    assert rows == [{"": 1, "the": 2, "cat,": 1, "CAT.": 1}, {"": 1}, {"": 1, "cat": 1}]
    assert cutter.pieces(["the", "cat,", "CAT.", "<|endoftext|>"]) == [1, 2, 2, 1]


def test_what_is_broadcast_fits(spark):
    pieces = spark.createDataFrame([(f"w{i}", i, 1) for i in range(1, 1000)], "pretoken string, docs long, pieces long")
    held = [r.docs for r in widespread(pieces, 5000).collect()]
    assert held == [] and [r.docs for r in widespread(pieces, 25_000).collect()] == list(range(512, 1000))
    assert widespread(pieces, 1 << 20).count() == 999


def test_workers_count_on_one_thread(spark):
    """The library's own threads would each keep tens of MB in every worker; a worker's environment doesn't say so by itself."""
    source = spark.sparkContext.broadcast(open(WORDS, encoding="utf-8").read())

    def run(batches):
        for batch in batches:
            os.environ.pop("TOKENIZERS_PARALLELISM", None)
            cutter, before = PreTokens.of(source.value), set(os.listdir("/proc/self/task"))
            for _ in range(3):
                cutter.pieces([f"word{i}" for i in range(1000)])
            added = set(os.listdir("/proc/self/task")) - before
            yield pa.RecordBatch.from_arrays([pa.array([len(added)], pa.int64())], names=["added"])

    assert [r.added for r in spark.range(1).coalesce(1).mapInArrow(run, "added long").collect()] == [0]
