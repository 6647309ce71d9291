
import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import plain_audio as reference
from paperloom.llm import audio


def test_companding_tables():
    for code in range(256):
        assert audio.MU_LAW_SAMPLES[code] == reference.mu_law(code) and audio.A_LAW_SAMPLES[code] == reference.a_law(code)


def test_adpcm_across_blocks():
    data = np.random.default_rng(1).integers(0, 256, 64 * 50, dtype=np.uint8)
    data[2::64] = np.arange(50) * 2  # indices beyond the table, too
    got = audio.decode_adpcm(data)
    assert got.shape == (50, 121)
    for i in range(50):
        assert got[i].tolist() == reference.adpcm(data[64 * i : 64 * i + 64].tobytes())


def test_doubled_rate_stays_within_recordings():
    a, b = np.array([100, -200, 300, 32767], np.int16), np.array([5], np.int16)
    one = audio.doubled_rate(np.concatenate([a, b]), np.array([0, 0, 0, 0, 4]), np.array([3, 3, 3, 3, 4]))
    assert one[:8].tolist() == reference.doubled(a.tolist()) and one[8:].tolist() == reference.doubled([5]) and one[::2].tolist() == [*a, *b]


def test_halved_rate_stays_within_recordings():
    a, b = [100, -200, 300, 32767, 7], [5]
    got, size = audio.halved_rate(np.array([*a, *b], np.int16), np.array([5, 1]))
    assert size.tolist() == [3, 1] and got[:3].tolist() == reference.halved(a) and got[3:].tolist() == [5]


def test_wave_chunks():
    media = audio.wave_file(b"abcd" * 16)
    tag, rate, block, at, size = audio.wave_payload(media)
    assert (tag, rate, block, media[at : at + size]) == (audio.MU_LAW, 8000, 1, b"abcd" * 16) and len(media) == int.from_bytes(media[4:8], "little") + 8
    odd = media[:12] + b"LIST" + (3).to_bytes(4, "little") + b"abc\0" + media[12:]
    assert audio.wave_payload(odd)[0] == audio.MU_LAW
    assert audio.wave_payload(audio.wave_file(bytes(128), audio.IMA_ADPCM))[::2] == (audio.IMA_ADPCM, 64, 128)
    for bad in (b"", b"RIFF0000WAVE", b"x" * 50):
        with pytest.raises(ValueError):
            audio.wave_payload(bad)


DECODERS = {
    audio.MU_LAW: lambda p: [reference.mu_law(c) for c in p],
    audio.A_LAW: lambda p: [reference.a_law(c) for c in p],
    audio.IMA_ADPCM: lambda p: [x for i in range(0, len(p), 64) for x in reference.adpcm(p[i : i + 64])],
}


@pytest.mark.parametrize("octaves, change", [(-1, reference.halved), (0, list), (1, reference.doubled)])
def test_round_trip(documents, octaves, change):
    texts = [None, "", "a", "é" * 32, "x" * 64, "y" * 65, "dài " * 100_000, "a", *[f"text {i}" * i for i in range(30)]]
    docs = documents([*enumerate(texts), (None, "a")])
    rows = audio.with_pcm_features(audio.decode_media(audio.encode_texts(docs), octaves).withColumn("copy", F.col("pcm"))).collect()
    assert len(rows) == len(texts) + 1 and {r.coding for r in rows} == set(DECODERS)
    for r in rows:
        raw = ("a" if r.doc_id is None else texts[r.doc_id] or "").encode()
        padded = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        media = audio.wave_file(padded, r.coding)
        assert (r.media_bytes, r.media_sha256, r.rate) == (len(media), hashlib.sha256(media).hexdigest(), int(8000 * 2.0**octaves))
        if len(padded) < 5000:
            want = change(DECODERS[r.coding](padded))
            assert np.frombuffer(r.copy, "<i2").tolist() == want
            assert (r.level, r.peak, r.turns) == (sum(map(abs, want)), max(map(abs, want)), sum((x < 0) != (y < 0) for x, y in zip(want, want[1:])))


def test_files_are_decoded_by_their_own_format():
    rng = np.random.default_rng(4)
    body = [rng.integers(0, 256, n, dtype=np.uint8).tobytes() for n in (100, 100, 64, 64 + 34, 256, 3, 50)]
    tags = np.array([audio.A_LAW, audio.MU_LAW, audio.IMA_ADPCM, audio.IMA_ADPCM, audio.IMA_ADPCM, audio.IMA_ADPCM, 1])
    samples, size = audio.decode_files(body, tags, np.array([1, 1, 64, 64, 256, 64, 2]))
    got = np.split(samples, np.cumsum(size)[:-1])
    want = [DECODERS[audio.A_LAW](body[0]), DECODERS[audio.MU_LAW](body[1]), reference.adpcm(body[2]), reference.adpcm(body[3][:64]) + reference.adpcm(body[3][64:]), reference.adpcm(body[4]), [], []]
    assert [g.tolist() for g in got] == want


def test_empty_table(documents):
    assert audio.with_pcm_features(audio.decode_media(audio.encode_texts(documents([])))).count() == 0
