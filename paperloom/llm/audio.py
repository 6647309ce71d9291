"""Media columns of telephony audio: 8-bit companded samples, ADPCM blocks and resampled PCM.

A media value is a RIFF/WAVE file in a binary column; its format tag says how it is decoded.
Mu-law and A-law samples are expanded by lookup tables. IMA ADPCM is decoded with numpy
across blocks: a step takes the next sample of all blocks at once, as only samples within a
block depend on each other. What comes out is resampled and stored as a PCM column.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import text_blocks

UNIT = 64
RATE = 8000
# Format tags of the container.
A_LAW, MU_LAW, IMA_ADPCM = 6, 7, 0x11
# The IMA ADPCM step sizes and index changes.
STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143,
     157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552,
     1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487,
     12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767], np.int32
)
INDEX_CHANGES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)


def mu_law_table() -> np.ndarray:
    """The 16-bit sample of each mu-law code."""
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = ((((code & 0x0F) << 3) + 0x84) << ((code >> 4) & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def a_law_table() -> np.ndarray:
    """The 16-bit sample of each A-law code."""
    code = np.arange(256, dtype=np.int32) ^ 0x55
    part, segment = (code & 0x0F) << 4, (code >> 4) & 7
    size = np.where(segment == 0, part + 8, (part + 0x108) << np.maximum(segment - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


def _adpcm_tables() -> tuple[np.ndarray, np.ndarray]:
    index, code = np.arange(len(STEPS))[:, None], np.arange(16)[None, :]
    step = STEPS[index]
    change = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
    return np.where(code & 8, -change, change).ravel(), np.clip(index + INDEX_CHANGES[code], 0, len(STEPS) - 1).astype(np.int32).ravel()


MU_LAW_SAMPLES, A_LAW_SAMPLES = mu_law_table(), a_law_table()
ADPCM_CHANGE, ADPCM_INDEX = _adpcm_tables()


def decode_adpcm(data: np.ndarray, block: int = UNIT) -> np.ndarray:
    """Samples (a row per block) of mono IMA ADPCM: a block is a 16-bit sample, an index, a spare byte and codes, low half first."""
    blocks = data.reshape(-1, block)
    value = (blocks[:, 0].astype(np.int32) | (blocks[:, 1].astype(np.int32) << 8)).astype(np.int16).astype(np.int32)
    index = np.minimum(blocks[:, 2], len(STEPS) - 1).astype(np.int32)
    codes = np.ascontiguousarray(np.stack([blocks[:, 4:] & 15, blocks[:, 4:] >> 4], axis=2).reshape(len(blocks), -1).T).astype(np.int32)
    out = np.empty((1 + len(codes), len(blocks)), np.int16)
    out[0] = value
    for i, code in enumerate(codes):
        at = (index << 4) | code
        value = np.clip(value + ADPCM_CHANGE[at], -32768, 32767)
        index = ADPCM_INDEX[at]
        out[i + 1] = value
    return out.T


def doubled_rate(samples: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Twice the rate: a sample (-1, 9, 9, -1) / 16 of its neighbours between each two. ``low``, ``high``: ends of each one's recording."""
    here = np.arange(len(samples))
    x = samples.astype(np.int32)
    before, after, beyond = (x[np.clip(here + d, low, high)] for d in (-1, 1, 2))
    between = np.clip((9 * (x + after) - before - beyond + 8) >> 4, -32768, 32767)
    return np.stack([samples, between.astype(np.int16)], axis=1).ravel()


def halved_rate(samples: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Half the rate: each second sample, smoothed with its neighbours by (1, 2, 1) / 4. ``size``: samples of each recording."""
    begin, low, high = _bounds(size)
    here = np.arange(len(samples))
    kept = here[(here - low) % 2 == 0]
    x = samples.astype(np.int32)
    before, after = (x[np.clip(kept + d, low[kept], high[kept])] for d in (-1, 1))
    return ((before + 2 * x[kept] + after + 2) >> 2).astype(np.int16), (size + 1) // 2


def _bounds(size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each recording begins, and for each sample the ends of its recording."""
    stop = np.cumsum(size)
    return stop - size, np.repeat(stop - size, size), np.repeat(stop - 1, size)


def resampled(samples: np.ndarray, size: np.ndarray, octaves: int) -> tuple[np.ndarray, np.ndarray]:
    """The recordings at 2 ** ``octaves`` times their rate, and their sizes."""
    for _ in range(octaves):
        _, low, high = _bounds(size)
        samples, size = doubled_rate(samples, low, high), 2 * size
    for _ in range(-octaves):
        samples, size = halved_rate(samples, size)
    return samples, size


def wave_file(payload: bytes, tag: int = MU_LAW, rate: int = RATE) -> bytes:
    """A mono file: a byte per sample, or blocks of ``UNIT`` bytes of ADPCM."""
    if tag == IMA_ADPCM:
        each = 2 * (UNIT - 4) + 1
        head = struct.pack("<IHHIIHHHH", 20, tag, 1, rate, rate * UNIT // each, UNIT, 4, 2, each)
        samples = len(payload) // UNIT * each
    else:
        head = struct.pack("<IHHIIHHH", 18, tag, 1, rate, rate, 1, 8, 0)
        samples = len(payload)
    body = b"WAVEfmt " + head + b"fact" + struct.pack("<II", 4, samples)
    body += b"data" + struct.pack("<I", len(payload)) + payload
    return b"RIFF" + struct.pack("<I", len(body)) + body


def wave_payload(media: bytes) -> tuple[int, int, int, int, int]:
    """Format tag, rate, block size, and start and size of the samples, from the chunks of a file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, tag, rate, block = 12, -1, 0, 1
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            tag, _, rate, _, block = struct.unpack_from("<HHIIH", media, at + 8)
        elif name == b"data":
            return tag, rate, block, at + 8, min(size, len(media) - at - 8)
        at += 8 + size + (size & 1)
    raise ValueError("no samples")


def decode_files(payloads: list[bytes], tags: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples of all files end to end and how many each has; by each file's coding, none for another one's."""
    found: list[np.ndarray] = [np.zeros(0, np.int16)] * len(payloads)
    for tag, samples in ((MU_LAW, MU_LAW_SAMPLES), (A_LAW, A_LAW_SAMPLES)):
        for i in np.flatnonzero(tags == tag):
            found[i] = samples[np.frombuffer(payloads[i], np.uint8)]
    for block in np.unique(blocks[tags == IMA_ADPCM]):
        if block < 5:
            continue
        of = np.flatnonzero((tags == IMA_ADPCM) & (blocks == block))
        # All blocks of all files of one block size at once; a last, shorter block is filled up and its surplus cut off.
        filled = [payloads[i] + bytes(-len(payloads[i]) % block) for i in of]
        rows = decode_adpcm(np.frombuffer(b"".join(filled), np.uint8), int(block))
        row = 0
        for i, full in zip(of, filled, strict=True):
            n, short = len(full) // block, len(full) - len(payloads[i])
            found[i] = rows[row : row + n].ravel()[: rows.shape[1] * n - (rows.shape[1] if block - short < 4 else 2 * short)]
            row += n
    return np.concatenate(found) if found else np.zeros(0, np.int16), np.array([len(x) for x in found], np.int64)


def encode_texts(docs: DataFrame, codings: tuple[int, ...] = (MU_LAW, A_LAW, IMA_ADPCM)) -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes, with zeros up to a positive multiple of 64, as the samples of a file.

    The coding is one of ``codings``, by the payload's checksum, so equal texts have equal
    files. Null texts are empty. A row per input row; an empty table gives none; other
    columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in text_blocks(batch.column("text")):
                files, raw = [], data.tobytes()
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    payload = raw[a:b] + bytes(-(b - a) % UNIT or (UNIT if a == b else 0))
                    files.append(wave_file(payload, codings[zlib.crc32(payload) % len(codings)]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(row, end - row), pa.array(np.diff(offsets)), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media"]
                )

    kind = dict(docs.dtypes)["doc_id"]
    slim = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return slim.mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


_FACTS = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, coding int, rate int"


def decode_media(media: DataFrame, octaves: int = -2) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, coding, rate, pcm) of the stored files.

    The payload is read back from the file and digested, then decoded by the file's format
    tag and block size; ``pcm`` has the recording at 2 ** ``octaves`` times its rate, as
    16-bit little-endian samples, and ``rate`` that rate. A file of another coding has an
    empty one; what isn't a WAVE file, or is null, is an error. A row per input row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in text_blocks(batch.column("media")):
                raw = data.tobytes()
                facts, parts, blocks = [], [], []
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    one = raw[a:b]
                    tag, rate, block, at, size = wave_payload(one)
                    payload = one[at : at + size]
                    parts.append(payload)
                    blocks.append(block)
                    digests = (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), b - a, hashlib.sha256(one).hexdigest())
                    facts.append((size, *digests, tag, int(rate * 2.0**octaves)))
                samples, size = resampled(*decode_files(parts, np.array([f[5] for f in facts]), np.array(blocks)), octaves)
                pcm, stop = samples.astype("<i2").tobytes(), np.cumsum(size)
                names = [x.split()[0] for x in _FACTS.split(", ")]
                kinds = [pa.string() if x.endswith("string") else pa.int32() if x.endswith("int") else pa.int64() for x in _FACTS.split(", ")]
                columns = [pa.array(x, k) for x, k in zip(zip(*facts, strict=True), kinds, strict=True)]
                columns.append(pa.array([pcm[2 * (b - n) : 2 * b] for n, b in zip(size, stop, strict=True)], pa.binary()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(row, end - row) for c in ("doc_id", "n_bytes")), *columns], names=["doc_id", "n_bytes", *names, "pcm"])

    kind = dict(media.dtypes)["doc_id"]
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id {kind}, n_bytes long, {_FACTS}, pcm binary")


def with_pcm_features(decoded: DataFrame) -> DataFrame:
    """``decoded`` with its PCM column read for (level, peak, turns, pcm_crc32) in its place.

    level is the sum and peak the largest of the absolute samples, turns how often the sign
    changes; all are 0 for an empty recording.
    """
    others = [c for c in decoded.columns if c != "pcm"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for one in batch.column("pcm"):
                x = np.frombuffer(one.as_buffer(), "<i2")
                size = np.abs(x.astype(np.int32))
                found.append((int(size.sum(dtype=np.int64)), int(size.max(initial=0)), int(np.count_nonzero(np.diff(x < 0))), zlib.crc32(x.tobytes())))
            columns = [pa.array(x, k) for x, k in zip(zip(*found, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)] if found else [
                pa.array([], k) for k in (pa.int64(), pa.int32(), pa.int64(), pa.int64())
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), *columns], names=[*others, "level", "peak", "turns", "pcm_crc32"])

    kinds = ", ".join(f"{c} {k}" for c, k in decoded.dtypes if c != "pcm")
    return decoded.mapInArrow(run, f"{kinds}, level long, peak int, turns long, pcm_crc32 long")
