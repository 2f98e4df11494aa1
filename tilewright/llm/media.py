"""Telephony audio columns: mu-law and A-law tables, ADPCM blocks, resampled PCM.

Bytes are carried losslessly as the 8-bit codes of a mu-law WAV file.  Reading back
expands the codes through a 256-entry table (A-law has its own).  The PCM is resampled to
16 kHz and stored as a WAV file of 16-bit samples, and coded as IMA ADPCM blocks of 64 samples, which are
decoded step by step with numpy over all blocks of a batch at once; what is described is read from
the stored bytes.

Null content counts as empty.  Every payload is padded with zero bytes to a positive
multiple of 64.  Rows are independent: no shuffle, equal bytes give equal values, ties and repeated rows too; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.vectors import row_slices

BLOCK = 64
RATE = 8000
LINEAR, MU_LAW, A_LAW = 1, 7, 6

# Fixed values of the IMA ADPCM format: index moves of a nibble and quantiser steps.
INDEX_STEPS = (-1, -1, -1, -1, 2, 4, 6, 8)
STEP_SIZES = (
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45,
    50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307,
    337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066,
    2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899,
    15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
)
STEP_COUNT = len(STEP_SIZES)


def mu_law_table() -> np.ndarray:
    """Linear value of each mu-law code (G.711)."""
    code = ~np.arange(256) & 0xFF
    value = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -value, value).astype(np.int16)


def a_law_table() -> np.ndarray:
    """Linear value of each A-law code (G.711)."""
    code = np.arange(256) ^ 0x55
    low, high = (code & 15) << 4, code >> 4 & 7
    value = np.where(high == 0, low + 8, (low + 264) << np.maximum(high - 1, 0))
    return np.where(code & 128, value, -value).astype(np.int16)


def pad(data: bytes) -> bytes:
    return data + bytes(-len(data) % BLOCK if data else BLOCK)


def wav_of(samples: bytes, codec: int = MU_LAW, rate: int = RATE, width: int = 1) -> bytes:
    """A mono WAV file of the samples, ``width`` bytes each."""
    fmt = struct.pack("<HHIIHH", codec, 1, rate, rate * width, width, 8 * width) + (b"" if codec == LINEAR else b"\0\0")
    fact = struct.pack("<I", len(samples) // width)
    body = b"".join((b"WAVE", b"fmt ", struct.pack("<I", len(fmt)), fmt, b"fact", struct.pack("<I", 4), fact, b"data", struct.pack("<I", len(samples) & 0xFFFFFFFF), samples))
    return b"RIFF" + struct.pack("<I", len(body) & 0xFFFFFFFF) + body + b"\0" * (len(samples) & 1)


def read_wav(stored: bytes) -> tuple[int, int, bytes]:
    """(codec, rate, sample bytes) of a stored file, by walking its chunks."""
    if stored[:4] != b"RIFF" or stored[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, codec, rate = 12, 0, 0
    while at + 8 <= len(stored):
        name, size = stored[at : at + 4], struct.unpack_from("<I", stored, at + 4)[0]
        if name == b"fmt ":
            codec, _, rate = struct.unpack_from("<HHI", stored, at + 8)
        elif name == b"data":
            return codec, rate, stored[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no samples")


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """PCM of IMA ADPCM mono blocks, a row each: 4 header bytes (first sample, step index,
    reserved), then two samples a byte, low nibble first.  All blocks advance together."""
    steps = np.array(STEP_SIZES)
    n, width = blocks.shape
    value = blocks[:, :2].copy().view("<i2").ravel().astype(np.int32)
    index = np.minimum(blocks[:, 2], STEP_COUNT - 1).astype(np.int32)
    move = np.array(INDEX_STEPS * 2, np.int32)
    out = np.empty((n, 1 + 2 * (width - 4)), np.int16)
    out[:, 0] = value
    at = 1
    for byte in blocks[:, 4:].T:
        for nibble in (byte & 15, byte >> 4):
            step = steps[index]
            delta = (step >> 3) + np.where(nibble & 4, step, 0) + np.where(nibble & 2, step >> 1, 0) + np.where(nibble & 1, step >> 2, 0)
            value = np.clip(value + np.where(nibble & 8, -delta, delta), -32768, 32767)
            index = np.clip(index + move[nibble], 0, STEP_COUNT - 1)
            out[:, at] = value
            at += 1
    return out


def encode_adpcm(pcm: np.ndarray) -> np.ndarray:
    """IMA ADPCM blocks of PCM rows of 1 + 2k samples, for decode_adpcm(); a block's first step is the one
    nearest above its first difference."""
    steps = np.array(STEP_SIZES)
    n, width = pcm.shape
    wide = pcm.astype(np.int32)
    value = wide[:, 0].copy()
    index = np.minimum(np.searchsorted(steps, np.abs(wide[:, min(1, width - 1)] - value)), STEP_COUNT - 1)
    head = np.zeros((n, 4), np.uint8)
    head[:, :2] = wide[:, :1].astype("<i2").view(np.uint8)
    head[:, 2] = index
    move = np.array(INDEX_STEPS * 2, np.int32)
    codes = np.empty((width - 1, n), np.uint8)
    for k, x in enumerate(wide[:, 1:].T):
        step, diff = steps[index], x - value
        size, code, delta = np.abs(diff), np.zeros(n, np.int32), step >> 3
        for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
            take = size >= part
            code |= np.where(take, bit, 0)
            size = size - np.where(take, part, 0)
            delta = delta + np.where(take, part, 0)
        code |= np.where(diff < 0, 8, 0)
        value = np.clip(value + np.where(diff < 0, -delta, delta), -32768, 32767)
        index = np.clip(index + move[code], 0, STEP_COUNT - 1)
        codes[k] = code
    return np.concatenate((head, (codes[0::2] | codes[1::2] << 4).T), 1)


def adpcm_rows(pcm: np.ndarray) -> np.ndarray:
    """A signal of whole blocks as rows for encode_adpcm(): each with the sample before it, the first with silence."""
    rows = pcm.reshape(-1, BLOCK)
    before = np.append(np.int16(0), rows[:-1, -1])
    return np.concatenate((before[:, None], rows), 1)


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation to another rate; the last sample is held."""
    n = len(pcm) * to // rate
    if to == 2 * rate:
        out = np.empty(n, np.int16)
        wide = pcm.astype(np.int32)
        out[0::2] = pcm
        out[1:-1:2] = (wide[:-1] + wide[1:]) >> 1
        out[-1:] = pcm[-1:]
        return out
    at = np.arange(n) * (rate / to)
    return np.interp(at, np.arange(len(pcm)), pcm).astype(np.int16)


def describe(codes: np.ndarray, mu: np.ndarray, al: np.ndarray) -> str:
    """Level, peak and sign changes of the mu-law signal, and the peak of its A-law reading."""
    counts = np.bincount(codes, minlength=256)
    energy = int((counts * mu.astype(np.int64) ** 2).sum())
    present = counts > 0
    crossings = int(np.count_nonzero((codes[1:] ^ codes[:-1]) & 128))
    return f"rms={(energy / len(codes)) ** 0.5:.3f};peak={int(np.abs(mu[present].astype(int)).max())};zc={crossings};alaw={int(np.abs(al[present].astype(int)).max())}"


MEDIA = "doc_id {id}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm_bytes long, pcm_sha256 string"
#: Blocks that are coded at once.
BLOCKS = 1 << 15


def _adpcm(signals: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(blocks, first block of each signal, sum of squared errors of each signal) of all signals together."""
    rows = np.concatenate([adpcm_rows(x) for x in signals])
    blocks, errors = [], []
    for i in range(0, len(rows), BLOCKS):
        blocks.append(encode_adpcm(rows[i : i + BLOCKS]))
        errors.append(((decode_adpcm(blocks[-1]).astype(np.int64) - rows[i : i + BLOCKS]) ** 2).sum(1))
    first = np.cumsum([0] + [len(x) // BLOCK for x in signals])
    return np.concatenate(blocks), first, np.add.reduceat(np.concatenate(errors), first[:-1])


def _store(schema: pa.Schema, files: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mu, al = mu_law_table(), a_law_table()
        for batch in batches:
            contents = batch.column("content").cast(pa.binary())
            sizes = np.concatenate(([0], np.cumsum(pc.fill_null(pc.binary_length(contents), 0).to_numpy().astype(np.int64) + BLOCK)))
            for at, stop in row_slices(sizes, 2 << 20):
                part = batch.slice(at, stop - at)
                out: dict[str, list] = {k: [] for k in schema.names if k != "doc_id"}
                signals = []
                for content in contents.slice(at, stop - at).to_pylist():
                    content = content or b""
                    stored = wav_of(pad(content))
                    _, rate, payload = read_wav(stored)
                    codes = np.frombuffer(payload, np.uint8)
                    signals.append(mu[codes])
                    pcm = wav_of(resample(signals[-1], rate, 2 * rate).astype("<i2").tobytes(), LINEAR, 2 * rate, 2)
                    out["n_bytes"].append(len(content))
                    out["payload_bytes"].append(len(payload))
                    out["payload_sha256"].append(hashlib.sha256(payload).hexdigest())
                    out["tail_crc32"].append(zlib.crc32(payload[-BLOCK:]))
                    out["media_bytes"].append(len(stored))
                    out["media_sha256"].append(hashlib.sha256(stored).hexdigest())
                    out["feature"].append(describe(codes, mu, al))
                    out["pcm_bytes"].append(len(pcm))
                    out["pcm_sha256"].append(hashlib.sha256(pcm).hexdigest())
                    if files:
                        out["media"].append(stored)
                        out["pcm"].append(pcm)
                blocks, first, errors = _adpcm(signals)
                for k, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
                    own = blocks[a:b].tobytes()
                    out["feature"][k] += f";adpcm={zlib.crc32(own):08x};noise={(errors[k] / len(signals[k])) ** 0.5:.3f}"
                    if files:
                        out["adpcm"].append(own)
                yield pa.RecordBatch.from_arrays([part.column("doc_id") if c == "doc_id" else pa.array(out[c], schema.field(c).type) for c in schema.names], schema=schema)

    return run


def store_media(df: DataFrame, id_col: str = "doc_id", content_col: str = "text", files: bool = False) -> DataFrame:
    """Each row's content stored as mu-law audio and read back.

    With ``files`` also ``media`` (the mu-law WAV file), ``pcm`` (the WAV file of 16-bit PCM at 16 kHz) and
    ``adpcm`` (the IMA ADPCM blocks of 36 bytes, 64 samples each).  ``feature`` has the signal's level (rms), peak, sign
    changes (zc), A-law peak, the check sum of its ADPCM blocks and the rms of what these lose (noise).
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    rows = df.select(F.col(id_col).alias("doc_id"), F.col(content_col).alias("content"))
    ddl = MEDIA.format(id=rows.schema["doc_id"].dataType.simpleString()) + (", media binary, pcm binary, adpcm binary" if files else "")
    return rows.mapInArrow(_store(to_arrow_schema(StructType.fromDDL(ddl)), files), ddl)
