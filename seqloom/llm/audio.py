"""Telephony audio columns: mu-law, A-law and IMA ADPCM WAV files to resampled PCM.

mu-law and A-law are expanded by tables of 256 entries that are made by rule. ADPCM blocks
are decoded with numpy across all blocks of a batch of files: the samples of a block depend on
each other, those of different blocks don't. PCM is resampled by a windowed-sinc filter.

Nulls: a null file has null PCM and features; encoding a null text stores an empty payload.
Rows depend on their own file alone, so repeated rows have equal results; empty tables stay empty.
Files of any length are expanded whole, and a worker holds those of a bounded number of bytes, or
one longer one, at a time. Other columns play no part, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

MULAW, ALAW, ADPCM, PCM = 7, 6, 17, 1
NAMES = {MULAW: "mulaw", ALAW: "alaw", ADPCM: "adpcm"}
RATE_IN, RATE_OUT = 8000, 16000
#: Bytes of a frame that payloads are padded to, and of an ADPCM block; the one divides the other.
FRAME, BLOCK = 576, 144
TAPS = 16
#: Files that are decoded together.
FILES = 256

# Fixed values of the IMA ADPCM format.
STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    np.int32,
)
TURNS = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def _mulaw() -> np.ndarray:
    code = ~np.arange(256) & 255
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def _alaw() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    part, seg = (code & 15) << 4, code >> 4 & 7
    size = np.where(seg > 0, part + 264 << np.maximum(seg - 1, 0), part + 8)
    return np.where(code & 128, size, -size).astype(np.int16)


LAWS = {MULAW: _mulaw(), ALAW: _alaw()}


def adpcm(data: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Samples (blocks, 1 + 2 * (block - 4)) of IMA ADPCM blocks in data (blocks, block)."""
    sample = data[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    at = np.minimum(data[:, 2], 88).astype(np.int32)
    codes = np.empty((2 * (block - 4), len(data)), np.uint8)
    body = data[:, 4:].T
    codes[0::2], codes[1::2] = body & 15, body >> 4
    out = np.empty((len(codes) + 1, len(data)), np.int16)
    out[0] = sample
    for i, code in enumerate(codes):
        step = STEPS[at]
        size = code & 7
        diff = ((2 * size.astype(np.int32) + 1) * step) >> 3
        sample = np.clip(sample + np.where(code & 8, -diff, diff), -32768, 32767)
        at = np.clip(at + TURNS[size], 0, 88)
        out[i + 1] = sample
    return out.T


def wav(payload: bytes, tag: int, rate: int = RATE_IN, block: int = BLOCK) -> bytes:
    """A mono WAV file of this format around payload."""
    if tag == ADPCM:
        per = 1 + 2 * (block - 4)
        fmt = struct.pack("<HHIIHHHH", tag, 1, rate, rate * block // per, block, 4, 2, per)
        extra = b"fact" + struct.pack("<II", 4, len(payload) // block * per)
    elif tag == PCM:
        fmt, extra = struct.pack("<HHIIHH", tag, 1, rate, rate * 2, 2, 16), b""
    else:
        fmt, extra = struct.pack("<HHIIHHH", tag, 1, rate, rate, 1, 8, 0), b"fact" + struct.pack("<II", 4, len(payload))
    chunks = b"fmt " + struct.pack("<I", len(fmt)) + fmt + extra + b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def unwav(media: bytes) -> tuple[int, int, int, bytes]:
    """(format tag, rate, block size, payload) of a WAV file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, fmt = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        if name == b"fmt ":
            fmt = struct.unpack_from("<HHIIHH", media, at + 8)
        elif name == b"data" and fmt:
            return fmt[0], fmt[2], fmt[4], media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("a WAV file without data")


def resampled(pcm: np.ndarray, rate: int = RATE_IN, to: int = RATE_OUT, taps: int = TAPS) -> np.ndarray:
    """pcm at another rate, by a sinc filter under a Hann window, for each phase of the output."""
    if rate == to or not len(pcm):
        return pcm
    up, down = to // gcd(rate, to), rate // gcd(rate, to)
    n, cut = -(-len(pcm) * up // down), min(1.0, to / rate)
    x = np.concatenate([np.zeros(taps // 2 - 1), pcm.astype(np.float64), np.zeros(taps // 2 + 1)])
    out, k = np.empty(n), np.arange(taps) - (taps // 2 - 1)
    for phase in range(up):
        own = np.arange(phase, n, up)
        at, rest = np.divmod(own * down, up)
        if not len(own):
            continue
        far = k - rest[0] / up
        h = np.sinc(far * cut) * cut * np.cos(np.pi * far / (taps + 2)) ** 2
        y = np.convolve(x, (h / h.sum())[::-1], "valid")
        out[own] = y[at]
    return np.clip(np.rint(out), -32768, 32767).astype(np.int16)


def payload_of(text: str | None, frame: int = FRAME) -> tuple[bytes, int]:
    """UTF-8 of text with bytes 255 up to a positive multiple of frame, and its length before."""
    raw = (text or "").encode()
    return raw + b"\xff" * (max(1, -(-len(raw) // frame)) * frame - len(raw)), len(raw)


def encode(docs: DataFrame, frame: int = FRAME, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_bytes, media): each text as a WAV file, written to shared storage.

    The three formats take turns by the payload's checksum; each holds the bytes as they are.
    """
    tags = (MULAW, ALAW, ADPCM)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sliced(common.pieces_of(batches, 1), FILES):
            held = [payload_of(x.as_py(), frame) for x in batch.column(1)]
            media = [wav(p, tags[zlib.crc32(p) % 3], block=block) for p, _ in held]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for _, n in held], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    rows = docs.select("doc_id", "text")
    return common.staged(rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary"), "audio")


def expanded(files: list[tuple[int, int, int, bytes]]) -> list[np.ndarray]:
    """16-bit samples of each (tag, rate, block, payload); ADPCM blocks of equal size together."""
    out: list[np.ndarray] = [np.empty(0, np.int16)] * len(files)
    together: dict[int, list[int]] = {}
    for i, (tag, _, block, data) in enumerate(files):
        if tag in LAWS:
            out[i] = LAWS[tag][np.frombuffer(data, np.uint8)]
        elif tag == ADPCM:
            together.setdefault(block, []).append(i)
        elif tag == PCM:
            out[i] = np.frombuffer(data, "<i2")
        else:
            raise ValueError(f"format {tag}")
    for block, own in together.items():
        counts = [len(files[i][3]) // block for i in own]
        blocks = np.frombuffer(b"".join(files[i][3][: n * block] for i, n in zip(own, counts, strict=True)), np.uint8).reshape(-1, block)
        samples, at = adpcm(blocks, block), 0
        for i, n in zip(own, counts, strict=True):
            out[i] = samples[at : at + n].ravel()
            at += n
    return out


def feature(tag: int, pcm: np.ndarray) -> str:
    wide = pcm.astype(np.int64)
    n, power = max(1, len(pcm)), int((wide * wide).sum())
    crossed = int(np.count_nonzero(np.signbit(wide[1:]) != np.signbit(wide[:-1])))
    return f"{NAMES.get(tag, tag)};samples={len(pcm)};peak={int(np.abs(wide).max(initial=0))};mean_square={power // n};zero_crossings={crossed};crc32={zlib.crc32(pcm.tobytes())}"


def decode(media: DataFrame, rate: int = RATE_OUT, keep_pcm: bool = True) -> DataFrame:
    """media(doc_id, n_bytes, media) with what is read back from the files, and their PCM.

    Adds payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature and, if
    keep_pcm, pcm: a WAV file of 16-bit samples at this rate.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"] + ["pcm"] * keep_pcm
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sliced(common.pieces_of(batches, 2), FILES):
            stored = batch.column(2).to_pylist()
            files = [unwav(m) for m in stored if m is not None]
            sounds = iter(zip(files, expanded(files), strict=True))
            rows = []
            for n, m in zip(batch.column(1).to_pylist(), stored, strict=True):
                if m is None:
                    rows.append((n, *[None] * (len(names) - 2)))
                    continue
                (tag, own, _, data), pcm = next(sounds)
                pcm = resampled(pcm, own, rate)
                rows.append((n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature(tag, pcm), *[wav(pcm.tobytes(), PCM, rate)] * keep_pcm))
            cols = list(zip(*rows, strict=True)) or [()] * (len(names) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=False))], names)

    kind = media.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", pcm binary" * keep_pcm
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def stored(media: DataFrame, rate: int = RATE_OUT) -> DataFrame:
    """decode's columns without pcm: the PCM is written to shared storage, and feature is that of the PCM read back."""
    held = common.staged(decode(media, rate), "audio-pcm", codec="zstd")
    i, at = (held.columns.index(c) for c in ("feature", "pcm"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sliced(common.pieces_of(batches, at), FILES):
            found = []
            for named, m in zip(batch.column("feature").to_pylist(), batch.column("pcm").to_pylist(), strict=True):
                if m is None:
                    found.append(None)
                    continue
                samples = feature(PCM, np.frombuffer(unwav(m)[3], "<i2"))
                found.append(named.split(";", 1)[0] + ";" + samples.split(";", 1)[1])
            yield batch.set_column(i, batch.schema.field(i), pa.array(found, pa.string())).drop_columns(["pcm"])

    return held.mapInArrow(run, held.drop("pcm").schema)
