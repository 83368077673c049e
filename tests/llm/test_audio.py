import hashlib
import struct
import zlib

import numpy as np
import pytest

from seqloom.llm import audio
from seqloom.llm.queries import QUERIES


def test_tables():
    mu, a = audio.LAWS[audio.MULAW], audio.LAWS[audio.ALAW]
    assert [int(mu[x]) for x in (0x00, 0x7F, 0x80, 0xFF, 0x0F)] == [-32124, 0, 32124, 0, -16764]
    assert [int(a[x]) for x in (0xD5, 0x55, 0xAA, 0x2A)] == [8, -8, 32256, -32256]
    assert len(set(mu.tolist())) == 255 and len(set(a.tolist())) == 256


def slow_adpcm(block):
    sample, at = struct.unpack_from("<h", block)[0], min(88, block[2])
    out = [sample]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(audio.STEPS[at])
            diff = step * (2 * (code & 7) + 1) >> 3
            sample = max(-32768, min(32767, sample - diff if code & 8 else sample + diff))
            at = max(0, min(88, at + int(audio.TURNS[code & 7])))
            out.append(sample)
    return out


def test_adpcm_equals_one_sample_at_a_time():
    data = np.random.default_rng(4).integers(0, 256, (7, 36), dtype=np.uint8)
    assert audio.adpcm(data, 36).tolist() == [slow_adpcm(bytes(b)) for b in data]


def test_resampling_keeps_a_tone():
    t = np.arange(4000) / 8000
    tone = np.rint(10000 * np.sin(2 * np.pi * 440 * t)).astype(np.int16)
    up = audio.resampled(tone, 8000, 16000)
    want = 10000 * np.sin(2 * np.pi * 440 * np.arange(8000) / 16000)
    assert len(up) == 8000 and np.abs(up[100:-100] - want[100:-100]).max() < 150
    assert len(audio.resampled(tone, 8000, 11025)) == -(-4000 * 441 // 320)
    assert audio.resampled(tone[:0]).tolist() == []


def test_wav_round_trip():
    for tag in (audio.MULAW, audio.ALAW, audio.ADPCM, audio.PCM):
        data = bytes(range(144)) * 4
        assert audio.unwav(audio.wav(data, tag))[::3] == (tag, data)
    with pytest.raises(ValueError):
        audio.unwav(b"something else")


def check(found, texts):
    by = {}
    for doc, text in texts:
        raw = (text or "").encode()
        n = len(raw)
        raw += b"\xff" * (-n % 576 or (0 if n else 576))
        by.setdefault(doc, []).append((n, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-32:])))
    got = {}
    for r in found.collect():
        got.setdefault(r["doc_id"], []).append((r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in by.items()}


def test_documents(spark, docs):
    texts = [(1, None), (2, ""), (3, "x" * 576), (4, "é" * 300), (4, "é" * 300), (None, "tie"), (5, "long " * 40000)]
    media = audio.encode(docs(texts).selectExpr("*", "lang AS media"))
    found = audio.decode(media)
    check(found, texts)
    rows = {r["doc_id"]: r for r in found.collect()}
    for r in rows.values():
        tag, rate, _, data = audio.unwav(r["pcm"])
        assert (tag, rate) == (audio.PCM, 16000)
        pcm = np.frombuffer(data, "<i2")
        assert f"crc32={zlib.crc32(pcm.tobytes())}" in r["feature"] and f"samples={len(pcm)};" in r["feature"]
    assert rows[1]["feature"] == rows[2]["feature"] and rows[1]["media_sha256"] == rows[2]["media_sha256"]
    broken = spark.createDataFrame([(1, 0, None)], "doc_id long, n_bytes long, media binary")
    assert audio.decode(broken).first()["feature"] is None
    assert audio.decode(audio.encode(docs([]))).count() == 0


def test_query(spark):
    d = "/root/testdata/sf0.001"
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    found = QUERIES["op6_audio"](spark, d)
    check(found, texts)
    assert {r["feature"].split(";")[0] for r in found.collect()} == {"mulaw", "alaw", "adpcm"}
