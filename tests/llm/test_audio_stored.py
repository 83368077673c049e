import io
import struct
import wave
import zlib

import numpy as np

from seqloom.llm import audio, common
from seqloom.llm.queries import QUERIES


def own_feature(name, raw):
    """peak, mean square and zero crossings, sample by sample."""
    samples = struct.unpack(f"<{len(raw) // 2}h", raw)
    peak = max(map(abs, samples), default=0)
    crossed = sum((a < 0) != (b < 0) for a, b in zip(samples, samples[1:], strict=False))
    return f"{name};samples={len(samples)};peak={peak};mean_square={sum(x * x for x in samples) // max(1, len(samples))};zero_crossings={crossed};crc32={zlib.crc32(raw)}"


def test_query_gives_the_pcm_and_its_feature(spark):
    found = QUERIES["op6_audio"](spark, "/root/testdata/sf0.001")
    rows = found.collect()
    names = {audio.MULAW: "mulaw", audio.ALAW: "alaw", audio.ADPCM: "adpcm"}
    seen = set()
    for r in rows:
        wave_file = wave.open(io.BytesIO(r["pcm"]))
        assert (wave_file.getframerate(), wave_file.getsampwidth(), wave_file.getnchannels()) == (16000, 2, 1)
        name = r["feature"].split(";")[0]
        assert name in names.values() and r["feature"] == own_feature(name, wave_file.readframes(wave_file.getnframes()))
        seen.add(name)
    assert len(seen) == 3 and len(rows) == 200
    # the PCM that is stored apart says the same
    again = audio.stored(audio.encode(common.table(spark, "/root/testdata/sf0.001", "documents")))
    assert {r["doc_id"]: r.asDict() for r in again.collect()} == {r["doc_id"]: r.asDict() for r in found.drop("pcm").collect()}


def test_changed_pcm_changes_the_feature(spark, docs, monkeypatch):
    media = audio.encode(docs([(1, "some text of a document"), (2, None)]))
    whole = audio.decode(media)
    quiet = audio.wav(np.zeros(5, "<i2").tobytes(), audio.PCM, audio.RATE_OUT)
    from pyspark.sql import functions as F

    monkeypatch.setattr(audio, "decode", lambda *a, **k: whole.withColumn("pcm", F.lit(quiet)))
    assert all(";samples=5;peak=0;" in r["feature"] for r in audio.stored(media).collect())
