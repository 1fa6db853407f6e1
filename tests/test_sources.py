import io
import json
import tarfile
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.functions import durations
from pairloom.sources import files, tables
from pairloom.streaming import incremental


def wav(samples, rate=16_000, channels=1):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.asarray(samples, "<i2").tobytes())
    return out.getvalue()


def test_manifest_audio_and_tar(spark, tmp_path):
    folder = tmp_path / "audio" / "ihm" / "dev" / "fee041"
    folder.mkdir(parents=True)
    (folder / "fee041_es2011a_dev_h00_0000000-0000100.wav").write_bytes(wav([0, 8192] * 8000))
    (folder / "fee041_es2011a_dev_h00_0000000-0000100.txt").write_text("hello")
    (folder / "broken.wav").write_bytes(b"RIFF")
    (folder / "fee041_es2011a_dev_h00_0000100-0000100.wav").write_bytes(wav([]))
    assert files.corpus_root(spark, str(tmp_path)).endswith("audio")
    m = {r["stem"]: r for r in files.manifest(spark, str(tmp_path)).collect()}
    good = m["fee041_es2011a_dev_h00_0000000-0000100"]
    assert good.has_wav and good.has_txt and good.sid_matches_folder and good.mic_matches_folder and good.file_size_bytes == 32_044
    assert not m["broken"].parsed and not m["broken"].has_txt
    content = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.wav").load(str(tmp_path))
    d = {r["path"].rpartition("/")[2]: r for r in files.decode_wav(content).collect()}
    assert d["broken.wav"].error and d["fee041_es2011a_dev_h00_0000100-0000100.wav"].error == "empty_file"
    one = d["fee041_es2011a_dev_h00_0000000-0000100.wav"]
    assert one.duration_s == 1 and one.signal[1] == 0.25
    audit = files.audit_durations(files.decode_wav(content), durations.duration_s(F.col("path"))).first()
    assert audit["max_abs_diff_s"] == 0
    with tarfile.open(tmp_path / "a.tar", "w") as tar:
        tar.add(folder / "broken.wav", "x/broken.wav")
    assert [r["member"] for r in files.read_tar(spark, str(tmp_path / "a.tar")).collect()] == ["x/broken.wav"]


def test_text_tables(spark, tmp_path):
    (tmp_path / "text").write_text("C_IS1003b_H00_FEE041_0000100_0000250 so it is\n\nC_ES1_H00_FEE041_0000000_0000100\n")
    a = {r["meeting_id"]: r for r in tables.read_annotations(spark, str(tmp_path / "text")).collect()}
    assert a["IS1003b"].transcript == "so it is" and a["IS1003b"].end_time == 2.5 and a["ES1"].transcript == ""
    far = tables.distant_annotations(tables.read_annotations(spark, str(tmp_path / "text"))).collect()
    assert [(r["utterance"], r["microphone_id"]) for r in far] == [("C_ES1_sdm_FEE041_0000000_0000100", "SDM1")]
    (tmp_path / "segments").write_text("a f1 0.5 1.5\nb f1 2 4\n")
    assert tables.segments_by_folder(tables.read_segments(spark, str(tmp_path / "segments"))).first()["seconds"] == 3
    (tmp_path / "t.csv").write_text("enroll_path,test_path,duration_diff\na,b,0.29\na,c,\na,d,x\n")
    assert [r["duration_diff_cs"] for r in tables.read_trials_csv(spark, str(tmp_path / "t.csv")).collect()] == [29, None, None]
    (tmp_path / "f.csv").write_text("id,energy_db,wada_snr_db,error\n1,2.0,3.0,\n2,,,bad\n")
    assert tables.usable_features(tables.read_features(spark, str(tmp_path / "f.csv"))).count() == 1
    bins = [{"index": i, "lower_seconds": i * 1.0, "upper_seconds": i + 1.0, "width_seconds": 1.0, "count": 5} for i in range(3)]
    (tmp_path / "b.json").write_text(json.dumps({"equal_width_bins": {"bins": bins}}))
    found = tables.read_bins(spark, str(tmp_path / "b.json"))
    assert tables.check_bins(found, 3).count() == 3
    with pytest.raises(ValueError):
        tables.check_bins(found, 4)
    with pytest.raises(ValueError):
        tables.require_columns(found, ["nope"])


def test_workbook_arrays_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a <b>", 1), (None, 2)], "wav_path string, n int")
    tables.write_workbook(spark, str(tmp_path / "w.xlsx"), {"Enroll": df, "Test": df.limit(1)}, [("rows", "=COUNTA(Enroll!A:A)-1")])
    got = tables.read_sheet(spark, str(tmp_path / "w.xlsx"), "Enroll", ["wav_path"]).collect()
    assert [tuple(r) for r in got] == [("a <b>", "1"), (None, "2")]
    np.save(tmp_path / "s.npy", np.arange(5, dtype=np.float32))
    np.save(tmp_path / "e.npy", np.arange(6, dtype=np.float32).reshape(3, 2))
    assert [r["value"] for r in tables.read_npy(spark, str(tmp_path / "s.npy"), rows=2).orderBy("id").collect()] == [0, 1, 2, 3, 4]
    assert tables.read_npy(spark, str(tmp_path / "e.npy")).orderBy("id").collect()[2]["vector"] == [4, 5]
    for codec in tables.CODECS:
        tables.write_table(df, str(tmp_path / codec), codec, row_group_bytes=1 << 20)
        assert spark.read.parquet(str(tmp_path / codec)).count() == 2
    tables.convert(spark, str(tmp_path / "zstd"), "parquet", str(tmp_path / "orc"), "orc")
    assert spark.read.orc(str(tmp_path / "orc")).count() == 2
    assert tables.json_report(df).first()["json"] == '{"wav_path":"a <b>","n":1}' and "| a <b> | 1 |" in tables.markdown("T", df)
    spark.createDataFrame([(1, 2, -1)], "enroll_id int, test_id int, duration_diff_cs int").write.parquet(str(tmp_path / "enc"))
    assert tables.read_trials(spark, str(tmp_path / "enc"), ["duration_diff_cs"]).first()[0] is None


def test_resume_and_follow(spark, tmp_path):
    rows = spark.range(10).select(F.col("id"), F.lit(None).cast("double").alias("x"))
    path = str(tmp_path / "done")

    def work(df, bad):
        return df.select("id", F.when(~F.col("id").isin(bad), 1.0).alias("value"), F.when(F.col("id").isin(bad), "failed").alias("error"))

    assert incremental.resume(rows, path, lambda d: work(d, [3, 4]), "id", "value") == 10
    assert incremental.resume(rows, path, lambda d: work(d, [4]), "id", "value") == 2
    assert incremental.todo(rows, spark.read.parquet(path), "id", "value").count() == 1
    best = incremental.latest(spark.read.parquet(path), "id", "value")
    assert best.count() == 10 and incremental.errors(best, ["id"]).count() == 1
    rows.select("id").write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # a second run finds nothing new
        incremental.follow(spark, str(tmp_path / "in"), "id long", str(tmp_path / "out"), str(tmp_path / "cp"), lambda d: d, "id").awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10
    spark.range(10, 15).write.mode("append").parquet(str(tmp_path / "in"))
    incremental.follow(spark, str(tmp_path / "in"), "id long", str(tmp_path / "out"), str(tmp_path / "cp"), lambda d: d, "id").awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 15


def test_resampling_keeps_tones():
    for rate, to in ((44_100, 16_000), (8_000, 16_000), (48_000, 16_000), (16_000, 11_025)):
        t, u = np.arange(rate // 2) / rate, np.arange(to // 2) / to
        y = files.resample(np.sin(2 * np.pi * 440 * t) + 0.5 * np.sin(2 * np.pi * 1500 * t + 1), rate, to)
        want = np.sin(2 * np.pi * 440 * u) + 0.5 * np.sin(2 * np.pi * 1500 * u + 1)
        assert abs(len(y) - len(u)) <= 1
        middle = slice(len(u) // 10, -len(u) // 10)
        assert np.abs(y[: len(u)][middle] - want[middle]).max() < 0.01
    high = np.sin(2 * np.pi * 15_000 * np.arange(44_100) / 44_100)
    assert np.abs(files.resample(high, 44_100, 16_000)[500:-500]).max() < 0.02
    assert len(files.resample(np.zeros(0), 8000, 16_000)) == 0


def test_wav_encodings():
    import struct

    def build(code, bits, raw, channels=1, extensible=False, extra=b""):
        form = struct.pack("<HHIIHH", 0xFFFE if extensible else code, channels, 8000, 0, 0, bits)
        if extensible:
            form += struct.pack("<HHIH14s", 22, bits, 0, code, b"")
        body = b"WAVE" + b"fmt " + struct.pack("<I", len(form)) + form + extra + b"data" + struct.pack("<I", len(raw)) + raw
        return b"RIFF" + struct.pack("<I", len(body)) + body

    cases = [(1, 24, (2**22).to_bytes(3, "little") + (-(2**23)).to_bytes(3, "little", signed=True), [0.5, -1]), (3, 32, np.array([0.25, -0.5], "<f4").tobytes(), [0.25, -0.5]), (3, 64, np.array([0.125], "<f8").tobytes(), [0.125]), (1, 32, np.array([2**30], "<i4").tobytes(), [0.5]), (1, 8, bytes([0, 192]), [-1, 0.5])]
    for code, bits, raw, want in cases:
        for extensible in (False, True):
            data = build(code, bits, raw, extensible=extensible, extra=b"LIST" + struct.pack("<I", 3) + b"abc\0")
            rate, x = files.wav_samples(data)
            assert rate == 8000 and x[:, 0].tolist() == want
            assert files.wav_header(data)[:4] == (code, 1, 8000, bits)
    assert files.wav_samples(build(1, 16, np.array([1, 3, 5, 7], "<i2").tobytes(), channels=2))[1].mean(1).tolist() == [2 / 32768, 6 / 32768]
    for bad in (b"", b"RIFFxxxxWAVE", build(7, 8, b"\0"), b"RIFF" + b"\0" * 60):
        with pytest.raises(files.BadAudio):
            files.wav_samples(bad)
