import wave

import pytest

from pairloom import __main__ as cli
from pairloom.plans import clips


@pytest.fixture()
def at(tmp_path):
    return lambda name: str(tmp_path / name)


def test_from_clips_to_equal_error_rates(spark, sf_dir, at, capsys):
    clips.clips(spark, sf_dir).write.parquet(at("clips"))
    run = lambda *args: cli.main(list(args))
    run("profile", "--clips", at("clips"), "--out", at("profile"))
    run("split", "--clips", at("clips"), "--out", at("split"), "--xlsx", at("split.xlsx"))
    sides = ["--enroll", at("split/enroll"), "--test", at("split/test")]
    run("count", *sides, "--out", at("count"))
    assert "shared meetings: 0" in capsys.readouterr().out
    run("positives", *sides, "--out", at("pos"))
    n = spark.read.parquet(at("pos")).count()
    assert n == spark.read.parquet(at("count/positives")).agg({"positives": "sum"}).first()[0] == 2586
    run("encode", "--trials", at("pos"), "--out", at("encoded"))
    assert spark.read.parquet(at("encoded/trials")).count() == n
    run("distribution", "--trials", at("pos"), "--out", at("dist"))
    run("negatives", *sides, "--positives", at("pos"), "--out", at("neg"), "--report", at("report"), "--ratio", "1", "--bins", "5")
    assert "bins that do not add up: 0" in capsys.readouterr().out and spark.read.parquet(at("neg")).count() == n
    run("cosine", "--positives", at("pos"), "--negatives", at("neg"), "--embeddings", at("clips"), "--out", at("scored"))
    run("eer", "--scored", at("scored"), "--out", at("eer"), "--keys", "mic")
    run("eer-by", "--scored", at("scored"), "--out", at("matrix"), "--by", "matrix")
    run("eer-by", "--scored", at("scored"), "--out", at("diff"), "--by", "abs_diff", "--edges", "0.5,1,2,4", "--both-at-least", "4")
    run("kde", "--scored", at("scored"), "--out", at("kde"), "--sample-size", "500")
    eer = spark.read.option("header", True).option("inferSchema", True).csv(at("eer")).collect()
    assert {r["mic"] for r in eer} == {"ihm", "sdm"} and all(0 <= r["eer"] <= 1 for r in eer)
    assert spark.read.option("header", True).csv(at("kde")).count() == 800


def test_from_files_to_clips(spark, tmp_path, at):
    folder = tmp_path / "audio" / "sdm" / "dev" / "fee041"
    folder.mkdir(parents=True)
    for k in range(3):
        with wave.open(str(folder / f"fee041_es2011a_dev_h00_000000{k}-0000100.wav"), "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(2)
            w.setframerate(16_000)
            w.writeframes(b"\0\0" * 100)
    cli.main(["manifest", "--root", str(tmp_path), "--out", at("m")])
    cli.main(["clips", "--manifest", at("m"), "--out", at("c")])
    got = spark.read.parquet(at("c")).orderBy("clip_id").collect()
    assert [r["clip_id"] for r in got] == [0, 1, 2] and got[1]["duration_cs"] == 99 and got[0]["mic_type"] == "sdm"
