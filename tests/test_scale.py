"""What holds at sizes where pairs of clips cannot be kept, and where a corpus has many small files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom import storage
from pairloom.operators import blocks, features, metrics, ranks, trials
from pairloom.sources import files

CLIPS = "clip_id long, speaker_id string, meeting_id string, mic_type string, duration_cs int"


def _rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_blocks_give_the_trials_and_scores_of_the_joins(spark, monkeypatch):
    r = np.random.default_rng(5)
    speakers = ["mio001", "mio002", "fee003", "fee004", "x5", "x6"]  # two of no gender
    clip = lambda i: (i, speakers[r.integers(6)] if i % 19 else None, f"es{r.integers(4)}" if i % 13 else None, "ihm" if i % 2 else "sdm", int(r.integers(900)) if i % 11 else None)
    rows = [clip(i) for i in range(160)]
    enroll, test = (spark.createDataFrame(part, CLIPS) for part in (rows[:70], rows[70:]))
    vector = lambda i: None if i % 17 == 3 else [0.0] * 4 if i % 23 == 5 else r.normal(size=3 if i % 29 == 7 else 4).tolist()
    v = spark.createDataFrame([(i, vector(i)) for i in range(158)], "id long, v array<float>")  # two have no row
    both = trials.positive_trials(enroll, test).withColumn("target", F.lit(True)).unionByName(trials.negative_candidates(enroll, test).drop("gender").withColumn("target", F.lit(False)))
    wanted = ["enroll_clip_id", "test_mic_type", "test_clip_id", "enroll_duration_cs", "target"]
    want = features.score_cosine(both, v, "id", "v", "enroll_clip_id", "test_clip_id").select(*wanted, F.round("score", 9))
    monkeypatch.setattr(blocks, "BLOCK", 16)
    got = blocks.scored_trials(enroll, test, v, "id", "v", tuple(wanted[:-1]), 9)
    assert got.columns == [*wanted, "score"] and _rows(got) == _rows(want)
    assert blocks.scored_trials(enroll.limit(0), test, v, "id", "v").count() == 0


def test_no_trial_is_shuffled_for_its_score(spark, sf_dir):
    from pairloom.plans import clips

    plan = clips.scored(spark, sf_dir, "enroll_clip_id", "test_clip_id")._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Exchange") and "ArrowEvalPython" not in plan


def test_narrowed_percentiles_are_exact_whatever_the_range(spark):
    r = np.random.default_rng(9)
    shares = [0.0, 0.0001, 0.25, 0.5, 0.9999, 1.0]
    for x in (r.normal(size=3000), r.integers(0, 7, 2000).astype(float), np.r_[r.random(2000), 1e300, -1e300, np.inf, -np.inf]):
        df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "x double")
        for likely in ((-1.0, 1.0), (-1e308, 1e308), (50.0, 51.0)):
            assert ranks.narrowed(df, "x", shares[1:-1], *likely) == ranks.percentiles(df, "x", shares[1:-1])
    assert ranks.narrowed(df.limit(0), "x", [0.5], -1.0, 1.0) == [None]


@pytest.mark.parametrize("likely", [(-1.0, 1.0), (-40.0, 60.0), (7.0, 8.0)])
def test_narrowed_error_rates_are_exact_whatever_the_range(spark, likely):
    r = np.random.default_rng(3)
    rows = [(g, float(x), bool(t)) for g in ("a", "b", None) for t in (0, 1) for x in np.round(r.normal(t * 0.4, 0.5, 300 + 200 * t), 2)]
    rows += [("one", 0.1, True), ("apart", 0.9, True), ("apart", -0.9, False), ("wrong", -0.9, True), ("wrong", 0.9, False), ("a", float("nan"), True), ("a", 1e300, False)]
    df = spark.createDataFrame(rows, "g string, s double, t boolean")
    for frame, keys in ((df, ["g"]), (df.where("g = 'a'"), []), (df.where("g = 'one'"), [])):
        assert _rows(metrics.eer_exact(frame.where("g is not null") if keys else frame, "s", "t", *keys, likely=likely)) == _rows(metrics.eer_exact(frame.where("g is not null") if keys else frame, "s", "t", *keys))


def test_error_rates_keep_no_trials(spark, sf_dir, monkeypatch):
    from pairloom.plans import catalogue

    kept = []
    for module in (metrics, ranks, blocks):
        monkeypatch.setattr(module, "written", lambda df, name, f=module.written: kept.append(out := f(df, name)) or out)
    for name in ("eer_by_mic", "eer_exact_cosine", "eer_hist"):
        catalogue.QUERIES[name](spark, sf_dir).collect()
    assert max(k.count() for k in kept) < 9_000 < 11_230  # the trials


def test_many_small_files_are_few_tasks(spark, tmp_path):
    n = 600
    rows = spark.range(n).select(F.format_string("a/b%d/f%d.wav", F.col("id") % 3, "id").alias("path"), F.col("id").cast("string").cast("binary").alias("content"))
    storage.put_files(rows, f"file://{tmp_path}")
    storage.put_files(rows, f"file://{tmp_path}")  # a second go replaces
    assert files.list_files(spark, str(tmp_path)).rdd.getNumPartitions() <= storage.n_partitions(spark)
    found = files.read_files(spark, str(tmp_path)).collect()
    assert sorted(int(r["content"]) for r in found) == list(range(n)) and all(f"f{int(r['content'])}.wav" in r["path"] for r in found)
    assert {p.suffix for p in tmp_path.rglob("*") if p.is_file()} == {".wav"}


def test_files_elsewhere_are_put_by_the_driver(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "is_local", lambda *_: False)
    rows = spark.range(600).select(F.format_string("a/f%d.txt", "id").alias("path"), F.col("id").cast("string").cast("binary").alias("content"))
    storage.put_files(rows, f"file://{tmp_path}")
    assert {p.name: p.read_text() for p in (tmp_path / "a").glob("*.txt")} == {f"f{i}.txt": str(i) for i in range(600)}


def test_the_driver_writes_no_file_of_a_corpus(spark, sf_dir, monkeypatch):
    from pairloom.plans import stored

    monkeypatch.setattr(stored, "_corpora", {})
    monkeypatch.setattr(stored, "put", None)
    assert stored.corpus_manifest(spark, sf_dir).count() == 500
    assert stored.corpus_listing(spark, sf_dir).rdd.getNumPartitions() <= storage.n_partitions(spark)


@pytest.mark.parametrize("local", [True, False])
def test_archives_of_bounded_size_have_all_members(spark, tmp_path, monkeypatch, local):
    for name, most in (("TAR_BYTES", 20_000), ("HANDED_BYTES", 3_000), ("HANDED", 7)):
        monkeypatch.setattr(files, name, most)
    for module in (files, storage):
        monkeypatch.setattr(module, "is_local", lambda *_: local)
    rows = spark.range(200).select(F.format_string("x/f%d.wav", "id").alias("path"), F.repeat(F.lit("ab"), F.col("id").cast("int")).cast("binary").alias("content"))
    files.write_tars(rows.repartition(3), f"file://{tmp_path}/tars")
    assert len(list((tmp_path / "tars").glob("*.tar.gz"))) > 6
    assert _rows(files.read_tar(spark, str(tmp_path / "tars")).select("member", F.length("content"))) == sorted(((f"f{i}.wav", 2 * i) for i in range(200)), key=str)


def test_trials_are_read_once_for_their_histogram(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(len(b))
            yield b

    r = np.random.default_rng(1)
    rows = spark.createDataFrame([(float(x), bool(i % 2), "ihm" if i % 3 else "sdm") for i, x in enumerate(r.normal(size=900))], "score double, target boolean, mic string")
    bounds = spark.createDataFrame([(-2.0, 2.0)], "lo double, hi double")
    assert metrics.eer_overall(rows.mapInPandas(seen, rows.schema), "score", "target", bounds).count() == 3 and read.value == 900
