import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairloom.functions import binning, durations, names, text, vectors
from pairloom.functions.pairs import resolve_pair_columns
from pairloom.operators import encode, histograms, metrics, parity, profile, ranks, sampling, split, trials


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def brute_eer(scores, target):
    """Walk the sorted scores one by one."""
    order = sorted(range(len(scores)), key=lambda i: (-scores[i], not target[i]))
    nt, nn, t, n, best = sum(target), len(target) - sum(target), 0, 0, None
    for i in order:
        t, n = t + target[i], n + (not target[i])
        gap = abs(n * nt - (nt - t) * nn)
        if best is None or gap < best[0]:
            best = (gap, (n / nn + (nt - t) / nt) / 2, scores[i])
    return best[1:]


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(-3, 3), st.booleans()), min_size=2, max_size=30).filter(lambda x: len({t for _, t in x}) == 2), st.sampled_from([1, 3, 4096]))
def test_exact_eer_with_ties(spark, rows, buckets):
    df = spark.createDataFrame([(float(s), t) for s, t in rows], "s double, t boolean")
    got = metrics.eer_exact(df, "s", "t", buckets=buckets).first()
    eer, threshold = brute_eer([float(s) for s, _ in rows], [t for _, t in rows])
    assert got["eer"] == pytest.approx(eer) and got["threshold"] == threshold


def test_exact_eer_of_many_scores_and_groups(spark):
    r = np.random.default_rng(3)
    rows = [(g, float(x), bool(t)) for g in ("a", "b") for t in (0, 1) for x in r.normal(t * 1.5, 1, 400 + 300 * t)]
    got = {x["g"]: x for x in metrics.eer_exact(spark.createDataFrame(rows, "g string, s double, t boolean"), "s", "t", "g").collect()}
    for g in ("a", "b"):
        eer, threshold = brute_eer([s for h, s, _ in rows if h == g], [t for h, _, t in rows if h == g])
        assert got[g]["eer"] == pytest.approx(eer) and got[g]["threshold"] == threshold


def test_eer_without_a_kind_and_null_scores(spark):
    df = spark.createDataFrame([(1.0, True), (None, False)], "s double, t boolean")
    got = metrics.eer_exact(df, "s", "t").first()
    assert got["n_nontarget"] == 0 and got["eer"] is None


def test_exact_sample_sizes_do_not_depend_on_partitions(spark):
    c = spark.range(5000).select(F.col("id").alias("a"), (F.col("id") % 3).alias("b"), (F.col("id") % 2).alias("mic"))
    goals = spark.createDataFrame([(0, 0, 100), (1, 1, 5000), (2, 0, 0)], "b long, mic long, target long")
    order = sampling.order_key(F.col("a"), F.col("b"))
    got = [sampling.sample(c.repartition(n), goals, ["b", "mic"], order, ["a"]).select("a").orderBy("a").toPandas().a.tolist() for n in (1, 7)]
    assert got[0] == got[1]
    assert len(got[0]) == 100 + c.where("b = 1 and mic = 1").count()


def test_counts_of_pairs_equal_pairs(spark):
    """Counts from sums against the pairs themselves: two genders, uneven numbers, a speaker on one side
    only, meetings that several speakers and both sides have."""
    r = np.random.default_rng(5)
    people = ["feo001", "feo002", "fed003", "mio004", "mio005", "mtd006"]
    side = lambda who, mics: [(p, f"room{r.integers(4)}", str(r.choice(mics))) for p in who for _ in range(int(r.integers(2, 30)))]
    enroll, test = side(people[:5], ["ihm"]), side(people[1:], ["ihm", "sdm"])
    kind = "speaker_id string, meeting_id string, mic_type string"
    ec, tc = (profile.speaker_meeting_mic(spark.createDataFrame(x, kind)) for x in (enroll, test))
    pairs = [(a, b) for a in enroll for b in test]
    own = [(a, b) for a, b in pairs if a[0] == b[0]]
    for row in trials.count_positives(ec, tc).collect():
        mine = [(a, b) for a, b in own if a[0] == row["speaker_id"]]
        apart = [b[2] for a, b in mine if a[1] != b[1]]
        assert (row["raw"], row["positives"], row["ihm_ihm"], row["ihm_sdm"]) == (len(mine), len(apart), apart.count("ihm"), apart.count("sdm"))
    others = [(a, b) for a, b in pairs if a[0] != b[0] and a[0][0] == b[0][0]]
    for row in trials.count_negatives(ec, tc).collect():
        mine = [(a, b) for a, b in others if a[0][0] == row["gender"]]
        assert (row["raw"], row["excluded"]) == (len(mine), sum(a[1] == b[1] for a, b in mine)) and row["surviving"] == row["raw"] - row["excluded"]
    met = {frozenset((a[0], b[0])) for a, b in others if a[1] == b[1]}
    for row in trials.acquaintance(ec, tc).collect():
        n = sum(p[0] == row["gender"] for p in people)
        assert row["teammate_pairs"] == sum(min(m)[0] == row["gender"] for m in met) and row["teammate_pairs"] + row["stranger_pairs"] == n * (n - 1) // 2
    shared = {(a[0], a[1]) for a in enroll} & {(b[0], b[1]) for b in test}
    assert trials.disjointness(ec, tc).count() == len(shared) > 0


def test_meeting_split_is_disjoint_and_rounds_down(spark):
    rows = [("mio001", m, "ihm") for m in "cab"] + [("fio002", "a", "ihm"), ("mio003", None, "ihm")]
    c = spark.createDataFrame(rows, "speaker_id string, meeting_id string, mic_type string")
    got = {r["meeting_id"]: r["side"] for r in split.meeting_split(c).collect()}
    assert got == {"a": "enroll", "b": "test", "c": "test"}
    assert {r["speaker_id"] for r in split.dropped_speakers(c).collect()} == {"fio002", "mio003"}


def test_names(spark):
    s = lambda x: value(spark, names.parse_stem(F.lit(x)))
    assert s("fee041_es2011a_dev_h00_0003427-0003714").asDict() == {"sid": "fee041", "meeting": "es2011a", "split_in_name": "dev", "miccode": "h00", "has_segment": True, "begin_i": 3427, "end_i": 3714, "duration_from_name_s": 2.87, "zero_duration": False, "meeting_series": "ES", "mic_canonical": "ihm", "headset_channel": 0}
    assert s("a_b_eval_sdm").has_segment is False and s("a_b_eval_sdm").begin_i is None and s("a_b_other_sdm") is None and s("") is None
    assert s("a_b_eval_H12_1-1").zero_duration and s("a_b_eval_H12_1-1").headset_channel == 12 and s("a_b_eval_q_1-2").mic_canonical == "unknown_mic_code"
    d = lambda x: value(spark, names.decode_speaker(F.lit(x)))
    assert tuple(d("MTD013pm")) == ("Male", "TNO", "Dutch", "013", "pm") and d("mio1").role_suffix is None
    assert d("xio001") is None and d("mi") is None and d("mio") is None and d("mio1-") is None
    n = lambda f, *x: value(spark, f(*map(F.lit, x)))
    assert n(names.shorten_path, "/x/ihm/a/ihm/b.wav", "ihm") == "/ihm/a/ihm/b.wav" and n(names.shorten_path, "x.wav", "ihm") == "x.wav"
    assert n(names.agnostic_key, "p/mtd013pm_ts3004c_dev_h00_0243804.wav") == "p/mtd013pm_ts3004c_dev_0243804" and n(names.agnostic_key, "p/a_b.wav") == "p/a_b.wav"
    assert n(names.annotation_key, "C_ES1_H00_FEE041_0001_0002", "dev") == "fee041_es1_dev_0001-0002" and n(names.annotation_key, "a_b_c", "dev") is None
    assert value(spark, names.renamed(F.lit("dev_corp_es2011a_h00_fee041_0003427_0003714.wav"), "corp")) == "fee041_es2011a_dev_h00_0003427-0003714.wav"
    assert value(spark, names.renamed(F.lit("dev_corp_es2011a_h00_fee041_1.wav"), "corp")) is None and value(spark, names.renamed(F.lit("x.wav"), "corp")) is None
    assert value(spark, names.archive_url("https://h/{split}/{id}.tar.gz", split=F.lit("dev"), id=F.lit("es1"))) == "https://h/dev/es1.tar.gz"


def test_durations_and_bins(spark):
    v = lambda c: value(spark, c)
    assert v(durations.duration_cs(F.lit("a_0000010-0000005.WAV"))) == -5 and v(durations.positive_cs(F.lit("a_10-5.wav"))) is None
    assert [v(durations.to_cs(F.lit(x))) for x in ("1.005", "", "x", "0.29")] == [101, None, None, 29] or v(durations.to_cs(F.lit("0.29"))) == 29
    assert v(durations.shorter_cs(F.lit(None).cast("int"), F.lit(3))) is None
    assert [v(durations.duration_bucket(F.lit(x))) for x in (0.99, 1.0, 3.0, 10.0)] == ["<1s (likely backchannel)", "1-3s", "3-10s", ">10s"]
    assert [v(binning.width_bin(F.lit(x), 0.0, 10.0, 5)) for x in (-1.0, 0.0, 1.99, 2.0, 10.0, 10.01)] == [0, 0, 0, 1, 4, None]
    assert [v(binning.edge_bin(F.lit(x), F.array(*map(F.lit, (0.0, 1.0, 5.0))))) for x in (-1.0, 0.0, 1.0, 5.0, 5.1)] == [0, 0, 1, 1, None]
    assert [v(binning.score_bin(F.lit(x), -1.0, 1.0, 4)) for x in (-2.0, -1.0, 0.0, 0.99, 9.0)] == [0, 0, 2, 3, 3]
    assert text.bucket_labels([0.5, 1, 2]) == ["<0.5s", "0.5-1s", "1-2s", ">=2s"]
    assert v(text.human_size(F.lit(3_410_000))) == "3.25 MB" and v(text.ratio(F.lit(1), F.lit(0))) == 0 and v(text.one_to(F.lit(2), F.lit(20))) == "1 : 10.00"


def test_vectors(spark):
    v = lambda c: value(spark, c)
    a = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    assert v(vectors.cosine(a(3, 4), a(4, 3))) == pytest.approx(24 / 25) and v(vectors.cosine(a(0, 0), a(1, 1))) is None
    assert v(vectors.tile(a(1, 2, 3), 7)) == [1, 2, 3, 1, 2, 3, 1] and v(vectors.tile(a(1, 2), 1)) == [1, 2]
    assert v(vectors.centre_and_scale(a(1, 3), 1.0)) == [-1, 1] and v(vectors.centre_and_scale(a(2, 2))) == [0, 0]
    assert v(vectors.mono(F.array(a(1, 3), a(2, 2)))) == [2, 2] and v(vectors.pad(a(1), F.lit(3))) == [1, 0, 0]


def test_histograms(spark):
    x = np.random.default_rng(5).integers(0, 60, 500).astype(float)
    df = spark.createDataFrame([(v,) for v in x.tolist()], "x double")
    n, edges = np.histogram(x, bins=10)
    got = histograms.equal_width(df, "x", 10).orderBy("index").collect()
    assert [r["count"] for r in got] == n.tolist() and [r["lower"] for r in got] == [round(e, 4) for e in edges[:-1]]
    e = np.unique(np.percentile(x, np.linspace(0, 100, 21)))
    got = histograms.equal_count(df, "x", 20).orderBy("index").collect()
    assert [r["count"] for r in got] == np.histogram(x, bins=e)[0].tolist()
    assert sum(r["density"] * (r["upper"] - r["lower"]) for r in histograms.density(df, "x", 20).collect()) == pytest.approx(1, abs=1e-3)
    assert histograms.equal_width(df.where("x < 0"), "x", 10).count() == 0


def test_dictionary_is_dense_and_strict(spark):
    df = spark.createDataFrame([(f"/p{i % 50:03d}",) for i in range(200)] + [(None,)], "path string")
    d = encode.path_dictionary((df, "path"), partitions=3)
    assert [tuple(r) for r in d.orderBy("path_id").collect()] == [(i, f"/p{i:03d}") for i in range(50)]
    pairs = spark.createDataFrame([("/p001", "/p002", 7), ("/p003", "/p001", None)], "enroll_path string, test_path string, diff_cs int")
    out = encode.encode_trials(pairs, d)
    assert dict(out.dtypes)["duration_diff_cs"] == "smallint" and sorted(r[2] for r in out.collect()) == [-1, 7]
    assert sorted(map(str, encode.decode_trials(out, d).collect())) == sorted(map(str, pairs.collect()))
    with pytest.raises(Exception, match="no id for"):
        encode.encode_trials(pairs.withColumn("test_path", F.lit("?")), d, 10).collect()
    assert encode.unknown_paths(df.withColumn("path", F.lit("?")).limit(1), d, "path").count() == 1


def test_parity_and_plans(spark):
    f = spark.createDataFrame([("a/ihm/dev/x/s1_m_dev_h00_1-2.wav",), ("a/ihm/dev/s2/s2_m_dev_h00_1-2.wav",), ("odd.txt",)], "path string")
    plan = {r["source"]: (r["target"], r["action"]) for r in parity.move_plan(f, "path", "corp").collect()}
    assert plan["a/ihm/dev/x/s1_m_dev_h00_1-2.wav"] == ("a/ihm/dev/s1/s1_m_dev_h00_1-2.wav", "move") and plan["odd.txt"][1] == "skip" and plan["a/ihm/dev/s2/s2_m_dev_h00_1-2.wav"][1] == "keep"
    folders = spark.createDataFrame([("a",), ("a/ihm",), ("b",), ("b/c",)], "folder string")
    assert [r[0] for r in parity.empty_folders(folders, f, "folder", "path").collect()] == ["b/c", "b"]
    with pytest.raises(Exception, match="no match for"):
        parity.strict_join(f, f.limit(1).withColumn("y", F.lit(1)), "path").collect()


def test_pair_columns():
    assert resolve_pair_columns(["Enroll_Path", "test_path", "enroll_id"]) == ("Enroll_Path", "test_path", "path")
    assert resolve_pair_columns(["enroll_id", "test_id", "x"]) == ("enroll_id", "test_id", "id")
    with pytest.raises(ValueError):
        resolve_pair_columns(["enroll_path", "enroll2_path", "test_path"])


def test_percentiles_are_exact(spark):
    r = np.random.default_rng(9)
    for x in (r.normal(size=5000), r.integers(0, 7, 3000).astype(float), np.r_[r.random(2000), 1e9], np.array([3.5])):
        df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "x double")
        shares = [0.0, 0.0001, 0.25, 0.5, 0.9, 0.9999, 1.0]
        assert ranks.percentiles(df.repartition(5), "x", shares) == pytest.approx(np.percentile(x, [100 * s for s in shares]).tolist(), rel=1e-12)
    assert ranks.percentiles(df.limit(0), "x", [0.5]) == [None]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_plan_gathers_all_values_in_one_task(spark):
    df = spark.range(10_000).select(F.rand(1).alias("x"), (F.col("id") % 2 == 0).alias("t"))
    bounds = metrics.score_range(df, "x")
    for out in (histograms.percentile_grid(df, "x"), histograms.moments(df, "x"), histograms.equal_count(df, "x"), histograms.density(df, "x"), metrics.kde(df, "x"), bounds, metrics.eer_exact(df, "x", "t")):
        plan = _plan(out)
        assert "percentile(" not in plan and "median(" not in plan and "CartesianProduct" not in plan
    c = df.select((F.rand(2) * 1e6).cast("long").alias("a"), F.lit(1).alias("b"))
    drawn, seen = sampling.draw(c, spark.createDataFrame([(1, 50)], "b int, target long"), ["b"], sampling.order_key(F.col("a")), ["a"])
    assert drawn.count() == 50 and seen.first()["seen"] == 10_000 and "rand(" not in _plan(drawn)  # the candidates are not made again


def test_eer_with_nan_outliers_and_ties(spark):
    r = np.random.default_rng(11)
    for extra in ([], [(1e9, False)], [(-1e9, True)], [(float("nan"), True), (float("nan"), False), (None, True)]):
        rows = [(float(round(s, 2)), bool(t)) for s, t in zip(r.normal(size=4000), r.random(4000) < 0.3)] + extra
        got = metrics.eer_exact(spark.createDataFrame(rows, "s double, t boolean"), "s", "t").first()
        known = sorted([x for x in rows if x[0] is not None and x[0] == x[0]], key=lambda x: (-x[0], not x[1]))
        nt, nn = sum(t for _, t in known), sum(not t for _, t in known)
        a = b = 0
        best = None
        for s, t in known:
            a, b = a + t, b + (not t)
            gap = abs(b * nt - (nt - a) * nn)
            if best is None or gap < best[0]:
                best = (gap, (b / nn + (nt - a) / nt) / 2, s)
        assert (got["n_target"], got["n_nontarget"]) == (nt, nn) and got["eer"] == pytest.approx(best[1]) and got["threshold"] == best[2]


def test_kde_of_many_values(spark, monkeypatch):
    df = spark.createDataFrame([(float(v),) for v in np.random.default_rng(2).normal(size=3000)], "x double")
    exact = {r["i"]: r["density"] for r in metrics.kde(df, "x", 50).collect()}
    monkeypatch.setattr(metrics, "KDE_VALUES", 500)
    assert all(abs(r["density"] - exact[r["i"]]) < 2e-3 for r in metrics.kde(df, "x", 50).collect())
