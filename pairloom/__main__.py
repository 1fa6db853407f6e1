"""python -m pairloom COMMAND ...: the stages from a file tree to equal-error rates, each reading and
writing tables (Parquet directories), so that any of them can be run again on its own."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ship
from .functions import binning, durations, names, text
from .operators import encode, features, histograms, metrics, profile, sampling, split, trials
from .sources import files, tables
from .storage import written


def clips_of(manifest: DataFrame) -> DataFrame:
    """Clip rows of a manifest: parsed stems that have audio, with dense ids by path."""
    path = F.concat_ws("/", F.lit(""), "mic_config", "split", "speaker_folder", F.concat("stem", F.lit(".wav")))
    rows = manifest.where("parsed and has_wav").select(path.alias("path"), F.lower("sid").alias("speaker_id"), F.col("meeting").alias("meeting_id"), F.col("mic_config").alias("mic_type"), F.col("split").alias("native_split"), (F.col("end_i") - F.col("begin_i")).alias("duration_cs"))
    return rows.join(encode.path_dictionary((rows, "path")).withColumnRenamed("path_id", "clip_id"), "path")


def cmd_manifest(spark: SparkSession, a: argparse.Namespace) -> None:
    found = files.manifest(spark, files.corpus_root(spark, a.root))
    tables.write_table(found.limit(a.sample) if a.sample else found, a.out, mode="overwrite")


def cmd_clips(spark: SparkSession, a: argparse.Namespace) -> None:
    tables.write_table(clips_of(spark.read.parquet(a.manifest)), a.out, mode="overwrite")


def cmd_profile(spark: SparkSession, a: argparse.Namespace) -> None:
    c = spark.read.parquet(a.clips)
    people = c.withColumn("d", names.decode_speaker(F.col("speaker_id"))).where("d is not null").select("*", "d.gender", "d.location", "d.language")
    found = {
        "durations": profile.duration_summary(c, "duration_cs"),
        "hours": profile.hours_by(c, "duration_cs", "native_split", "mic_type"),
        "counts": profile.counts_by(c, "native_split", "mic_type"),
        "demographics": profile.crosstab(people, "native_split", ["gender", "location", "language"], "speaker_id"),
        "leakage": profile.leakage(c, "native_split", "speaker_id"),
        "feasibility": profile.feasibility(c, "native_split", "mic_type", "speaker_id", "duration_cs"),
        "undecoded": c.where(names.decode_speaker(F.col("speaker_id")).isNull()).select("speaker_id").distinct(),
    }
    for name, df in found.items():
        tables.write_table(df, f"{a.out}/{name}", mode="overwrite")
    for name in found:
        print(tables.markdown(name, spark.read.parquet(f"{a.out}/{name}"), 50))


def cmd_split(spark: SparkSession, a: argparse.Namespace) -> None:
    c = spark.read.parquet(a.clips)
    if a.male or a.female:
        people = c.select("speaker_id", names.gender_code(F.col("speaker_id")).alias("gender")).distinct()
        drawn = split.sample_per_group(people, "gender", {"m": a.male, "f": a.female}, F.xxhash64(F.lit(a.seed), "speaker_id"), "speaker_id")
        tables.write_table(split.remainder(people, drawn, "speaker_id"), f"{a.out}/train_speakers", mode="overwrite")
        c = c.join(drawn.select("speaker_id"), "speaker_id", "left_semi")
    divided = written(split.meeting_split(c), "divided")
    found = {"Enroll": split.enroll_rows(c, divided), "Test": split.test_rows(c, divided), "Meeting_Split_Detail": split.split_detail(c, divided), "Dropped_Speakers": split.dropped_speakers(c)}
    for name, df in found.items():
        tables.write_table(df, f"{a.out}/{name.lower()}", mode="overwrite")
    if a.xlsx:
        sheets = {n: spark.read.parquet(f"{a.out}/{n.lower()}") for n in found}
        tables.write_workbook(spark, a.xlsx, sheets, [(f"{n} rows", f"=COUNTA({n}!A:A)-1") for n in sheets])


def _sides(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(a.enroll), spark.read.parquet(a.test)


def cmd_count(spark: SparkSession, a: argparse.Namespace) -> None:
    e, t = (profile.speaker_meeting_mic(x) for x in _sides(spark, a))
    tables.write_table(trials.count_positives(e, t), f"{a.out}/positives", mode="overwrite")
    tables.write_table(trials.count_negatives(e, t).join(trials.acquaintance(e, t), "gender", "left"), f"{a.out}/negatives", mode="overwrite")
    tables.write_table(trials.meeting_breakdown(e, t), f"{a.out}/meetings", mode="overwrite")
    print("shared meetings:", trials.disjointness(e, t).count())


def cmd_positives(spark: SparkSession, a: argparse.Namespace) -> None:
    out = trials.positive_trials(*_sides(spark, a), columns=(*trials.COLUMNS, "path"))
    tables.write_table(out.withColumn("mic", F.col("test_mic_type")), a.out, mode="overwrite")


def cmd_encode(spark: SparkSession, a: argparse.Namespace) -> None:
    t = spark.read.parquet(a.trials)
    d = written(encode.path_dictionary((t, "enroll_path"), (t, "test_path")), "paths")
    tables.write_csv(d, f"{a.out}/path_lookup", mode="overwrite")
    tables.write_table(encode.encode_trials(t, d), f"{a.out}/trials", a.compression, mode="overwrite")


def cmd_distribution(spark: SparkSession, a: argparse.Namespace) -> None:
    t = spark.read.parquet(a.trials).where("diff_cs is not null").withColumn("seconds", durations.to_seconds(F.col("diff_cs")))
    bins = histograms.equal_width(t, "seconds", a.equal_width_bins)
    found = {"moments": histograms.moments(t, "seconds"), "percentiles": histograms.percentile_grid(t, "seconds", a.percentile_step), "equal_width": bins, "equal_count": histograms.equal_count(t, "seconds", a.quantile_bins), "by_mic": histograms.by_bin_and_mic(t, "seconds", a.equal_width_bins, F.col("mic"))}
    for name, df in found.items():
        tables.write_table(df, f"{a.out}/{name}", mode="overwrite")
    print("bins that do not add up:", histograms.check_bins(bins, found["by_mic"]).count())


def cmd_negatives(spark: SparkSession, a: argparse.Namespace) -> None:
    p = spark.read.parquet(a.positives).where("diff_cs is not null")
    lo, hi = histograms.limits(p, "diff_cs")
    binned = lambda df: df.withColumn("bin", binning.width_bin(F.col("diff_cs").cast("double"), lo, hi, a.bins)).where("bin is not null")
    goals = written(sampling.targets(binned(p), ["bin", "mic"], a.ratio), "targets")
    candidates = binned(trials.negative_candidates(*_sides(spark, a)).withColumn("mic", F.col("test_mic_type")))
    order = sampling.order_key(F.col("enroll_clip_id"), F.col("test_clip_id"), seed=a.seed)
    drawn, seen = sampling.draw(candidates, goals, ["bin", "mic"], order, ["enroll_clip_id", "test_clip_id"])
    tables.write_table(drawn, a.out, mode="overwrite")
    tables.write_table(sampling.report(goals, spark.read.parquet(a.out), seen, ["bin", "mic"]), a.report, mode="overwrite")
    print(tables.markdown("totals", sampling.totals(spark.read.parquet(a.report))))


def cmd_features(spark: SparkSession, a: argparse.Namespace) -> None:
    t, f = spark.read.parquet(a.trials), spark.read.parquet(a.features)
    columns = [c for c in f.columns if c not in (a.key, "error")]
    out = features.feature_diffs(features.attach(t, f, columns, a.key, "enroll_clip_id", "test_clip_id"), columns)
    tables.write_table(out, a.out, mode="overwrite")
    print(tables.markdown("missing", features.missing(spark.read.parquet(a.out), [f"{c}_diff" for c in columns])))


def cmd_cosine(spark: SparkSession, a: argparse.Namespace) -> None:
    both = None
    for path, target in ((a.positives, True), (a.negatives, False)):
        t = spark.read.parquet(path).select("enroll_clip_id", "test_clip_id", "enroll_duration_cs", "test_duration_cs", "mic", F.lit(target).alias("target"))
        both = t if both is None else both.unionByName(t)
    tables.write_table(features.score_cosine(both, spark.read.parquet(a.embeddings), a.key, a.vector, "enroll_clip_id", "test_clip_id"), a.out, mode="overwrite")


def cmd_eer(spark: SparkSession, a: argparse.Namespace) -> None:
    t = spark.read.parquet(a.scored)
    tables.write_csv(metrics.eer_exact(t, a.score, "target", *a.keys).coalesce(1), a.out, mode="overwrite")
    print(tables.markdown("equal-error rates", spark.read.option("header", True).csv(a.out)))


def cmd_eer_by(spark: SparkSession, a: argparse.Namespace) -> None:
    """By duration: the shorter clip, the absolute or signed difference, or both sides' buckets."""
    e, t = F.col("enroll_duration_cs"), F.col("test_duration_cs")
    edges = [float(x) for x in a.edges.split(",")]
    cs, labels = [round(x * 100) for x in edges], text.bucket_labels(edges)
    rows = spark.read.parquet(a.scored)
    if a.both_at_least:
        rows = rows.where((e >= round(a.both_at_least * 100)) & (t >= round(a.both_at_least * 100)))
    bounds = metrics.score_range(rows, a.score)
    if a.by == "matrix":
        marked = rows.withColumns({"enroll_bucket": binning.bucket_label(e, cs, labels), "test_bucket": binning.bucket_label(t, cs, labels)})
        out = metrics.eer_matrix(marked, a.score, "target", "enroll_bucket", "test_bucket", bounds, at_least=a.min_trials)
    else:
        x = {"shorter": durations.shorter_cs(e, t), "abs_diff": durations.abs_diff_cs(e, t), "signed_diff": durations.signed_diff_cs(e, t)}[a.by]
        out = metrics.eer_table(rows.withColumn("bucket", binning.bucket_label(x, cs, labels)), a.score, "target", "bucket", bounds, at_least=a.min_trials)
    tables.write_csv(out.coalesce(1), a.out, mode="overwrite")
    print(tables.markdown("equal-error rates", spark.read.option("header", True).csv(a.out)))


def cmd_kde(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = spark.read.parquet(a.scored)
    out = None
    for target in (True, False):
        some = sampling.take(rows.where(F.col("target") == target), a.sample_size, F.xxhash64(F.lit(a.seed), *rows.columns), ["enroll_clip_id", "test_clip_id"])
        one = metrics.kde(some, a.score).withColumn("target", F.lit(target))
        out = one if out is None else out.unionByName(one)
    tables.write_csv(out.coalesce(1), a.out, mode="overwrite")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="pairloom", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, run, *required: str, **options) -> None:
        p = commands.add_parser(name, help=run.__doc__)
        for r in required:
            p.add_argument(f"--{r.replace('_', '-')}", required=True)
        for o, default in options.items():
            kind = {"type": type(default)} if default is not None and not isinstance(default, list) else {"nargs": "*"} if isinstance(default, list) else {}
            p.add_argument(f"--{o.replace('_', '-')}", default=default, **kind)
        p.set_defaults(run=run)

    command("manifest", cmd_manifest, "root", "out", sample=0)
    command("clips", cmd_clips, "manifest", "out")
    command("profile", cmd_profile, "clips", "out")
    command("split", cmd_split, "clips", "out", male=0, female=0, seed=42, xlsx=None)
    command("count", cmd_count, "enroll", "test", "out")
    command("positives", cmd_positives, "enroll", "test", "out")
    command("encode", cmd_encode, "trials", "out", compression="zstd")
    command("distribution", cmd_distribution, "trials", "out", equal_width_bins=50, quantile_bins=20, percentile_step=5)
    command("negatives", cmd_negatives, "enroll", "test", "positives", "out", "report", ratio=10, bins=50, seed=42)
    command("features", cmd_features, "trials", "features", "out", key="id")
    command("cosine", cmd_cosine, "positives", "negatives", "embeddings", "out", key="clip_id", vector="embedding")
    command("eer", cmd_eer, "scored", "out", score="score", keys=[])
    command("eer-by", cmd_eer_by, "scored", "out", by="shorter", edges="1,2,4", both_at_least=0.0, min_trials=50, score="score")
    command("kde", cmd_kde, "scored", "out", score="score", sample_size=150_000, seed=42)
    return top


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    a.run(ship(SparkSession.builder.appName(f"pairloom {a.command}").getOrCreate()), a)


if __name__ == "__main__":
    main()
