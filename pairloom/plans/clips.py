"""Clip tables over the generated data: `clips` from embeddings, small enough to pair, and `utterances`
from lineitem, large and only counted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocks, split, trials

#: One text for both engines.
CLIPS_SQL = """SELECT vec_id AS clip_id, label, embedding, mic_type, native_split, speaker_id, meeting_id, duration_cs,
  concat('/', mic_type, '/', native_split, '/', speaker_id, '/', speaker_id, '_', meeting_id, '_', native_split, '_',
    CASE WHEN mic_type = 'sdm' THEN 'sdm' ELSE 'h00' END, '_', lpad(CAST(begin_cs AS VARCHAR(10)), 7, '0'), '-',
    lpad(CAST(begin_cs + duration_cs AS VARCHAR(10)), 7, '0'), '.wav') AS path
FROM (SELECT vec_id, label, embedding,
  CASE WHEN CAST(floor(vec_id / 4) AS BIGINT) % 2 = 0 THEN 'ihm' ELSE 'sdm' END AS mic_type,
  CASE vec_id % 5 WHEN 0 THEN 'dev' WHEN 1 THEN 'eval' ELSE 'train' END AS native_split,
  concat(CASE WHEN label % 2 = 0 THEN 'm' ELSE 'f' END,
    CASE label % 3 WHEN 0 THEN 'i' WHEN 1 THEN 'e' ELSE 't' END,
    CASE label % 3 WHEN 0 THEN 'o' WHEN 1 THEN 'e' ELSE 'd' END,
    lpad(CAST(label AS VARCHAR(10)), 3, '0')) AS speaker_id,
  CASE WHEN label = 9 THEN 'es2009a' ELSE concat('es200', CAST((vec_id % 4 + label) % 7 AS VARCHAR(10)), 'a') END AS meeting_id,
  CAST((vec_id * 7919) % 3300 + 2 AS INT) AS duration_cs,
  vec_id * 10 AS begin_cs
FROM {embeddings})"""

UTTERANCES_SQL = """SELECT CAST(l_suppkey AS VARCHAR(20)) AS supplier, l_suppkey,
  concat(CASE WHEN l_suppkey % 2 = 0 THEN 'm' ELSE 'f' END, CASE l_suppkey % 3 WHEN 0 THEN 'i' WHEN 1 THEN 'e' ELSE 't' END,
    CASE l_suppkey % 3 WHEN 0 THEN 'o' WHEN 1 THEN 'e' ELSE 'd' END, lpad(CAST(l_suppkey AS VARCHAR(10)), 5, '0')) AS speaker_id,
  concat('m', CAST(year(l_shipdate) * 100 + month(l_shipdate) AS VARCHAR(10))) AS meeting_id,
  CASE WHEN l_linestatus = 'F' THEN 'ihm' ELSE 'sdm' END AS mic_type,
  CASE l_returnflag WHEN 'A' THEN 'dev' WHEN 'R' THEN 'eval' ELSE 'train' END AS native_split,
  CAST(l_quantity * 100 AS INT) AS duration_cs, l_extendedprice AS price
FROM {lineitem}"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CLIPS_SQL, embeddings=table(spark, sf_dir, "embeddings"))


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(UTTERANCES_SQL, lineitem=table(spark, sf_dir, "lineitem"))


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Enroll and test clips."""
    c = clips(spark, sf_dir)
    divided = split.meeting_split(c)
    return split.enroll_rows(c, divided), split.test_rows(c, divided)


def positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trials.positive_trials(*sides(spark, sf_dir)).withColumn("mic", F.col("test_mic_type"))


def negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trials.negative_candidates(*sides(spark, sf_dir), salt=4).withColumn("mic", F.col("test_mic_type"))


def scored(spark: SparkSession, sf_dir: str, *columns: str, decimals: int | None = None) -> DataFrame:
    """Positive and negative trials with target (boolean), the cosine of their clips as score, and these
    columns of either clip."""
    return blocks.scored_trials(*sides(spark, sf_dir), table(spark, sf_dir, "embeddings"), "vec_id", "embedding", columns, decimals)


# The same steps in SQL, as common table expressions for the oracle.
CTE = {
    "clips": CLIPS_SQL.format(embeddings="embeddings"),
    "utterances": UTTERANCES_SQL.format(lineitem="lineitem"),
    "meetings": "SELECT DISTINCT speaker_id, meeting_id FROM clips",
    "divided": """SELECT speaker_id, meeting_id, n_meetings, CASE WHEN r <= floor(n_meetings / 2) THEN 'enroll' ELSE 'test' END AS side FROM
  (SELECT *, row_number() OVER (PARTITION BY speaker_id ORDER BY meeting_id) AS r, count(*) OVER (PARTITION BY speaker_id) AS n_meetings FROM meetings)
  WHERE n_meetings >= 2""",
    "enroll": "SELECT c.* FROM clips c SEMI JOIN (SELECT * FROM divided WHERE side = 'enroll') d ON c.speaker_id = d.speaker_id AND c.meeting_id = d.meeting_id WHERE mic_type = 'ihm'",
    "test": "SELECT c.* FROM clips c SEMI JOIN (SELECT * FROM divided WHERE side = 'test') d ON c.speaker_id = d.speaker_id AND c.meeting_id = d.meeting_id",
    "positives": """SELECT e.clip_id AS enroll_clip_id, t.clip_id AS test_clip_id, e.speaker_id AS enroll_speaker_id, t.speaker_id AS test_speaker_id, e.path AS enroll_path, t.path AS test_path,
  e.duration_cs AS enroll_duration_cs, t.duration_cs AS test_duration_cs, t.mic_type AS mic, abs(e.duration_cs - t.duration_cs) AS diff_cs FROM enroll e JOIN test t ON e.speaker_id = t.speaker_id""",
    "candidates": """SELECT e.clip_id AS enroll_clip_id, t.clip_id AS test_clip_id, e.speaker_id AS enroll_speaker_id, t.speaker_id AS test_speaker_id, e.path AS enroll_path, t.path AS test_path,
  e.duration_cs AS enroll_duration_cs, t.duration_cs AS test_duration_cs, t.mic_type AS mic, abs(e.duration_cs - t.duration_cs) AS diff_cs FROM enroll e
  JOIN test t ON left(e.speaker_id, 1) = left(t.speaker_id, 1) AND e.speaker_id <> t.speaker_id AND e.meeting_id <> t.meeting_id""",
    "dots": "SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings",
    "trials": "SELECT *, true AS target FROM positives UNION ALL SELECT *, false AS target FROM candidates",
    "scored": """SELECT p.*, list_reduce(list_prepend(0.0::DOUBLE, list_transform(list_zip(a.v, b.v), lambda x: x[1] * x[2])), lambda s, x: s + x)
  / (sqrt(list_reduce(list_prepend(0.0::DOUBLE, list_transform(a.v, lambda x: x * x)), lambda s, x: s + x)) * sqrt(list_reduce(list_prepend(0.0::DOUBLE, list_transform(b.v, lambda x: x * x)), lambda s, x: s + x))) AS score
  FROM trials p JOIN dots a ON a.vec_id = p.enroll_clip_id JOIN dots b ON b.vec_id = p.test_clip_id""",
}
_NEEDS = {"meetings": ["clips"], "divided": ["meetings"], "enroll": ["clips", "divided"], "test": ["clips", "divided"], "positives": ["enroll", "test"], "candidates": ["enroll", "test"], "trials": ["positives", "candidates"], "scored": ["trials", "dots"]}


def with_(*names: str, **more: str) -> str:
    """'WITH ...' of the named steps, what they need, and further ones in order."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in _NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    steps = [f"{n} AS ({CTE[n]})" for n in order] + [f"{n} AS ({sql})" for n, sql in more.items()]
    return "WITH " + ",\n".join(steps) + "\n"
