"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, lm, media, packing, pii, quality, sharding, simhash, urls
from .common import table

TOKENIZER = "word_bpe_49k.json"
SHARDS = {k: 1.0 for k in range(16)}
GROWN = {k: 1.0 for k in range(17)}
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.linked_documents(table(spark, sf_dir, "documents"), k=3, radius=2)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "links")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return chat.read_back(chat.format_chat(turns.unionByName(extra), tokenizer_path=tokenizer_path()))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"cast(size(filter(base, c -> c.kind = {i})) as long)").alias(f"n_{k}") for i, k in enumerate(pii.BASE)]
    return found.select("doc_id", *counts, F.sha2(pii.joined("base").cast("binary"), 256).alias("base_sha256"), pii.joined("spans").alias("spans"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents")).withColumn("perplexity", F.round("perplexity", 3))


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_pieces(table(spark, sf_dir, "documents"), tokenizer_path()))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media.describe_media(media.encode_media(table(spark, sf_dir, "documents")))
    pairs = F.transform(F.arrays_zip("times", "codes"), lambda x: F.concat_ws(":", x["times"].cast("string"), F.lower(F.hex(x["codes"]))))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.array_join(pairs, ",").alias("feature"))


def op8_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = sharding.shard_records(docs, "doc_id", SHARDS, GROWN, ["size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return urls.filter_urls(table(spark, sf_dir, "pages"), rules)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {f.__name__: f for f in (op1_simhash_dedup, op2_chat_format, op3_pii, op4_decontaminate, op5_lm_score, op6_pack, op7_media, op8_shard, op9_url_filter, op10_quality)}

_RULES_SQL = ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in URL_RULES)
_WORDS_SQL = "list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x09-\\x0D\\x20]+'), lambda x: x <> '')"
SQL = {
    "op4_decontaminate": f"""
WITH i AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark),
ik AS (SELECT item_id, w, least(5, len(w)) AS k FROM i WHERE len(w) > 0),
ish AS (SELECT DISTINCT item_id, k, array_to_string(w[a:a + k - 1], ' ') AS s FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS a FROM ik)),
n AS (SELECT item_id, count(*) AS n FROM ish GROUP BY 1),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS_SQL} AS w FROM documents),
dsh AS (SELECT r, doc_id, k, array_to_string(w[a:a + k - 1], ' ') AS s FROM (SELECT r, doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS a FROM d, (SELECT DISTINCT k FROM ik)))
SELECT doc_id, item_id, CAST(count(DISTINCT s) AS INT) AS n_shared, CAST(any_value(n) AS INT) AS n_shingles FROM dsh JOIN ish USING (k, s) JOIN n USING (item_id)
GROUP BY r, doc_id, item_id HAVING count(DISTINCT s) >= ceil(0.8 * any_value(n) - 1e-9)""",
    "op5_lm_score": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS_SQL}, []) AS w FROM documents),
t AS (SELECT r, unnest(w) AS x, unnest(range(len(w))) AS p FROM d),
b AS (SELECT r, x, lag(x) OVER (PARTITION BY r ORDER BY p) AS v, lag(x, 2) OVER (PARTITION BY r ORDER BY p) AS u FROM t),
one AS (SELECT x, count(*) AS n, CAST(round(ln(count(*)) * 1e6) AS BIGINT) AS l FROM t GROUP BY 1),
two AS (SELECT v, x, count(*) AS n, CAST(round(ln(count(*)) * 1e6) AS BIGINT) AS l FROM b WHERE v IS NOT NULL GROUP BY ALL),
three AS (SELECT u, v, x, count(*) AS n, CAST(round(ln(count(*)) * 1e6) AS BIGINT) AS l FROM b WHERE u IS NOT NULL GROUP BY ALL),
k AS (SELECT CAST(round(ln(count(*)) * 1e6) AS BIGINT) AS all_l, CAST(round(ln(0.4) * 1e6) AS BIGINT) AS back_l FROM t),
s AS (SELECT r, sum(CASE WHEN three.n >= 2 THEN three.l - c2.l WHEN two.n >= 2 THEN two.l - c1.l + CASE WHEN b.u IS NULL THEN 0 ELSE back_l END
      ELSE one.l - all_l + CASE WHEN b.v IS NULL THEN 0 WHEN b.u IS NULL THEN back_l ELSE 2 * back_l END END) / 1e6 AS log_score
    FROM b JOIN one USING (x) LEFT JOIN two ON two.v = b.v AND two.x = b.x LEFT JOIN one c1 ON c1.x = b.v
    LEFT JOIN three ON three.u = b.u AND three.v = b.v AND three.x = b.x LEFT JOIN two c2 ON c2.v = b.u AND c2.x = b.v, k GROUP BY r)
SELECT doc_id, len(w) AS n_tokens, coalesce(log_score, 0) AS log_score, CASE WHEN len(w) > 0 THEN round(exp(-log_score / len(w)), 3) END AS perplexity FROM d LEFT JOIN s USING (r)""",
    "op8_shard": """
WITH t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(CAST(i AS BIGINT), range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT row_number() OVER () AS r, doc_id, strlen(coalesce(text, '')) + 1 AS size, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS text_crc32 FROM documents, t),
u AS (SELECT r, j, CAST('0x' || left(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '#' || j), 13) AS BIGINT) AS u FROM d, (SELECT CAST(range AS INT) AS j FROM range(17))),
s AS (SELECT r, arg_max(j, u * 32 + j) FILTER (j < 16) AS shard, arg_max(j, u * 32 + j) AS grown_shard FROM u GROUP BY r),
b AS (SELECT *, left(md5(concat_ws('|', coalesce(CAST(doc_id AS VARCHAR), 'null'), size, text_crc32)), 3) AS bucket FROM d JOIN s USING (r))
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard FROM b""",
    "op9_url_filter": f"""
WITH rules(rhost, rpath, action) AS (VALUES {_RULES_SQL}),
rest AS (SELECT row_number() OVER () AS n, page_id,
    CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
split AS (SELECT n, page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
hit AS (SELECT n, max({{'w': length(rhost || rpath), 'rule': rhost || rpath, 'action': action}}) AS best FROM split
    JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY n)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.action, 'allow') AS verdict FROM split LEFT JOIN hit USING (n)""",
}
