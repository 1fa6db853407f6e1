"""Small document tables with nulls, empty and long texts, ties, copies and clashing columns."""

LONG = " ".join(f"word{i % 977} filler{i % 13}" for i in range(20_000))
BASE = "The quick brown fox jumps over the lazy dog while seven wizards mix potions near the old stone bridge at dawn and nobody notices the small grey cat asleep on the warm window sill above"
TEXTS = [
    (1, BASE), (2, BASE), (3, BASE.replace("seven", "eight")), (4, None), (5, ""), (6, "  \t\n"), (7, "one"), (8, "one two"), (9, LONG),
    (10, "ÄÖÜ straße naïve 日本語 текст"), (None, "no key at all here"), (11, "mail a.b@c.org or +1 (017) 555-7713, 10.0.0.1 and 4111 1111 1111 1111"), (11, "mail a.b@c.org or +1 (017) 555-7713, 10.0.0.1 and 4111 1111 1111 1111"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns with names that operators use themselves.
CLASH = ["key", "tid", "fp", "size", "part", "kind", "row", "spans", "m", "x", "label", "score"]


def documents(spark):
    from pyspark.sql import functions as F

    rows = [(i, t, "en", "s", len(t or "")) for i, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("?") for c in CLASH})


def empty(spark):
    return documents(spark).limit(0)
