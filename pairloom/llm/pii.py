"""Personal data by weak supervision.

Regular expressions propose spans; regex, gazetteer and context labelers vote on each; expectation-
maximisation estimates how reliable each labeler is; a logistic span classifier is trained on the
resulting soft labels and decides about the spans that the exact patterns do not settle. Spans of the
four exact kinds always stay.

Native: DataFrame and SQL functions only. What the two estimates see are counts of vote patterns,
whose number does not grow with the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import written
from .common import quoted

# Exact kinds, each with the pattern whose leftmost non-overlapping matches count. Possessive
# quantifiers and the look-behinds change no match: they only keep long runs from being tried at
# every position.
_LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What must occur in a text for its pattern to match at all.
_NEEDS = {"email": "text like '%@%'", "ip": r"text rlike '[0-9][.][0-9]'", "card": r"text rlike '[0-9][\\x20-]?[0-9]'", "phone": "text like '%+%'"}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_VALID = {
    "email": "true",
    "ip": rf"m rlike '^{_OCTET}(?:[.]{_OCTET}){{3}}$'",
    "card": "length(regexp_replace(m, '[^0-9]', '')) between 13 and 19 and luhn_check(regexp_replace(m, '[^0-9]', ''))",
    "phone": "length(regexp_replace(m, '[^0-9]', '')) between 9 and 15",
}
# Kinds that only the classifier can accept.
EXTRA = {
    "mail_words": r"[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]++ ?(?:\(dot\)|\[dot\]) ?[A-Za-z]{2,}",
    "phone_local": r"(?<![0-9+)] ?)(?:\([0-9]{3}\)|[0-9]{3})[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])",
    "number": r"(?<![0-9])[0-9]{13,19}(?![0-9])",
    "name": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)[.]? [A-ZÀ-Ý][a-zß-ÿ]+(?: [A-ZÀ-Ý][a-zß-ÿ]+)?",
    "secret": r"(?<![A-Za-z0-9_/+-])(?=[A-Za-z_/+-]*+[0-9])(?=[0-9_/+-]*+[A-Za-z])[A-Za-z0-9_/+-]{24,}+",
}
_EXTRA_NEEDS = {"mail_words": "text like '%at%dot%'", "phone_local": r"text rlike '[0-9]{3}[ .-][0-9]{4}'", "account": "text rlike '[A-Z]{2}[0-9]{2}[A-Z0-9]{11}'", "number": "text rlike '[0-9]{13}'", "name": "text rlike '(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)[.]? [A-ZÀ-Ý]'", "secret": "text rlike '[A-Za-z0-9_/+-]{24}'"}
KINDS = [*BASE, *EXTRA]
# Gazetteers, fixed values: endings of hosts, calling codes, countries with account numbers and first
# digits of card issuers, given names, names of fields that hold secrets, words before personal data.
GAZETTEERS = {
    "endings": "com org net edu gov info io de es fr uk eu it nl at ch be pt pl se dk".split(),
    "calling": "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split(),
    "countries": "AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IT LT LU LV NL NO PL PT RO SE SI SK".split(),
    "issuers": "3 4 5 6".split(),
    "given": "anna ana antonio carlos charles christian claire claudia daniel david elena elizabeth emma francisco hans james jean jennifer john jose juan julia karl laura lucia manuel maria marie mark martin mary michael nicolas paul peter pierre robert sarah sofia sophie stefan susan thomas william wolfgang".split(),
    "fields": "token secret key apikey api_key api-key access_key access_token auth auth_token authorization bearer client_secret credential passwd password private_key pwd secret_key".split(),
    "said": "mail contact write tel telephone phone call fax mobile card visa payment account iban address host server client correo tarjeta carte konto karte adresse".split(),
    "code": "token secret key hash version id commit sha build".split(),
}
GAZETTEER_ENTRIES = 10_000

LABELERS = 5
SHAPES, SHAPE_VALUES = 3, 4
_EM_ROUNDS, _FIT_ROUNDS, _RATE = 20, 80, 1.0
FEATURES = 3 * LABELERS + SHAPES * SHAPE_VALUES + len(KINDS) + 1


def gazetteer_table(spark: SparkSession) -> DataFrame:
    """The gazetteers that come with the library, as list and entry."""
    return spark.createDataFrame([(name, entry) for name, entries in GAZETTEERS.items() for entry in entries], "list string, entry string")


def _lists(gazetteers: DataFrame | None) -> dict[str, list[str]]:
    """Entries by list: the library's, and over them those of a table (list, entry) of at most
    GAZETTEER_ENTRIES rows; a larger one is an error."""
    if gazetteers is None:
        return GAZETTEERS
    rows = gazetteers.where("list is not null and entry is not null").select("list", "entry").distinct().limit(GAZETTEER_ENTRIES + 1).collect()
    if len(rows) > GAZETTEER_ENTRIES:
        raise ValueError(f"gazetteers hold more than {GAZETTEER_ENTRIES} entries")
    given: dict[str, list[str]] = {}
    for name, entry in sorted(rows):
        given.setdefault(name, []).append(entry)
    return GAZETTEERS | given


def _found(kind: str, pattern: str, needs: str, valid: str) -> Column:
    """Matches of the pattern with their places in code points, those that are not valid left out:
    between matches lie the parts that splitting at the pattern gives."""
    quoted = "r'" + pattern + "'"
    valid = valid.replace("m ", "x.m ").replace("(m,", "(x.m,") if valid != "true" else "x.m is not null"
    empty = "cast(array() as array<struct<s: int, e: int, m: string, l: string, r: string>>)"
    step = f"""struct(a.p + length(x.t) + coalesce(length(x.m), 0) as p,
        if(x.m is not null and ({valid}), array_append(a.o, struct(a.p + length(x.t) as s, a.p + length(x.t) + length(x.m) as e, x.m as m,
            right(x.t, 24) as l, left(coalesce(x.n, ''), 1) as r)), a.o) as o)"""
    parts = f"split(text, {quoted}, -1)"
    zipped = f"zip_with(zip_with({parts}, m, (t, m) -> struct(t as t, m as m)), slice({parts}, 2, greatest(size({parts}) - 1, 0)), (y, n) -> struct(y.t as t, y.m as m, n as n))"
    walk = f"aggregate({zipped}, struct(0 as p, {empty} as o), (a, x) -> {step}, a -> a.o)"
    found = f"if({needs}, transform(array(regexp_extract_all(text, {quoted}, 0)), m -> if(size(m) > 0, {walk}, {empty}))[0], {empty})"
    return F.expr(found).alias(kind)


def _votes(kind: str, lists: dict[str, list[str]]) -> str:
    """The labelers' votes on a span c, 1 for, -1 against, 0 for no opinion, in this order: regex shape,
    gazetteer, words before it, what it touches, variety of its digits."""

    def listed(value: str, name: str, otherwise: int = -1) -> str:
        entries = ", ".join("'" + e.replace("\\", "\\\\").replace("'", "\\'") + "'" for e in lists[name])
        return f"if(array_contains(cast(array({entries}) as array<string>), {value}), 1, {otherwise})"

    after = "regexp_extract(c.l, '([A-Za-z_-]+)[\"\\']?[^A-Za-z0-9]{0,4}$', 1)"
    ending = "lower(regexp_extract(c.m, '([A-Za-z0-9-]+)$', 1))"
    digits = "regexp_replace(c.m, '[^0-9]', '')"
    calling = " or ".join(f"array_contains(array({', '.join(repr(e) for e in lists['calling'])}), left({digits}, {n}))" for n in (1, 2, 3))
    shape = "1" if kind in BASE else {"number": "-1", "secret": "if(c.m rlike '^(?:[0-9a-f]{32,}|[0-9A-F]{32,})$' or (c.m rlike '[a-z]' and c.m rlike '[A-Z]' and c.m rlike '[0-9]'), 1, -1)"}.get(kind, "0")
    gazetteer = {
        "email": listed(ending, "endings"), "ip": "if(c.m rlike '^(?:0|255)[.]', -1, 1)", "card": listed(f"left({digits}, 1)", "issuers"), "phone": f"if({calling}, 1, -1)",
        "mail_words": listed(ending, "endings"), "phone_local": "if(c.m rlike '^[(]?[2-9]', 1, -1)", "account": listed("left(c.m, 2)", "countries"),
        "number": listed(f"left({digits}, 1)", "issuers").replace("1, -1)", "0, -1)"), "name": listed("lower(regexp_extract(c.m, ' ([^ ]+)', 1))", "given", 0), "secret": listed(f"lower({after})", "fields"),
    }[kind]
    if kind == "secret":
        said, touch = "if(c.l rlike '[=:][ ]*[\"\\']?$', 1, -1)", "if(c.l rlike '[A-Za-z0-9_]$' or c.r rlike '[A-Za-z0-9_=@]', -1, 1)"
    else:
        said = f"case when {listed(f'lower({after})', 'said')} = 1 then 1 when {listed(f'lower({after})', 'code')} = 1 or c.l rlike '[=#:\"] *$' then -1 else 0 end"
        touch = "if(c.l rlike '[A-Za-z0-9_=]$' or c.r rlike '[A-Za-z0-9_=@]', -1, 1)"
    distinct = f"size(array_distinct(split({digits}, '')))"
    variety = f"case when c.m not rlike '[0-9]' then 0 when {distinct} >= 4 then 1 when {distinct} <= 2 then -1 else 0 end"
    return f"array({shape}, {gazetteer}, {said}, {touch}, {variety})"


def _shape(c: str = "c") -> str:
    """What the classifier sees of a span besides the votes, SHAPES numbers below SHAPE_VALUES: length,
    share of digits, and what stands before it."""
    length = f"case when length({c}.m) < 12 then 0 when length({c}.m) < 20 then 1 when length({c}.m) < 32 then 2 else 3 end"
    digits = f"least(3, cast(floor(4 * length(regexp_replace({c}.m, '[^0-9]', '')) / greatest(1, length({c}.m))) as int))"
    before = f"case when {c}.l = '' or {c}.l rlike '[ \\n\\t]$' then 0 when {c}.l rlike '[=:\"\\']$' then 1 when {c}.l rlike '[A-Za-z0-9]$' then 2 else 3 end"
    return f"array({length}, {digits}, {before})"


def candidates(docs: DataFrame, keep: list[str], text: str = "text", gazetteers: DataFrame | None = None) -> DataFrame:
    """row (a struct of the keep columns), base (spans of the exact kinds) and extra (spans for the
    classifier to decide), each an array of struct(kind, s, e, votes, shape). A null text is empty.

    An extra span that overlaps a base span is none: it is settled."""
    lists = _lists(gazetteers)
    rows = docs.select(F.struct(*map(quoted, keep)).alias("row"), F.coalesce(quoted(text), F.lit("")).alias("text"))
    found = rows.select("row", *[_found(k, p, _NEEDS[k], _VALID[k]) for k, p in BASE.items()], *[_found(k, p, _EXTRA_NEEDS[k], "true") for k, p in EXTRA.items()])
    voted = {k: f"transform({k}, c -> struct({i} as kind, c.s as s, c.e as e, {_votes(k, lists)} as votes, {_shape()} as shape))" for i, k in enumerate(KINDS)}
    base = "concat(" + ", ".join(voted[k] for k in BASE) + ")"
    extra = "concat(" + ", ".join(voted[k] for k in EXTRA) + ")"
    out = found.select("row", F.expr(base).alias("base"), F.expr(extra).alias("extra"))
    free = F.expr("if(size(extra) = 0, extra, filter(extra, x -> not exists(base, b -> b.s < x.e and x.s < b.e)))")
    return out.select("row", "base", free.alias("extra"))


def _posterior(s: str, votes: str) -> str:
    """The chance that a span with these votes is true."""
    logs = {y: f"aggregate(transform({votes}, (v, j) -> ln({s}.{y}[cast(3 * j + v + 1 as int)])), 0D, (t, x) -> t + x)" for y in ("yes", "no")}
    return f"(1D / (1D + exp(least(30D, ln(1D - {s}.prior) - ln({s}.prior) + {logs['no']} - {logs['yes']}))))"


def _features(kind: str, votes: str, shape: str) -> str:
    """One-hot votes, shape and kind, and a constant."""
    hot = f"flatten(transform({votes}, v -> transform(array(-1, 0, 1), k -> if(v = k, 1D, 0D))))"
    form = f"flatten(transform({shape}, v -> transform(sequence(0, {SHAPE_VALUES - 1}), k -> if(v = k, 1D, 0D))))"
    return f"concat({hot}, {form}, transform(sequence(0, {len(KINDS) - 1}), k -> if({kind} = k, 1D, 0D)), array(1D))"


def train(found: DataFrame) -> list[float]:
    """Weights of the span classifier from the spans of candidates(): the EM's soft labels of all of
    them, fitted by gradient steps over the counts of each kind, vote pattern and shape (at most kinds x 3 to
    the number of labelers x the shapes, whatever the documents). Without spans all weights are 0."""
    spans = found.select(F.explode(F.concat("base", "extra")).alias("c")).select("c.kind", "c.votes", "c.shape")
    counts = spans.groupBy("kind", "votes", "shape").agg(F.count(F.lit(1)).cast("double").alias("n"))
    one = counts.agg(F.array_sort(F.collect_list(F.struct("kind", "votes", "shape", "n"))).alias("pats"))
    fitted = one.select("pats", F.expr(reliabilities()).alias("s")).selectExpr(
        "s", f"transform(pats, p -> struct({_features('p.kind', 'p.votes', 'p.shape')} as x, p.n as n, {_posterior('s', 'p.votes')} as q)) as rows", "greatest(1D, aggregate(pats, 0D, (t, p) -> t + p.n)) as total"
    )
    miss = "transform(rows, r -> struct(r.x as x, r.n * (1D / (1D + exp(-aggregate(zip_with(r.x, w, (a, b) -> a * b), 0D, (t, v) -> t + v))) - r.q) as g))"
    step = f"transform(array({miss}), d -> transform(w, (v, j) -> v - {_RATE}D * (aggregate(d, 0D, (t, r) -> t + r.g * r.x[j]) / total + 0.0001D * v)))[0]"
    start = f"array_repeat(0D, {FEATURES})"
    row = fitted.selectExpr(f"aggregate(sequence(1, {_FIT_ROUNDS}), {start}, (w, k) -> {step}) as w").first()
    return list(row["w"])


def reliabilities() -> str:
    """Expectation-maximisation over the array pats of struct(votes, n): struct(prior, yes, no), where yes
    and no hold each labeler's chances of voting -1, 0 and 1 on true and on other spans."""
    start = f"struct(0.5D as prior, flatten(array_repeat(array(0.1D, 0.3D, 0.6D), {LABELERS})) as yes, flatten(array_repeat(array(0.6D, 0.3D, 0.1D), {LABELERS})) as no)"

    def share(q: str) -> str:
        return f"transform(sequence(0, {3 * LABELERS - 1}), i -> (1D + aggregate(d, 0D, (t, p) -> t + if(p.votes[cast(i div 3 as int)] + 1 = i % 3, p.n * {q}, 0D))) / (3D + aggregate(d, 0D, (t, p) -> t + p.n * {q})))"

    prior = "(1D + aggregate(d, 0D, (t, p) -> t + p.n * p.q)) / (2D + aggregate(d, 0D, (t, p) -> t + p.n))"
    step = f"transform(array(transform(pats, p -> struct(p.votes as votes, p.n as n, {_posterior('s', 'p.votes')} as q))), d -> struct({prior} as prior, {share('p.q')} as yes, {share('(1D - p.q)')} as no))[0]"
    return f"aggregate(sequence(1, {_EM_ROUNDS}), {start}, (s, k) -> {step})"


def decide(found: DataFrame, weights: list[float], at_least: float = 0.5) -> DataFrame:
    """found with spans: base and accepted extra spans by kind as listed, then place."""
    w = "array(" + ", ".join(f"{x!r}D" for x in weights) + ")"
    chance = f"1D / (1D + exp(-aggregate(zip_with({_features('c.kind', 'c.votes', 'c.shape')}, {w}, (a, b) -> a * b), 0D, (t, v) -> t + v)))"
    accepted = f"if(size(extra) = 0, extra, filter(extra, c -> {chance} >= {at_least}D))"
    return found.withColumn("spans", F.expr(f"concat(base, {accepted})"))


def joined(spans: str) -> Column:
    """kind:start:end of the spans, joined by commas."""
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({spans}, c -> concat_ws(':', {names}[c.kind], cast(c.s as string), cast(c.e as string))), ',')")


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", gazetteers: DataFrame | None = None) -> DataFrame:
    """key, base and spans (arrays of kind, s, e, votes, shape) of every row's whole text. Gazetteers are
    a table (list, entry) whose lists stand for the library's of that name.

    Places are code points, ends exclusive. A null or empty text has no spans; repeated rows and null
    keys are rows like any other; no rows give no rows; other columns are not read."""
    found = written(candidates(docs, [key], text, gazetteers), "spans")
    return decide(found, train(found)).select(F.col("row").getField(key).alias(key), "base", "spans")


def redact(docs: DataFrame, text: str = "text", chars: str = "n_chars", gazetteers: DataFrame | None = None) -> DataFrame:
    """docs, all columns, with each span's text replaced by its kind in brackets and chars, if there is
    such a column, counted anew. Overlapping spans become one, named after the first; a null text stays
    null, an empty one empty; repeated rows are rows like any other, columns may have any names and
    types; no rows give no rows."""
    found = written(candidates(docs, docs.columns, text, gazetteers), "spans")
    marked = decide(found, train(found))
    names = "array(" + ", ".join(f"'[{k.upper()}]'" for k in KINDS) + ")"
    order = "array_sort(transform(spans, c -> struct(c.s as s, -c.e as e, c.kind as kind)))"
    escaped = text.replace("`", "``")
    body = f"row.`{escaped}`"
    step = f"""if(c.s < a.p, struct(greatest(a.p, -c.e) as p, a.o as o),
        struct(-c.e as p, array_append(array_append(a.o, substring({body}, a.p + 1, c.s - a.p)), {names}[c.kind]) as o))"""
    whole = f"aggregate({order}, struct(0 as p, cast(array() as array<string>) as o), (a, c) -> {step}, a -> concat(array_join(a.o, ''), substring({body}, a.p + 1)))"
    out = marked.select("row", "spans", F.expr(f"if(size(spans) = 0 or {body} is null, {body}, {whole})").alias("clean"))
    new = {c: F.col("row").getField(c) for c in docs.columns} | {text: F.col("clean")}
    if chars in new:
        new[chars] = F.when(F.size("spans") > 0, F.length("clean").cast(dict(docs.dtypes)[chars])).otherwise(new[chars])
    return out.select(*[v.alias(c) for c, v in new.items()])
