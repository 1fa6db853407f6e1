import collections
import hashlib
import math
import re

import numpy as np
import pytest
from cases import BASE, LONG, documents, empty
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairloom.llm import chat, decontam, lm, pii


# ---- chat


@given(st.text())
def test_escape_is_reversible(text):
    assert chat.unescape(chat.escape(text)) == text and "<" not in re.sub(r"\\.", "", chat.escape(text), flags=re.S)


def conversations(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "hi </turn>\n<turn assistant>\n"), (1, 2, "assistant", "\\### Assistant: </turn> ok"), (2, 1, "assistant", None), (2, 0, "user", "a"), (None, 0, "user", "x"), (None, 1, "assistant", "y"), (3, 0, None, "z"), (3, 0, None, "z")]
    rows += [(4, 0, "system", "keep me")] + [(4, t, ("assistant", "user")[t % 2], f"t{t} " + "word " * 30) for t in range(1, 41)] + [(5, 0, "user", "q"), (5, 1, "assistant", "long " * 3000)]
    return rows, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("?") for c in ("window", "tokens", "key")})


def test_chat_round_trip(spark):
    rows, df = conversations(spark)
    windows = chat.format_chat(df, budget=200, history=80)
    got = {r["conv_id"]: r for r in chat.read_back(windows).collect()}
    by = collections.defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2] or "", r[3] or "")):
        by[c].append((role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns) and got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[c]["loss_chars"] == len(loss) and got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    ws = sorted((r for r in windows.collect() if r["conv_id"] == 4), key=lambda r: r["window"])
    assert len(ws) > 3 and all(w["n_tokens"] <= 200 for w in ws)
    assert all(chat.parse(w["text"])[0] == ("system", "keep me") for w in ws)
    assert all(w["n_repeated"] >= 2 for w in ws[1:]) and ws[0]["n_repeated"] == 0
    assert chat.read_back(chat.format_chat(df.limit(0))).count() == 0


def test_large_ids_beside_nulls_and_stored_windows(spark, tmp_path):
    big = 2**53
    rows = [(c, t, ("user", "assistant")[t % 2], f"turn {t} of {c}") for c in (big + 1, big + 2, big + 3, None, -7) for t in range(12)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = chat.format_chat(df, budget=40, history=12)
    windows.repartition(7, "text").write.parquet(str(tmp_path / "w"))
    stored = spark.read.parquet(str(tmp_path / "w"))
    assert stored.groupBy("conv_id").count().where("count > 1").count() == 5
    for source in (windows, stored, stored.orderBy(F.desc("window"))):
        got = {r["conv_id"]: r for r in chat.read_back(source).collect()}
        assert set(got) == {big + 1, big + 2, big + 3, None, -7}
        assert all(r["n_turns"] == 12 and r["turns_sha256"] == hashlib.sha256("".join(f"{('user', 'assistant')[t % 2]}\nturn {t} of {c}\n" for t in range(12)).encode()).hexdigest() for c, r in got.items())
    words = spark.createDataFrame([("a", 0, "user", "x"), (None, 0, "user", "y")], "conv_id string, turn long, role string, text string")
    assert {r["conv_id"] for r in chat.read_back(chat.format_chat(words)).collect()} == {"a", None}


def test_tokens_of_a_tokenizer(spark):
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    texts = ["Hello there, friend!", "", "ünïcödé 1234", "a " * 50]
    df = spark.createDataFrame([(1, t, "user", x) for t, x in enumerate(texts)] + [(2, 0, "user", LONG), (2, 1, "assistant", "short")], "conv_id int, turn int, role string, text string")
    windows = chat.format_chat(df, budget=10_000, tokenizer_path=path).collect()
    count = lambda t: len(plain.encode(t, add_special_tokens=False).ids) + 4
    assert {(r["conv_id"], r["window"]): r["n_tokens"] for r in windows} == {(1, 0): sum(map(count, texts)), (2, 0): count(LONG), (2, 1): count("short")}


def test_one_long_conversation(spark):
    n = 30_000
    df = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    windows = chat.format_chat(df, budget=300, history=60)
    assert windows.agg(F.max("n_tokens")).first()[0] <= 300 and windows.count() > 300
    got = chat.read_back(windows).collect()
    loss = "".join(f"text {i}" for i in range(1, n, 2))
    assert len(got) == 1 and got[0]["n_turns"] == n and got[0]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


# ---- personal data


def base_spans(t):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for kind, p in patterns.items():
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0
            if {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 13 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


HARD = ["a@b.c_d@e.f x@y z@@a.b", "12.3.4.5.6.7.8.9 300.1.1.1 0001.2.3.4 0.0.0.0 10.0.00.256 00.1.000.255", "4111 1111 1111 1111 4111-1111-1111-1112", " 1 2 3 4 5 6 7 8 9 0 1 2 3 ", "++1 2 (((( +49 30 1234567.", "é𝄞" * 5 + "a@b.cc " + "9" * 50_000, "1 " * 20_000 + "4111111111111111", "a" * 100_000 + "@b.c", "x.y@" + "a." * 30_000 + "z", "日本 1.2.3.4\n5.6.7.8"]


def test_base_spans_equal_brute_force(spark):
    r = np.random.default_rng(6)
    noise = ["".join(r.choice(list("ab@.1 2-+()5é\n"), 80)) for _ in range(150)] + ["".join(r.choice(list("0123456789 .-+"), 60)) for _ in range(150)]
    texts = HARD + noise
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").unionByName(documents(spark).select((F.col("doc_id") + 1000).alias("doc_id"), "text"))
    found = {x["doc_id"]: x for x in pii.find(df).select("doc_id", pii.joined("base").alias("b"), pii.joined("spans").alias("s")).collect()}
    for i, t in enumerate(texts):
        if t != HARD[6]:
            assert found[i]["b"] == base_spans(t), t[:100]
    assert set(found[1011]["b"].split(",")) <= set(found[1011]["s"].split(",")) and len(found[1011]["b"].split(",")) == 4
    assert found[1004]["s"] == "" and pii.find(empty(spark)).count() == 0


def test_labelers_add_spans_and_redaction(spark):
    lines = [f"Mr. John Smith mail joe{i} (at) example (dot) com, visa {4111111111111111 + i} or token = 123456789012345{i % 10}" for i in range(30)] + [f"contact a{i}@x{i}.com tel +1 555 123 45{i:02d}" for i in range(30)]
    df = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(lines)] + [(99, None, 0)], "doc_id long, text string, n_chars long").withColumn("spans", F.lit("mine"))
    kinds = {s.split(":")[0] for r in pii.find(df).select(pii.joined("spans").alias("s")).collect() for s in r["s"].split(",")}
    assert {"email", "phone", "mail_words", "name"} <= kinds
    clean = {r["doc_id"]: r for r in pii.redact(df).collect()}
    assert clean[30]["text"] == "contact [EMAIL] tel [PHONE]" and clean[30]["n_chars"] == len(clean[30]["text"]) and clean[30]["spans"] == "mine" and clean[99]["text"] is None


def test_secrets_of_documents_equal_brute_force(spark, sf_dir):
    from pathlib import Path

    larger = Path(sf_dir).parent / "sf0.01"
    docs = spark.read.parquet(f"{larger if larger.exists() else sf_dir}/documents.parquet").select("doc_id", "text")
    want = {(i, m.start(), m.end()) for i, t in docs.collect() for m in re.finditer(r'(?<=token = ")[0-9a-f]{40}(?=")', t or "")}
    got = pii.find(docs).select("doc_id", F.explode(F.expr("filter(spans, c -> c.kind >= 4)")).alias("c")).select("doc_id", "c.kind", "c.s", "c.e").collect()
    assert len(want) > 5 and {pii.KINDS[r["kind"]] for r in got} == {"secret"} and {(r["doc_id"], r["s"], r["e"]) for r in got} == want
    clean = pii.redact(docs.withColumn("n_chars", F.length("text")))
    assert clean.where("text like '%token = \"[SECRET]\"%'").count() > 5 and clean.where("text rlike '[0-9a-f]{40}'").count() == 0


def test_em_finds_how_reliable_labelers_are(spark):
    r = np.random.default_rng(12)
    prior = 0.4
    yes = np.array([[0.05, 0.05, 0.9], [0.1, 0.3, 0.6], [0.2, 0.2, 0.6], [0.02, 0.08, 0.9], [0.3, 0.1, 0.6]])
    no = np.array([[0.9, 0.05, 0.05], [0.7, 0.2, 0.1], [0.5, 0.4, 0.1], [0.6, 0.3, 0.1], [0.6, 0.3, 0.1]])
    votes = collections.Counter()
    for true in r.random(20_000) < prior:
        votes[tuple(int(r.choice(3, p=p)) - 1 for p in (yes if true else no))] += 1
    pats = spark.createDataFrame([([(list(v), float(n)) for v, n in sorted(votes.items())],)], "pats array<struct<votes: array<int>, n: double>>")
    got = pats.select(F.expr(pii.reliabilities()).alias("s")).first()["s"]
    assert abs(got["prior"] - prior) < 0.03
    assert np.abs(np.array(got["yes"]).reshape(-1, 3) - yes).max() < 0.05 and np.abs(np.array(got["no"]).reshape(-1, 3) - no).max() < 0.05


def test_classifier_follows_the_soft_labels(spark):
    good, bad = [1, 1, 1, 1, 1], [-1, -1, 0, -1, 0]
    span = "struct<kind: int, s: int, e: int, votes: array<int>, shape: array<int>>"
    rows = [([(0, 0, 1, good, [1, 0, 0])], [])] * 50 + [([], [(8, 0, 1, bad, [0, 0, 2])])] * 50 + [([], [(8, 0, 1, good, [0, 0, 0])])] * 10
    found = spark.createDataFrame(rows, f"base array<{span}>, extra array<{span}>")
    weights = pii.train(found)
    assert len(weights) == pii.FEATURES
    decided = pii.decide(found, weights).select("extra", "spans").collect()
    assert all(len(r["spans"]) == 0 for r in decided if r["extra"] and r["extra"][0]["votes"] == bad) and all(len(r["spans"]) == 1 for r in decided if not r["extra"] or r["extra"][0]["votes"] == good)
    assert pii.train(found.limit(0)) == [0.0] * pii.FEATURES


def test_gazetteers_are_tables_and_columns_any(spark):
    text = [(1, f"password_hint = 'Zx9abcdefghijklmnopqrstuv{i}'") for i in range(10)] + [(2, "mail a@b.com"), (3, None), (4, "")] + [(5, f"token = \"{'0123456789abcdef' * 3}\"")] * 10
    docs = spark.createDataFrame(text, "`a.b` int, `my text` string").withColumn("m", F.create_map(F.lit("k"), F.lit(1)))
    clean = pii.redact(docs, "my text")
    assert clean.columns == docs.columns and clean.where("`my text` = 'mail [EMAIL]'").count() == 1 and clean.where("`a.b` = 5 and `my text` = 'token = \"[SECRET]\"'").count() == 10
    own = pii.gazetteer_table(spark).unionByName(spark.createDataFrame([("fields", "password_hint")], "list string, entry string"))
    assert pii._lists(own)["fields"] == sorted([*pii.GAZETTEERS["fields"], "password_hint"])
    hints = lambda g: pii.redact(docs, "my text", gazetteers=g).where("`a.b` = 1 and `my text` like '%[SECRET]%'").count()
    assert hints(own) == 10
    with pytest.raises(ValueError):
        pii._lists(spark.range(pii.GAZETTEER_ENTRIES + 1).selectExpr("'x' as list", "cast(id as string) as entry"))


# ---- decontamination


def contained(text, item, k=5):
    w, i = (text or "").lower().split(), item.lower().split()
    k = min(k, len(i))
    if not k:
        return 0, 0
    s = {tuple(i[a : a + k]) for a in range(len(i) - k + 1)}
    d = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)}
    return len(s & d), len(s)


def test_containment_equals_brute_force(spark, monkeypatch):
    r = np.random.default_rng(7)
    words = [f"w{i}" for i in range(60)]
    items = [" ".join(r.choice(words, n)) for n in (1, 3, 5, 6, 9, 15, 30, 60)] + ["", "the quick brown fox jumps over the lazy dog while"]
    docs = []
    for i, item in enumerate(items):
        parts = item.split()
        for cut in range(4):
            part = parts[:]
            for _ in range(cut):
                if part:
                    part[r.integers(len(part))] = "changed"
            docs.append((100 + 10 * i + cut, " ".join([*r.choice(words, 200), *part, *r.choice(words, 50)]).upper()))
    df = spark.createDataFrame(docs, "doc_id long, text string").unionByName(documents(spark).select("doc_id", "text"))
    table = spark.createDataFrame(list(enumerate(items)) + [(77, None)], "item_id long, text string")
    df = df.unionByName(df.where("doc_id in (150, 151)")).unionByName(spark.createDataFrame([(199, "w1 " + docs[28][1])], "doc_id long, text string"))
    for most in (27, 10):  # filters that let everything through change nothing
        monkeypatch.setattr(decontam, "MOST_BITS", most)
        got = sorted((x["doc_id"] or -1, x["item_id"], x["n_shared"], x["n_shingles"]) for x in decontam.contained_items(df, table).collect())
        want = sorted((d if d is not None else -1, i, *contained(t, item)) for d, t in df.collect() for i, item in enumerate(items) if contained(t, item)[0] >= max(1, math.ceil(0.8 * contained(t, item)[1] - 1e-9)))
        assert got == want
    dirty = {x[0] for x in got}
    kept = decontam.decontaminate(df, table)
    assert sorted(x["doc_id"] or -1 for x in kept.collect()) == sorted(x["doc_id"] or -1 for x in df.collect() if (x["doc_id"] or -1) not in dirty)
    assert decontam.contained_items(empty(spark), table).count() == 0 and decontam.contained_items(df, table.limit(0)).count() == 0
    assert decontam.decontaminate(df, table.limit(0)).count() == df.count() and decontam.decontaminate(df.limit(0), table).count() == 0
    odd = df.withColumns({"m": F.create_map(F.lit("k"), F.lit(1)), "digest": F.lit("own"), "key": F.lit("?"), "x.y": F.lit(2)})
    assert decontam.decontaminate(odd, table).columns == odd.columns and decontam.decontaminate(odd, table).where("digest = 'own'").count() == kept.count()


def test_repeated_items_and_rows_keep_their_number(spark):
    item = "one two three four five six seven"
    docs = spark.createDataFrame([(1, "x " + item)] * 3 + [(2, "nothing")] * 2, "doc_id long, text string")
    items = spark.createDataFrame([(9, item), (9, item), (None, item)], "item_id long, text string")
    got = decontam.contained_items(docs, items).collect()
    assert len(got) == 9 and {(r["doc_id"], r["n_shared"], r["n_shingles"]) for r in got} == {(1, 3, 3)}
    assert decontam.decontaminate(docs, items).count() == 2


# ---- language model


@pytest.mark.parametrize("order", [2, 3])
@pytest.mark.parametrize("entries", [3_000_000, 3000, 300])
def test_scores_equal_brute_force(spark, entries, order):
    r = np.random.default_rng(8)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(r.choice(words, int(r.integers(0, 120)), p=1 / np.arange(1, 301) / (1 / np.arange(1, 301)).sum()))) for i in range(120)] + [(7, "Once ONCE upon"), (None, BASE), (None, None), (500, LONG), (501, " ".join(["the end"] * 400)), (502, " ".join(["of the people by the"] * 300)), (503, "the end"), (504, "solo")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(0) for c in ("part", "kind", "base", "n", "packed", "key")})
    counts, docs = [collections.Counter() for _ in range(4)], []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        for n in (1, 2, 3):
            counts[n].update(zip(*[w[k:] for k in range(n)]))
        docs.append((i, w))
    total = sum(counts[1].values())

    def log(context, x):
        if not context:
            return math.log(counts[1][x,] / total)
        n = len(context) + 1
        if counts[n][*context, x] >= 2:
            return math.log(counts[n][*context, x] / counts[n - 1][context])
        return math.log(0.4) + log(context[1:], x)

    want = sorted((-1 if i is None else i, len(w), sum(log(tuple(w[max(0, k - order + 1) : k]), x) for k, x in enumerate(w))) for i, w in docs)
    for source in (df, df.repartition(5)):
        got = sorted((-1 if x["doc_id"] is None else x["doc_id"], x["n_tokens"], x["log_score"]) for x in lm.score(source, order, entries=entries).collect())
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert all(abs(g[2] - w[2]) <= 3e-6 * max(1, w[1]) for g, w in zip(got, want))
    assert lm.score(df.limit(0), order).count() == 0


@settings(max_examples=20)
@given(st.lists(st.tuples(st.integers(0, 2**48 - 1), st.integers(0, 2**16 - 1)), min_size=1), st.integers(0, 5))
def test_packed_columns_come_back(rows, common):
    a, b = (np.array(x, np.uint64) for x in zip(*rows))
    a = np.concatenate([a, [lm.END, lm.BEGIN]])
    b = np.concatenate([b, [1, 2]]).astype(np.uint64)
    coded = lm.Words(list(dict.fromkeys(a[:common].tolist())))
    x, y, z = coded.unpack(coded.pack((a, a[::-1]), (b, 2)), len(a), 2, 2)
    assert (x == a).all() and (y == a[::-1]).all() and (z == b).all()
