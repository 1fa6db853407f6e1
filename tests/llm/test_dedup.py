import numpy as np
import pytest
import xxhash
from cases import BASE, documents, empty
from hypothesis import given, settings
from hypothesis import strategies as st

from pairloom.llm import simhash, vptree
from pairloom.llm.components import components


def fingerprint(text, k):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    k = min(k, len(w))
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(len(w) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def brute_components(ids, prints, radius=2):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, (i, a) in enumerate(zip(ids, prints)):
        for j, b in zip(ids[:n], prints[:n]):
            if (a ^ b).bit_count() <= radius:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 400), st.integers(1, 7), st.sampled_from([0, 1, 2, 5]))
def test_tree_finds_every_pair(seed, n, leaves, radius):
    r = np.random.default_rng(seed)
    centres = r.integers(0, 2**63, 20, dtype=np.uint64)
    points = np.unique(np.array([int(r.choice(centres)) ^ (1 << int(r.integers(64))) ^ (1 << int(r.integers(64))) for _ in range(n)], np.uint64))
    tree = vptree.grow(points, leaves, radius)
    pairs, homes = set(), []
    for _, home, visit in vptree.route(tree, points, radius):
        homes += home.tolist()
        both = np.concatenate([home, visit])
        near = np.bitwise_count(home[:, None] ^ both[None]) <= radius
        pairs |= {(min(a, b), max(a, b)) for a, b in zip(home[np.nonzero(near)[0]].tolist(), both[np.nonzero(near)[1]].tolist()) if a != b}
    assert sorted(homes) == points.tolist()
    d = np.bitwise_count(points[:, None] ^ points[None])
    assert pairs == {(int(points[i]), int(points[j])) for i, j in zip(*np.nonzero(np.triu(d <= radius, 1)))}


def test_leaves_join_dense_groups():
    r = np.random.default_rng(1)
    home = np.unique(np.array([int(r.integers(2**63)) ^ (1 << int(r.integers(64))) for _ in range(50)] + [7 ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)], np.uint64))
    points, roots = vptree.linked(home, np.array([7], np.uint64), 2)
    assert len(set(roots.tolist())) == 1 and len(points) == 2016 + 1


def test_links_over_shards_equal_brute_force(spark):
    r = np.random.default_rng(2)
    centres = r.integers(0, 2**63, 150, dtype=np.uint64)
    points = np.unique(np.array([int(c) ^ (1 << int(r.integers(64))) ^ (1 << int(r.integers(64))) for c in centres for _ in range(4)], np.uint64))
    df = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp long")
    got = {a["node"]: a["root"] for a in components(vptree.links(df, 2, shard=40)).collect()}
    ids = points.view(np.int64).tolist()
    assert {i: got.get(i, i) for i in ids} == brute_components(sorted(ids), [i % 2**64 for i in sorted(ids)])


def test_documents_equal_brute_force(spark):
    got = simhash.linked_documents(documents(spark), k=3, radius=2).collect()
    rows = documents(spark).select("doc_id", "text").collect()
    assert len(got) == len(rows)
    prints = {r["doc_id"]: fingerprint(r["text"], 3) for r in rows}
    assert {r["doc_id"]: r["fp"] % 2**64 for r in got} == prints
    ids = sorted(i for i in prints if i is not None)
    want = brute_components(ids, [prints[i] for i in ids])
    assert all(r["component_id"] == want[r["doc_id"]] for r in got if r["doc_id"] is not None)
    assert {r["links"] for r in got if r["doc_id"] == 11} == {1} and {r["links"] for r in got if r["doc_id"] in (4, 5, 6)} == {2}
    assert simhash.linked_documents(empty(spark)).count() == 0


@pytest.mark.parametrize("n", [1, 9])
def test_components_of_a_path_and_a_star(spark, n):
    path = [(i, i + 1) for i in range(n)] + [(i, i) for i in range(3)] + [(None, 1)]
    star = [(100, 100 + i) for i in range(1, 30)] + [(101, 100)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(path + star, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {100 + i: 100 for i in range(30)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_document_of_each_group_stays(spark):
    words = BASE.split() * 5
    r = np.random.default_rng(4)
    base = [f"{w}{r.integers(1000)}" for w in words]
    edit = lambda n: " ".join(w if i not in set(r.choice(len(base), n, replace=False)) else f"new{i}" for i, w in enumerate(base))
    other = [" ".join(f"{w}{r.integers(1000)}" for w in words) for _ in range(5)]
    rows = [(10 + i, t) for i, t in enumerate([" ".join(base), edit(2), edit(2), edit(1)] + other)] + [(3, " ".join(base)), (3, " ".join(base)), (None, None), (90, "")]
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("tid", "key", "fp", "group")})
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 14, 15, 16, 17, 18, 90]
    assert simhash.deduplicate(docs.limit(0)).count() == 0


def test_large_groups_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)
    rows = [(i, BASE + f" tail{i}") for i in range(40)]
    assert [r["doc_id"] for r in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [0]


def test_pairs_are_confirmed_by_exact_jaccard(spark, monkeypatch):
    r = np.random.default_rng(6)
    rows = []
    for _ in range(30):
        base = [f"w{x}" for x in r.integers(10**6, size=150)]
        for edits in (0, 1, 2, 4, 6, 8, 10):
            w = list(base)
            for at in r.choice(150, edits, replace=False):
                w[at] = f"new{r.integers(10**6)}"
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows) + n, " ".join(BASE.split()[:n])) for n in range(1, 20)]
    sets = {i: {tuple(t.lower().split()[p : p + 5]) for p in range(max(1, len(t.split()) - 4))} for i, t in rows}
    similar = [(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    root = {i: i for i in sets}
    for _ in sets:
        for i, j in similar:
            root[i] = root[j] = min(root[i], root[j])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(set(root.values()))
    assert 0 < len(want) < len(rows) - 30
    assert sorted(x["doc_id"] for x in simhash.deduplicate(docs).collect()) == want
    monkeypatch.setattr(simhash, "BLOCK_SHINGLES", 300)
    assert sorted(x["doc_id"] for x in simhash.deduplicate(docs).collect()) == want


def test_documents_lose_near_duplicates_and_nothing_else(spark, sf_dir):
    from collections import Counter, defaultdict
    from pathlib import Path

    larger = Path(sf_dir).parent / "sf0.01"
    docs = spark.read.parquet(f"{larger if larger.exists() else sf_dir}/documents.parquet")
    sets = {}
    for r in docs.select("doc_id", "text").collect():
        w = (r["text"] or "").encode().lower().split()
        sets[r["doc_id"]] = {tuple(w[p : p + 5]) for p in range(max(1, len(w) - 4))}
    holders = defaultdict(list)
    for i, s in sorted(sets.items()):
        for x in s:
            holders[x].append(i)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in holders[x] if j < i).items():
            if n >= 0.8 * len(s | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    want = sorted({find(i) for i in sets})
    assert len(want) < len(sets)
    assert sorted(r["doc_id"] for r in simhash.deduplicate(docs).collect()) == want


@pytest.mark.parametrize("size", [1, 4, 5, 9, 40, 300])
@pytest.mark.parametrize("late", [0, 20])
def test_prefixes_of_similar_sets_meet(size, late):
    r = np.random.default_rng(size)
    for _ in range(200):
        a = np.unique(r.integers(2**63, size=size, dtype=np.uint64))
        drop = int(r.integers(0, int(0.2 * len(a) + 1e-9) + 1))
        b = np.setdiff1d(a, r.choice(a, drop, replace=False))
        last = np.sort(r.choice(a, min(late, len(a)), replace=False))
        assert len(b) / len(a) >= 0.8 - 1e-12
        assert len(np.intersect1d(simhash.prefix(a, 0.8, last), simhash.prefix(b, 0.8, last)))


def test_any_columns_survive(spark):
    from pyspark.sql import functions as F

    rows = [(1, BASE), (2, BASE), (2, BASE), (None, "only this"), (5, BASE + " x"), (6, None)]
    docs = spark.createDataFrame(rows, "`a.b` long, text string")
    docs = docs.withColumns({"m": F.create_map(F.lit("k"), F.col("text")), "__tid": F.lit("mine"), "digest": F.lit("own"), "kept_tid_key": F.lit(1), "c`d": F.lit(2)})
    kept = simhash.deduplicate(docs, key="a.b")
    assert kept.columns == docs.columns
    got = kept.collect()
    assert {r["a.b"] for r in got} == {1, None, 6} and {r["__tid"] for r in got} == {"mine"} and got[0]["m"] is not None
    same = simhash.deduplicate(docs.where("`a.b` = 2"), key="a.b").collect()
    assert len(same) == 1 and same[0]["a.b"] == 2 and same[0]["kept_tid_key"] == 1


def test_shards_are_dealt_by_number(spark):
    points = np.random.default_rng(3).integers(0, 2**63, 4000, dtype=np.int64)
    plan = vptree.links(spark.createDataFrame([(int(p),) for p in points], "fp long"), 2, shard=400)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(shard" not in plan


def test_short_batches_keep_all_rows():
    import pyarrow as pa

    from pairloom.llm.common import short

    texts = ["", None, "a" * 30, "ä" * 4, None, "b" * 5, "", "c" * 9]
    batches = [pa.RecordBatch.from_pydict({"n": list(range(8)), "text": texts}), pa.RecordBatch.from_pydict({"n": pa.array([], pa.int64()), "text": pa.array([], pa.string())})]
    found = list(short(batches, "text", 10))
    assert [v for b in found for v in b.column("n").to_pylist()] == list(range(8))
    assert [v for b in found for v in b.column("text").to_pylist()] == texts
    assert len(found) > 2 and all(b.num_rows for b in found)
