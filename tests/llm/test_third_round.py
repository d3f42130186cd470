"""Operators 11 to 13 beside brute force, SQL and exact round trips."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from decimal import Decimal

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from momentweave.llm import divergence, infill, minhash, registry, simhash

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# SQL on the smallest tables


@pytest.mark.parametrize("name", ["op11_minhash_near_dedup", "op12_source_divergence", "op13_fill_in_middle"])
def test_beside_sql(spark, name):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{DATA}/documents.parquet')")
    got = registry.QUERIES[name](spark, DATA)
    columns = ", ".join(sorted(got.columns))
    want = duck.sql(f"SELECT {columns} FROM ({registry.ORACLES[name]})").fetchall()
    assert rows_of(got.select(sorted(got.columns))) == sorted(want, key=repr)


# 11: MinHash near-dedup


def brute_sets(text, size=2):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return frozenset()
    size = min(size, len(words))
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def brute_components(docs):
    """docs: (doc_id, text). Rows that share a doc_id are one document."""
    root = {d: d for d, _ in docs if d is not None}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(d, brute_sets(t)) for d, t in docs if d is not None]
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((top(a), top(b)))
                root[q] = p
    return [(d, len(brute_sets(t)), None if d is None else top(d), d is None or top(d) == d) for d, t in docs]


def near_copies(seed=1, families=12, n=40):
    rng, docs = random.Random(seed), []
    for f in range(families):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(3, 90))]
        for _ in range(n):
            own = [w if rng.random() > 0.02 * (f % 5) else f"v{rng.randrange(400)}" for w in words]
            docs.append(" ".join(own))
    rng.shuffle(docs)
    return list(enumerate(docs))


EDGES = [
    (900, None), (901, ""), (902, " \n\t"), (903, "One"), (904, "one"), (905, "one two"), (906, "ÉTÉ à"), (907, "été à"), (908, "a b c d"), (908, "a b c d"),
    (909, "x y z"), (910, "x y z"), (910, "p q r s"), (911, "p q r s"), (None, "x y z"), (None, None), (912, "a a a a a"), (913, "a b c"), (914, "a b\x1fc d"),
]


@pytest.mark.parametrize("shard", [2, 1_024])
def test_near_duplicates_beside_brute_force(spark, shard):
    docs = near_copies() + EDGES
    table = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, node string, n int")
    assert rows_of(minhash.near_duplicates(table, shard=shard)) == sorted(brute_components(docs), key=repr)


def test_open_buckets_are_compared_in_shards(spark):
    """A chain: each text is close to the next ones alone, so heads don't settle it; and many texts that share words only."""
    words = [f"w{i}" for i in range(400)]
    chain = [(i, " ".join(words[3 * i : 3 * i + 60])) for i in range(100)]
    shared = " ".join(f"common{i}" for i in range(30))
    docs = chain + [(1000 + i, shared + " " + " ".join(f"own{i}x{k}" for k in range(20))) for i in range(120)]
    assert rows_of(minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), shard=8)) == sorted(brute_components(docs), key=repr)


def test_near_duplicates_of_nothing(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert rows_of(minhash.near_duplicates(spark.createDataFrame([(None, None)], "doc_id long, text string"))) == [(None, 0, None, True)]


def test_near_duplicates_of_long_texts(spark):
    long = " ".join(f"w{i % 70_001}" for i in range(700_000))  # 4 MB
    docs = [(1, long), (2, long + " end"), (3, "x" * 3_000_000), (4, "X" * 3_000_000), (5, " ".join(f"w{i}" for i in range(60_000)))]
    got = rows_of(minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).select("doc_id", "component_id"))
    assert got == [(1, 1), (2, 1), (3, 3), (4, 3), (5, 1)]


def test_shingle_sets_do_not_depend_on_blocks(monkeypatch):
    docs = [t.encode() if t else b"" for _, t in near_copies(2, 3, 5) + EDGES]
    h, doc = minhash.shingle_sets(docs)
    monkeypatch.setattr(minhash, "_BLOCK", 7)
    again = minhash.shingle_sets(docs)
    assert (h == again[0]).all() and (doc == again[1]).all()
    assert np.bincount(doc, minlength=len(docs)).tolist() == [len(brute_sets(d.decode())) for d in docs]


def test_signatures_are_minima_under_one_shifted_permutation(monkeypatch):
    rng = np.random.default_rng(3)
    h, first = rng.integers(0, 2**63, 300).astype(np.uint64), np.array([0, 1, 120, 290])
    monkeypatch.setattr(minhash, "_SLICE", 50)
    got = minhash.signatures(h, first, 20)

    def pi(v):
        v ^= v >> 33
        v = v * int(minhash._PI[0]) % 2**64
        v ^= v >> 29
        return v * int(minhash._PI[1]) % 2**64

    sigma = [int(x) for x in minhash.mix(h ^ minhash._SEED)]
    for k in range(20):
        for s, (a, b) in enumerate(zip(first, [*first[1:], 300])):
            assert int(got[k, s]) == min(pi((x - k - 1) % 2**64) for x in sigma[a:b])


def test_coordinates_agree_as_often_as_sets_do():
    rng = np.random.default_rng(5)
    off = []
    for _ in range(200):
        common, x, y = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (80, 10, 10))
        least = minhash.signatures(np.concatenate([common, x, common, y]), np.array([0, 90]))
        off.append((least[:, 0] == least[:, 1]).mean() - 0.8)
    assert abs(np.mean(off)) < 0.01 and np.std(off) < 0.04


# 12: source divergence


def brute_divergence(docs, least_docs, top):
    """docs: (text, lang, source), in whole Python numbers."""
    found, seen, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)
        groups[lang].add(source)
        found[lang, source].update(terms)
        seen[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in seen[lang].items() if n >= least_docs]
        whole = Counter()
        for s in sources:
            whole.update(found[lang, s])

        def shares(counts):
            mass = sum(counts[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // mass for t in kept}

        p, q = {s: shares(found[lang, s]) for s in sources}, shares(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            over = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if found[lang, s][t] and p[s][t] > q[t])
            for part, ranked in (("pair", pairs), ("term", over[:top])):
                out += [(lang, s, part, item.decode(), -v, k) for k, (v, item) in enumerate(ranked, 1)]
    return out


def test_divergence_beside_brute_force(spark):
    rng = random.Random(7)
    terms = ["Le", "le", "été", "ÉTÉ", "naïve", "x", "日本", "𝔘ni", "z9z", "don't", "mid_dle", "A", "b"]
    docs = [(" ".join(rng.choices(terms, k=rng.randrange(30))), rng.choice(["en", "EN", None, ""]), rng.choice(["b", "B", "é", None, "", "𝔘", "￿"])) for _ in range(300)]
    docs += [(None, "en", "only null"), ("", "fr", "one"), ("12 34 !", "fr", "two"), ("lonely", "de", "single"), (docs[0][0],) + docs[0][1:]]
    table = spark.createDataFrame([(*d, 1, "x") for d in docs], "text string, lang string, source string, n int, term string")
    got = divergence.divergence(table, least_docs=3, top=4)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert rows_of(got) == sorted(brute_divergence(docs, 3, 4), key=repr)


def test_divergence_of_nothing(spark):
    assert divergence.divergence(spark.createDataFrame([], SCHEMA)).count() == 0
    assert rows_of(divergence.divergence(spark.createDataFrame([(1, None, None, None), (2, "a", None, "s")], SCHEMA))) == [
        ("", "", "pair", "s", 0, 1), ("", "s", "pair", "", 0, 1)
    ]


def test_divergence_of_long_texts(spark):
    docs = [(" ".join(f"w{chr(97 + i % 26)}" for i in range(400_000)), "en", s) for s in ("a", "b")] + [("y" * 2_000_000, "en", "c"), ("wa wb", "en", "c")]
    assert rows_of(divergence.divergence(spark.createDataFrame(docs, "text string, lang string, source string"), least_docs=1)) == sorted(brute_divergence(docs, 1, 10), key=repr)


@pytest.mark.parametrize("n,mass", [(0, 1), (5, 9), (10**14, 10**15), (8 * 10**15, 9 * 10**15), (123456789012, 987654321098765)])
def test_shares_are_exact_beyond_64_bits(spark, n, mass):
    got = spark.createDataFrame([(n, mass)], "n long, mass long").select(divergence._share(F.col("n"), F.col("mass"))).first()[0]
    assert got == 1 + 10**9 * (n + 2) // mass == int(Decimal(10**9) * (n + 2) // mass) + 1


# 13: fill-in-middle


def brute_infill(doc_id, text, seed=1):
    text, d = text or "", hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(s in text for s in infill.SENTINELS) or h[2] % 100 >= 90:
        return doc_id, text, n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    form = "spm" if h[3] % 100 < 20 else "psm"
    return doc_id, text, n, form, a, b - a, f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


def test_fill_in_middle_beside_brute_force(spark):
    rng = random.Random(11)
    texts = ["", None, "a", "é", "日本語", "𝔘", "a<P>b", "<S>", "x<M>", "<<P", "><", "<P ><S", "\x00a\x7f", "a\r\n b", "é" * 50, "ab日" * 40]
    docs = [(i, texts[i % len(texts)] if i % 2 else "".join(rng.choices("ab<>PSMé日𝔘 \n", k=rng.randrange(60)))) for i in range(800)] + [(None, "null id"), (3, "again"), (3, "again")]
    made = infill.fill_in_middle(spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, at int, form string"))
    want = [brute_infill(*d) for d in docs]
    assert rows_of(made) == sorted(want, key=repr)
    assert {w[3] for w in want} == {"plain", "psm", "spm"}
    assert made.where(~infill.restored().eqNullSafe(F.col("text"))).count() == 0


def test_fill_in_middle_of_nothing_and_of_text_ids(spark):
    assert infill.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    made = infill.fill_in_middle(spark.createDataFrame([("k1", "some text")], "doc_id string, text string"), rate=100, seed=9)
    assert rows_of(made)[0][0] == "k1" and made.select(infill.restored()).first()[0] == "some text"


def test_fill_in_middle_of_long_texts(spark):
    docs = [(i, t * 300_000) for i, t in enumerate(["aé日𝔘", "plain ascii ", "日本語"])]
    assert rows_of(infill.fill_in_middle(spark.createDataFrame(docs, "doc_id long, text string"))) == sorted((brute_infill(*d) for d in docs), key=repr)


def test_sentinels_that_could_not_be_told_apart_are_refused(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for bad in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("<P<", "<S>", "<M>"), ("aa", "b", "c")):
        with pytest.raises(ValueError):
            infill.fill_in_middle(docs, sentinels=bad)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab\x00é߿日￿𝔘", max_size=60), st.integers(1, 9))
def test_runs_find_each_unit(text, block):
    runs = infill.Runs(text.encode(), block)
    assert len(runs) == len(text)
    assert [runs.byte(k) for k in range(len(text) + 1)] == [len(text[:k].encode()) for k in range(len(text) + 1)]
    classes = [len(c.encode()) for c in text]
    assert runs.width.tolist() == [c for i, c in enumerate(classes) if not i or c != classes[i - 1]]


# 8, in the pipeline


def test_stage_counts_bits_of_whole_fingerprints():
    """Fingerprints that differ in the highest bit too are as near as their bits say."""
    a, b, c = 0, (1 << 63) | 0b111, 2**64 - 1
    group = simhash.pa.table({
        "side": [0, 0, 0], "fingerprint": np.array([a, b, c], np.uint64).view(np.int64), "component": [1, 2, 3], "band": [0, 0, 0], "bands": [[1], [1], [1]],
    })
    assert [list(map(int, x)) for x in simhash._near(group, 20)] == [[1], [0]]


def test_stage_trees_are_those_of_adding_in_order():
    rng = np.random.default_rng(3)
    prints = rng.integers(0, 1 << 64, (300, 2), np.uint64)
    for k in range(100, 200):  # near others, some of them equal
        prints[k] = prints[k - 100] ^ np.array([sum(1 << int(b) for b in rng.choice(64, k % 20, replace=False)), 0], np.uint64)
    starts = np.array([0, 40, 41, 250])
    forest = simhash.BKForest(prints, starts)
    whole = [int(a) | int(b) << 64 for a, b in prints.tolist()]
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), 300], strict=True):
        tree = simhash.BKTree()
        for fp in whole[a:b]:
            tree.add(fp)
        for k, children in enumerate(tree.children):
            of = forest.children[forest.first[a + k] : forest.first[a + k] + forest.count[a + k]]
            assert {int(forest.edge[c]): int(c) - a for c in of} == children
    group = np.searchsorted(starts, np.arange(300), "right")
    before = np.arange(300) // 5 * 5  # as components of five rows each have it
    got = set(zip(*(x.tolist() for x in forest.near(simhash.STAGE_RADIUS, before)), strict=True))
    assert got == {(x, y) for x in range(300) for y in range(before[x]) if group[x] == group[y] and (whole[x] ^ whole[y]).bit_count() <= simhash.STAGE_RADIUS}
    assert len(got) > 50


def test_stage_tables_bring_similar_fingerprints_together():
    """Of pairs of similarity four fifths nearly all agree in a table's bits and lie within the radius, at any size."""
    rng = np.random.default_rng(5)
    pairs = []
    for _ in range(3_000):  # 90 hashes each, 80 of them shared
        h = rng.integers(0, 1 << 64, 100, np.uint64)
        pairs.append((simhash.wide_print(h[:90]), simhash.wide_print(h[10:])))
    a, b = (np.array(x) for x in zip(*pairs, strict=True))
    near = (a[:, : 64 * simhash.COMPARED] != b[:, : 64 * simhash.COMPARED]).sum(1) <= simhash.STAGE_RADIUS
    for n in (0, 1, 100, 50_000, 250_000, 15_000_000):
        _, tables = simhash.tables_of(n, 0.8)
        met = near & np.any([(a[:, t] == b[:, t]).all(1) for t in tables], axis=0)
        assert met.mean() > 0.998, n
    assert tables.shape[1] == 17  # so unlike fingerprints share a bucket with about 128


def test_stage_groups_stay_whole_over_batches(monkeypatch):
    monkeypatch.setattr(simhash, "FOREST", 5)
    group = np.repeat(np.arange(9), [1, 3, 7, 1, 1, 2, 12, 1, 4])
    for size in (1, 2, 3, 5, 40):
        batches = [simhash.pa.RecordBatch.from_pydict({"group": group[k : k + size]}) for k in range(0, len(group), size)]
        tables = [t["group"].to_pylist() for t in simhash._groups(iter(batches))]
        assert sum(tables, []) == group.tolist()
        assert all(x[-1] != y[0] for x, y in zip(tables, tables[1:])) and (size > 20 or len(tables) > 2)


def test_stage_holds_shards_and_bands_of_one_forest():
    """Two groups in one table: one with sides, one without; a pair counts in its first common band alone."""
    fp = [0, 1, 3, 0, 1, 1 << 40]
    told = {"group": [1, 1, 1, 2, 2, 2], "side": [0, 0, 1, 0, 0, 0], "fingerprint": fp, "further": [0] * 6, "component": [1, 2, 3, 1, 2, 2], "band": [1] * 6}
    pairs = lambda t: set(zip(*(x.tolist() for x in simhash._near(simhash.pa.table(t), 20)), strict=True))
    assert pairs(told) == {(2, 0), (2, 1), (4, 3), (5, 3)}
    assert pairs(told | {"bands": [[5, 7], [6, 7], [5, 7], [8, 9], [9, 9], [8, 9]]}) == {(2, 1), (4, 3)}


def test_stage_rows_do_not_grow_with_the_square_of_a_linked_group(spark):
    """Rows of different components all meet; a linked group's own rows don't, so its shards make few rows."""
    made = {}
    for n in (400, 1600):
        rows = [(0, 7, k, 1 if k >= 30 else 5_000 + k // 2, 10) for k in range(n)] + [(0, 8, k, 1, 10) for k in range(n)] + [(1, 9, k, k, 10) for k in range(90)]
        keyed = spark.createDataFrame(rows, "band int, key int, node long, component long, bytes long").repartition(4)
        groups = simhash.dealt(keyed, 40).toPandas()
        made[n] = len(groups[groups.key == 7])
        assert not (groups.key == 8).any()
        assert groups.groupby("group").size().max() < 160
        for key, nodes in ((7, n), (9, 90)):
            met = set()
            for _, g in groups[groups.key == key].groupby("group"):
                two = g.side.any()
                for x, p, s in zip(g.node, g.component, g.side, strict=True):
                    met |= {(x, y) for y, q, t in zip(g.node, g.component, g.side, strict=True) if x < y and p != q and (not two or s != t)}
            of = {k: (1 if k >= 30 else 5_000 + k // 2) if key == 7 else k for k in range(nodes)}
            assert met == {(x, y) for x in of for y in of if x < y and of[x] != of[y]}
    assert made[1600] < 5 * made[400] and made[1600] < 2 * 1600 + 30


def test_stage_compares_likely_partners_alone(spark, monkeypatch):
    """Texts that share a passage, similar by a quarter: most have partners by 128 bits, few by all bits and by size."""
    rng, asked, cut = np.random.default_rng(17), [], simhash.cut

    def counting(df, label):
        found = cut(df, label)
        asked.extend([found.count()] if label == "asking" else [])
        return found

    monkeypatch.setattr(simhash, "cut", counting)
    passage = " ".join(f"p{k}" for k in range(80))
    rows = [(i, passage + " " + " ".join(f"w{k}" for k in rng.integers(0, 10**6, 100))) for i in range(120)]
    rows += [(200 + i, rows[i][1] + " end") for i in range(3)]
    got = simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r.doc_id, r.component_id) for r in got.collect()} == {(i, i % 200) for i, _ in rows}
    assert asked[-1] < 40
    told = {"fingerprint": [0, 1, 3], "component": [1, 2, 3], "size": [10, 8, 7], "side": [0] * 3}
    assert [x.tolist() for x in simhash._near(simhash.pa.table(told), 20, 0.8)] == [[1, 2], [0, 1]]
