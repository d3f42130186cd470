"""The ten operators against brute force, SQL, the library's own encoder, or held-out labels; and on odd tables."""

import hashlib
import itertools
import re
import tempfile
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import regex
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as pb

from momentweave.llm import boosting, chat, language_id, licenses, mixing, neighbours, quality, sentencepiece_codec, simhash, suffix_dedup
from momentweave.llm.text_stats import FEATURES

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, size string, key string, spans string, fingerprint string, copies string"
LONG = "a word or two and more of it. " * 4000


def odd_rows():
    texts = [(1, "The quick brown fox jumps over the lazy dog and runs away from it all."), (2, None), (3, ""), (4, " \n\t "), (5, "12 34 !!"),
             (6, LONG), (7, LONG), (1, "The quick brown fox jumps over the lazy dog and runs away from it all."), (None, "no id here, but some words"), (8, "é è 日本語 ▁ 🙂"), (9, "x" * 250 + "y" * 150)]
    return [(i, t, None if k % 3 else "en", None if k % 4 == 0 else f"s{k % 2}", 1, "a", "b", "c", "d", "e", "f") for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_language_id(spark, odd, none, docs):
    r = language_id.op1_language_id(spark, DATA).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    held = r[r.held_out]
    assert len(held) > 20 and (held.lang_pred == held.lang).mean() > 0.95 and r.score.between(0, 1).all() and not r.rejected.any()
    model = language_id.fit(docs)
    got = language_id.identify_languages(odd, model).collect()
    assert len(got) == 11 and got[0]["source"] is None
    assert [x.lang_pred == "und" for x in got] == [x.text is None or not regex.search(r"\p{L}", x.text) for x in got]
    assert language_id.keep_identified(odd, model).columns == odd.columns
    assert language_id.identify_languages(none, model).count() == 0
    assert {x.lang_pred for x in language_id.identify_languages(odd, language_id.fit(none)).collect()} == {"und"}


def plain_model(texts):
    """Interpolated Kneser-Ney of one language over whole dictionaries: a function of context and character."""
    levels = {5: Counter()}
    for t in texts:
        for w in regex.findall(r"\p{L}+", (t or "").lower()):
            padded = "\x02" * 4 + w + "\x02"
            levels[5].update(padded[i : i + 5] for i in range(len(w) + 1))
    for n in (4, 3, 2, 1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])
    held = {}
    for n, level in levels.items():
        ones, twos = (sum(c == k for c in level.values()) for k in (1, 2))
        d = min(max(ones / (ones + 2 * twos) if ones else 0.5, 0.1), 0.9)
        total, kinds = Counter(), Counter()
        for g, c in level.items():
            total[g[:-1]] += c
            kinds[g[:-1]] += 1
        held[n] = d, total, kinds

    def p(gram, alphabet):
        if not gram:
            return 1 / alphabet
        d, total, kinds = held[len(gram)]
        lower = p(gram[1:], alphabet)
        h = gram[:-1]
        return max(levels[len(gram)][gram] - d, 0) / total[h] + d * kinds[h] / total[h] * lower if total[h] else lower

    return p


def plain_cross_entropy(p, alphabet, text):
    total = n = 0
    for w in regex.findall(r"\p{L}+", (text or "").lower()):
        padded = "\x02" * 4 + w + "\x02"
        for i in range(len(w) + 1):
            total, n = total - np.log(p(padded[i : i + 5], alphabet)), n + 1
    return total / max(n, 1)


def test_language_models_are_those_of_plain_dictionaries(spark, docs):
    model = language_id.fit(docs)
    trial = (F.pmod(F.xxhash64(F.lit("trial"), "doc_id"), F.lit(10)) == 0).alias("trial")
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang", trial).collect()
    assert model.languages == tuple(sorted({r.lang for r in rows}))
    learned = {lang: [r.text for r in rows if r.lang == lang and not r.trial] for lang in model.languages}
    letters = {c for ts in learned.values() for t in ts for w in regex.findall(r"\p{L}+", t.lower()) for c in w}
    assert model.alphabet == len(letters) + 2  # and the edge of a word, and any other character
    plain = [plain_model(learned[lang]) for lang in model.languages]
    texts = [r.text[:400] for r in rows if r.trial][:8] + ["qqq zzz", "½ ² Ⅷ", "日本 é"]
    chars, got = model.cross_entropy(texts)
    assert chars[-2] == 0  # neither fractions nor numerals are letters
    want = [[plain_cross_entropy(p, model.alphabet, t) for p in plain] for t in texts]
    assert np.allclose(got, want, rtol=1e-9)


def test_no_language_is_dropped(spark):
    rows = [(k * 20 + i, " ".join(f"{chr(97 + k % 26)}{chr(97 + (k // 26 + j) % 26)}" for j in range(i + 3)), f"l{k:03d}") for k in range(60) for i in range(20)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.languages) == 60
    few = spark.createDataFrame([(7, "many rows of one id", "x")] * 900 + [(8, None, "x"), (None, "no id", "x")], "doc_id long, text string, lang string")
    assert language_id._sample(few.where("text IS NOT NULL"), 10_000, 1_000_000).count() == 2
    assert language_id.fit(few).languages == ("x",)
    alone = [(k, f"{chr(97 + k % 26)}{chr(97 + k // 26)} only one text teaches this", f"l{k:03d}") for k in range(60)] + [(99, "long " * 30, "big")]
    model = language_id.fit(spark.createDataFrame(alone, "doc_id long, text string, lang string"), characters_per_language=40)
    assert model.languages == tuple(sorted(r[2] for r in alone))


def test_licenses(spark, odd, none):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{DATA}/documents.parquet')")
    want = sorted((int(a), b, round(x, 9)) for a, b, x in c.sql(licenses.OP2_SQL).fetchall())
    assert sorted((r.doc_id, r.license, round(r.containment, 9)) for r in licenses.op2_license_scan(spark, DATA).collect()) == want
    changed = licenses.TEMPLATES["MIT"].split()
    changed[10], changed[60] = "xx", "yy"
    text = "Some words before. " * 30 + "\n".join(changed) + " and after it " * 30
    found = licenses.scan_licenses(spark.createDataFrame([(1, text), (2, " ".join(changed[:60])), (None, None)], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.license) for r in found] == [(1, "MIT")] and 0.8 <= found[0].containment < 1
    assert licenses.scan_licenses(odd).count() == 0 and licenses.scan_licenses(none).count() == 0
    assert licenses.scan_licenses(odd, {}).count() == 0


@pytest.mark.parametrize("joined", [False, True])
def test_templates_of_every_scale_are_found_wherever_they_lie(spark, monkeypatch, joined):
    if joined:
        monkeypatch.setattr(licenses, "MOST_KEYS", 0)
    rng = np.random.default_rng(6)
    vocabulary = [f"w{k}" for k in range(400)]
    templates = {f"t{n}": " ".join(rng.choice(vocabulary, n)) for n in (5, 7, 12, 16, 20, 27, 40, 52, 90, 200)}
    rows, want = [], set()
    for i in range(150):
        name = f"t{rng.choice((5, 7, 12, 16, 20, 27, 40, 52, 90, 200))}"
        words_ = templates[name].split()
        for k in rng.choice(len(words_), int(len(words_) * rng.uniform(0, 0.06)), replace=False):
            words_[k] = "other"
        text = " ".join([*rng.choice(vocabulary, int(rng.integers(0, 60))), *words_, *rng.choice(vocabulary, int(rng.integers(0, 60)))])
        rows.append((i, text))
        held = five_words(text)
        want |= {(i, t) for t, x in templates.items() if len(five_words(x) & held) >= 0.8 * len(five_words(x))}
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), templates)
    assert len({t for _, t in want}) == 10 and {(r.doc_id, r.license) for r in got.collect()} == want


def base(text):
    text = text or ""
    w, lines, seen = words(text), text.split("\n"), set()
    dup = 0
    for line in lines:
        if words(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered)


def test_quality_rules(spark, odd, none, docs):
    got = quality.op3_quality_rules(spark, DATA).toPandas().set_index("doc_id")
    texts = docs.toPandas().set_index("doc_id").text
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert {i: tuple(got.loc[i, counts]) for i in texts.index} == {i: base(t) for i, t in texts.items()}
    fails = (got.n_words < 10) | (100 * got.n_repeat_words > 20 * got.n_words)
    assert (got.base_failed == fails).all() and not (got.kept & fails).any() and got.kept.mean() > 0.7
    trees = quality.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"), constrained=True)
    rows = quality.quality_rules(odd, trees).collect()
    assert sorted((r.n_words, r.n_repeat_words) for r in rows) == sorted((base(r[1])[0], base(r[1])[4]) for r in odd_rows())
    assert quality.quality_rules(none, trees).count() == 0
    assert quality.quality_rules(odd, quality.fit(none.select("doc_id", "text"), spark.createDataFrame([], "doc_id long, quality int"))).count() == 11


def test_trees_learn_and_keep_their_constraints():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    y = ((x[:, 0] < 0.5) ^ (rng.random(2000) < 0.05)).astype(float)
    t = boosting.fit_trees(x, y, monotone=np.array([-1, 1, 0]))
    assert ((t.score(x) > 0.5) == y).mean() > 0.93
    for j, sign in ((0, -1), (1, 1)):
        grid = np.repeat(x[:50], 30, 0)
        grid[:, j] = np.tile(np.linspace(0, 1, 30), 50)
        assert (sign * np.diff(t.margin(grid).reshape(50, 30), axis=1) >= -1e-12).all()
    assert len(FEATURES) == len(set(FEATURES))


def test_mixing(spark, odd, none):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{DATA}/documents.parquet')")
    want = sorted((a, b, s, round(t, 6), n) for a, b, s, t, n in c.sql(mixing.OP4_SQL).fetchall())
    got = mixing.op4_source_mixing(spark, DATA)
    assert sorted((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in got.collect()) == want
    rows = mixing.mix_sources(odd).toPandas()
    assert len(rows) == 11 and (rows.taken <= 2 * rows["size"]).all()
    for _, g in rows.groupby("source", dropna=False):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= g["size"].max() / 2 + 1e-6
    taken = mixing.take_mix(odd)
    assert taken.columns == odd.columns and taken.count() == rows.copies.sum()
    assert mixing.mix_sources(none).count() == 0 and mixing.take_mix(none).count() == 0


def test_mixing_draws_by_inclusion_odds(spark):
    rows = [(i, "big" if i % 2 else "small", "w " * (400 if i % 4 < 2 else 40)) for i in range(4000)]
    rows += [(None, "big", "same words here " * 20)] * 600  # equal rows: no order of their own
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    r = mixing.mix_sources(docs, share=0.5, bins=8).toPandas()
    for _, g in r.groupby("source"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 200 and set(g.copies) <= {0, 1}
        rest, size = g.target.iloc[0], g["size"].to_numpy(float)
        p = np.minimum(1, size * rest / (size**2).sum())  # nobody is certain here
        assert p.max() < 1
        for n in np.unique(size):
            many = (size == n).sum()
            assert abs((g.copies[size == n] > 0).mean() - p[size == n][0]) < 4 / np.sqrt(many)
        large, small = (g.copies[size == n].mean() for n in (400, 40))
        assert large > 4 * small  # equal odds would make them alike
    again = mixing.mix_sources(docs.repartition(7), share=0.5, bins=8).toPandas()
    key = ["source", "size", "doc_id", "copies"]
    assert sorted(map(str, r[key].values.tolist())) == sorted(map(str, again[key].values.tolist()))


def test_mixing_takes_certain_documents_first(spark):
    rows = [(0, "a", "w " * 5000), *((i, "a", "w " * 10) for i in range(1, 500))]
    r = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, source string, text string"), share=0.7).toPandas().set_index("doc_id")
    assert r.copies[0] == 1 and abs(r.taken.sum() - 0.7 * 9990) <= 5


def test_quality_classifier(spark, odd):
    r = quality.op5_quality_classifier(spark, DATA).toPandas().merge(spark.read.parquet(f"{DATA}/labels.parquet").toPandas(), on="doc_id")
    held = r[r.held_out]
    assert (held.predicted == held.quality).mean() > 0.85 and r.score.between(0, 1).all()
    trees = quality.fit(spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet"))
    rows = quality.quality_classifier(odd, trees).collect()
    assert len(rows) == 11 and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in rows)


def test_tree_scores_are_those_of_a_walk_by_row(spark, docs, none):
    trees = quality.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"), constrained=True)
    texts = [r.text for r in docs.limit(60).collect()] + [None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", "text", quality.features("text").alias("x"))
    got = {r.doc_id: r.score for r in quality.quality_classifier(rows, trees).collect()}
    for r in rows.collect():
        margin = trees.base
        for feature, threshold, leaf in zip(trees.feature, trees.threshold, trees.leaf, strict=True):
            k = 0
            while k < len(feature):
                k = 2 * k + (2 if r.x[feature[k]] > threshold[k] else 1)
            margin += leaf[k - len(feature)]
        assert abs(got[r.doc_id] - 1 / (1 + np.exp(-margin))) < 1e-12
    assert quality.quality_classifier(none, trees).count() == 0
    clash = docs.limit(5).withColumns({c: F.lit("mine") for c in ("predicted", "kept", "n_words", "base_failed", "lang_pred", "token_ids", "round_trip")})
    assert {type(r.predicted) for r in quality.quality_classifier(clash, trees).collect()} == {int}
    assert {type(r.kept) for r in quality.quality_rules(clash, trees).collect()} == {bool}
    assert {type(r.token_ids) for r in sentencepiece_codec.encode_decode(clash).collect()} == {list}
    assert "mine" not in {r.lang_pred for r in language_id.identify_languages(clash, language_id.fit(docs)).collect()}


def test_sample_of_labelled_rows_is_bounded_when_ids_repeat(spark):
    rows = [(1, f"text number {k % 5000} of many words") for k in range(12_000)] + [(2, "another text")] * 3
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert quality.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels, rows=500).leaf.shape[0] > 0


def test_chat_roles_of_held_out_conversations(spark):
    more = DATA.replace("sf0.001", "sf0.01")  # the smallest table holds out two conversations
    turns = spark.read.parquet(f"{more}/conversations.parquet")
    got = chat.op6_chat_formatting(spark, more).toPandas()
    assert len(got) == turns.count() and got.held_out.any()
    both = got.merge(turns.select("conv_id", "turn", F.col("role").alias("true")).toPandas(), on=["conv_id", "turn"])
    assert (both.role == both.true)[both.held_out].mean() > 0.9


@pytest.mark.parametrize("block", [2, 12])
def test_chat_paths_and_rendering(spark, monkeypatch, block):
    monkeypatch.setattr(chat, "BLOCK", block)
    turns = spark.read.parquet(f"{DATA}/conversations.parquet")
    model = chat.fit(turns)
    rng, texts = np.random.default_rng(1), [r.text for r in turns.collect()]
    rows = [(7, i, ("User: " if rng.random() < 0.05 else "") + texts[rng.integers(len(texts))]) for i in range(150)]
    rows += [(None, 0, "Assistant: hello"), (None, None, None), (8, 0, ""), (8, 0, ""), (9, 3, "x" * 70_000 + "\n" * 200_000 + "what?" + " " * 300)]
    rows += [(10, 0, "System: be kind\nUser: hi there\nhow are you?\n ** Assistant ** : fine\n\n[user]: and now?"), (10, 1, " " * 500 + "Bot: bye. ")]
    rows += [(11, 5, f"one number {k % 3}") for k in range(90)] + [(11, 5, "Q: the same?")] * 40
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string").withColumn("role", F.lit("?"))
    out = chat.parse_transcripts(df, model).toPandas().sort_values("seq")
    assert len(out) == len(rows) + 3 and (out.opens | ~out.rendered.str.startswith("<|")).all()
    feed = chat.lines_of(df.withColumn("h", F.xxhash64("text")), "conv_id", "h").toPandas()
    feed = feed.sort_values(["turn", "h", "part"], na_position="first")
    for (_, lines), (_, told) in zip(out.groupby("conv_id", dropna=False), feed.groupby("conv_id", dropna=False), strict=True):
        scores = model.observe(told[list(chat.FEATURES)].to_numpy(int), told.marker.to_numpy(int))
        path = [chat.ROLES.index(x) for x in lines.role]
        best = model.first + scores[0]
        for row in scores[1:]:
            best = (best[:, None] + model.step).max(0) + row
        own = model.first[path[0]] + scores[0][path[0]] + sum(model.step[a, b] + scores[i + 1][b] for i, (a, b) in enumerate(itertools.pairwise(path)))
        assert own == best.max()
        want = "".join(f"<|{role}|>\n" + "\n".join(said for _, said in g) + "\n<|end|>\n" for role, g in itertools.groupby(zip(lines.role, told.said, strict=True), key=lambda x: x[0]))
        assert "".join(lines.rendered) == want
    ten = out[out.conv_id == 10]
    assert ten.role.tolist() == ["system", "user", "assistant", "user", "assistant"]
    assert "".join(ten.rendered).startswith("<|system|>\nbe kind\n<|end|>\n<|user|>\nhi there\nhow are you?\n<|end|>\n<|assistant|>\nfine\n<|end|>\n")
    whole = {r.conv_id: r.text for r in chat.transcripts(chat.parse_transcripts(df, model)).collect()}
    assert whole[10] == "".join(ten.rendered) and len(whole) == 6
    assert chat.parse_transcripts(df.limit(0), model).count() == 0


def test_suffix_arrays():
    rng = np.random.default_rng(0)
    for _ in range(300):
        s = rng.integers(0, rng.integers(2, 6), rng.integers(1, 60))
        b = s.tolist()
        sa = suffix_dedup.suffix_array(s)
        assert sa.tolist() == sorted(range(len(b)), key=lambda i: b[i:])
        want = [0] * len(b)
        for x, y in zip(sa[:-1].tolist(), sa[1:].tolist(), strict=True):
            n = 0
            while x + n < len(b) and y + n < len(b) and b[x + n] == b[y + n] != 0:
                n += 1
            want[y] = n
        assert suffix_dedup.common_prefixes(s, sa).tolist() == want


def kept_by_brute_force(rows):
    seen, out = set(), []
    for t in rows:
        b = (t or "").encode()
        cover = bytearray(len(b))
        for k in range(len(b) - 99):
            w = b[k : k + 100]
            if w in seen:
                cover[k : k + 100] = b"\1" * 100
            seen.add(w)
        left = bytes(x for x, c in zip(b, cover, strict=True) if not c)
        out.append((len(b), sum(cover), sum(1 for k in range(len(b)) if cover[k] and not (k and cover[k - 1])), hashlib.sha256(left).hexdigest()))
    return out


@pytest.mark.parametrize("parted", [0, 1, 1 << 18])
def test_suffix_dedup(spark, odd, none, monkeypatch, parted):
    if parted:  # one cell: every anchor is split with the most frequent one
        for name, value in {"HOT_SHARE": 1, "PART_ROWS": 2, "SHARD_SEGMENTS": 2, "SHARD_BYTES": 5_000, "CELLS": parted}.items():
            monkeypatch.setattr(suffix_dedup, name, value)
    rng = np.random.default_rng(3)
    vocabulary = ["".join(rng.choice(list("abcdé "), rng.integers(3, 9))) for _ in range(200)]
    passage = " ".join(rng.choice(vocabulary, 40))
    texts = [" ".join(rng.choice(vocabulary, 60)) for _ in range(20)]
    texts += [texts[0], texts[1][:150] + "#" + texts[1][151:], None, "", "z" * 400] + [f"{k} " + passage + f" {k * 7}" for k in range(12)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = suffix_dedup.removed_digest(df).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == kept_by_brute_force(texts)
    if not parted:
        assert suffix_dedup.removed_digest(odd).count() == 11 and suffix_dedup.removed_digest(none).count() == 0
        cleaned = suffix_dedup.remove_repeats(odd)
        assert cleaned.columns == odd.columns
        left = {(r.doc_id, len(r.text or "")) for r in cleaned.collect()}
        assert (7, 0) in left and (2, 0) in left and cleaned.where("doc_id = 2 AND text IS NULL").count() == 1


def test_suffix_dedup_of_long_periodic_texts(spark, monkeypatch):
    texts = ["x" * 5_000_000, "ab" * 300, "y" + "x" * 120, "ba" * 300, None]
    got = suffix_dedup.removed_digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert (got[0].n_removed, got[0].n_spans) == (4_999_999, 1) and got[0].kept_sha256 == hashlib.sha256(b"x").hexdigest()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got[1:]] == kept_by_brute_force(["x" * 200, *texts[1:]])[1:]
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 700)  # chunks of one text
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("ab"), 900)) + "c" * 2000 + "ab" * 900, "".join(rng.choice(list("ab"), 3000)), "b" + "ab" * 500 + "c" * 150]
    texts += [texts[1][1000:2500] + texts[0][:800]]
    rows = next(suffix_dedup._find_anchors(100, 32)(iter([pa.RecordBatch.from_pydict({"key": [0], "text": ["x" * 100_000]}, pa.schema([("key", pa.int64()), ("text", pa.string())]))])))
    assert len(rows) <= 3
    got = suffix_dedup.removed_digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == kept_by_brute_force(texts)


def brute_print(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[k : k + 3]) for k in range(max(len(w) - 2, 1))] if w else []
    bits = np.zeros(64, int)
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        bits += [(h >> k) & 1 for k in range(64)]
    return sum(1 << k for k in range(64) if 2 * bits[k] > len(shingles))


def test_simhash(spark, odd, none, docs):
    texts = docs.toPandas().set_index("doc_id").text
    prints = {i: brute_print(t) for i, t in texts.items()}
    root = {i: i for i in prints}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op8_simhash_near_dedup(spark, DATA).collect()}
    assert got == {i: (format(prints[i], "016x"), top(i)) for i in ids}
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == 11 and {r.fingerprint for r in rows if r.doc_id in (2, 3, 4)} == {"0" * 16}
    assert {r.component_id for r in rows if r.doc_id in (6, 7)} == {6} and {r.component_id for r in rows if r.doc_id in (2, 3, 4)} == {2}
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 5, 6, 8, 9]
    assert simhash.near_duplicates(none).count() == 0


def test_simhash_shards_and_chains(spark):
    prints = [0]
    for k in range(40):
        prints.append(prints[-1] ^ (1 << k) ^ (1 << (k + 20)))
    nodes = spark.createDataFrame([(fp, 100 - i) for i, fp in enumerate(prints)], "fingerprint long, node long")
    links = simhash.link(nodes, shard=4)
    found = {r.node: r.component for r in simhash.components(links).collect()}
    assert set(found.values()) == {60} and len(found) == 40


def test_simhash_splits_a_large_bucket_again(spark):
    rng = np.random.default_rng(11)
    far = rng.integers(0, 1 << 47, 3_000) << 16 | 0xBEEF  # one block of 16 bits in common
    near = far[:600] ^ np.array([sum(1 << int(b) for b in rng.choice(47, k % 5, replace=False) + 16) for k in range(600)])
    tight = [0xBEEF | sum(1 << int(b) for b in c) for c in itertools.islice(itertools.combinations(range(16, 26), 5), 200)]  # share more blocks
    prints = np.unique(np.concatenate((far, near, tight))).astype(np.int64)
    close = np.bitwise_count(prints[:, None].view(np.uint64) ^ prints.view(np.uint64)) <= 3
    root = np.arange(len(prints))
    while True:
        least = np.where(close, root, len(prints)).min(1)
        if (least == root).all():
            break
        root = least
    nodes = spark.createDataFrame([(int(fp), i) for i, fp in enumerate(prints)], "fingerprint long, node long").cache()
    for splits in (0, 1, 3):
        found = {r.node: r.component for r in simhash.components(simhash.link(nodes, shard=8, splits=splits)).collect()}
        assert [found.get(i, i) for i in range(len(prints))] == root.tolist()


def test_simhash_rows_do_not_grow_with_the_square_of_a_bucket(spark):
    nodes = spark.range(100_000).select((F.shiftleft(F.xxhash64("id"), 16) + 77).alias("fingerprint"), F.col("id").alias("node"))
    assert simhash.meetings(nodes).count() < 2_000_000


def five_words(text):
    w = text.split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def test_stage_keeps_one_of_each_group_of_similarity_four_fifths(spark):
    rng, rows, want = np.random.default_rng(7), [], set()
    for n in range(120):
        w = [f"w{k}" for k in rng.integers(0, 5000, int(rng.integers(60, 250)))]
        near = list(w)
        for k in rng.choice(len(w), int(len(w) * rng.uniform(0.01, 0.04)) + 1, replace=False):
            near[k] = "other"
        x, y = five_words(" ".join(w)), five_words(" ".join(near))
        rows += [(2 * n, " ".join(w)), (2 * n + 1, " ".join(near))]
        want |= {2 * n} | ({2 * n + 1} if len(x & y) < 0.8 * len(x | y) else set())
    assert 150 < len(want) < 220
    got = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id for r in got.collect()} == want


def test_stage_links_over_shards_and_rows_that_miss_the_least(spark):
    base = [f"b{k}" for k in range(100)]
    steps = [" ".join([f"new{k}" if k < 2 * n else w for k, w in enumerate(base)]) for n in range(30)]  # each like its neighbours alone
    got = simhash.similar_documents(spark.createDataFrame(list(enumerate(steps)), "doc_id long, text string"), shard=2)
    assert {r.component_id for r in got.collect()} == {0}


def test_neighbours(spark):
    got = neighbours.op9_nearest_neighbours(spark, DATA).toPandas()
    e = spark.read.parquet(f"{DATA}/embeddings.parquet").toPandas().sort_values("vec_id")
    ids, m = e.vec_id.to_numpy(), np.stack(e.embedding).astype(float)
    hits = 0
    for q, g in got.groupby("query_id"):
        s = m @ m[ids == q][0]
        s[ids == q] = -np.inf
        hits += len(set(ids[np.lexsort((ids, -s))[:20]]) & set(g.vec_id))
        assert g.sort_values("rank").score.is_monotonic_decreasing
    assert got.query_id.nunique() == (ids % 20 == 0).sum() and hits / len(got) >= 0.9
    rows = [(i, [1.0, 2.0, 0.5]) for i in range(30)] + [(30, [3.0, 1.0, 1.0]), (31, None), (32, [0.0, 0.0, 0.0]), (33, [1.0, None, 2.0]), (34, [float("nan"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (35, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    near = neighbours.nearest(df, F.col("vec_id") % 20 == 0).toPandas()
    assert near[near.query_id == 0].sort_values("rank").vec_id.tolist() == [30, *range(1, 20)]
    assert neighbours.nearest(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_sentencepiece(spark, odd, none, docs):
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    got = sentencepiece_codec.encode_decode(docs.unionByName(odd.select(docs.columns))).collect()
    for r in got:
        assert r.token_ids == (library.encode(r.text) if r.text else []) and r.n_tokens == len(r.token_ids)
        assert r.round_trip == ("▁" not in (r.text or ""))
    assert sentencepiece_codec.encode_decode(none).count() == 0


def test_sentencepiece_unigram_by_viterbi():
    proto = pb.ModelProto()
    proto.trainer_spec.model_type = sentencepiece_codec.UNIGRAM
    proto.normalizer_spec.name, proto.normalizer_spec.add_dummy_prefix = "identity", True
    proto.normalizer_spec.remove_extra_whitespaces, proto.normalizer_spec.escape_whitespaces = False, True
    rng = np.random.default_rng(5)
    pieces = ["<unk>", "<s>", "</s>", "▁", *"abcd", *sorted({"".join(rng.choice(list("abcd"), rng.integers(2, 6))) for _ in range(60)} | {"▁a", "▁ab", "▁cab"})]
    for k, p in enumerate(pieces):
        proto.pieces.add(piece=p, score=0.0 if k < 3 else float(-rng.random() * 9 - 1), type={0: 2, 1: 3, 2: 3}.get(k, 1))
    library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    codec = sentencepiece_codec.Codec(sentencepiece_codec.build_pieces(proto.trainer_spec.model_type, [(p.piece, p.score, p.type) for p in proto.pieces]))
    texts = ["".join(rng.choice(list("abcd "), rng.integers(1, 30))) for _ in range(300)] + ["axxb", "zz", " ", None]
    offsets, ids = codec.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == [library.encode(t) if t else [] for t in texts]


def test_pipeline(spark):
    """The stages' decisions beside brute force: languages from the stage's own model, groups by Jaccard similarity of
    five-word shingles, removed bytes, the mix's targets, the library's ids."""
    import corpus_pipeline

    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "suffix_array_dedup", "source_mixing", "sentencepiece"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet").cache()
    near = " ".join(f"word{k}" for k in range(120))
    extra = [(9_001, near + " the end of it", "en", "web", 1), (9_002, near + " and the end", "en", "web", 1), (9_003, None, "en", "web", 1), (9_004, " \n", None, None, 1)]
    extra += [(9_005, docs.first().text, "en", "web", 1), (9_006, "½ 12", "en", "web", 1)]
    given = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    stages, state, seen = dict(corpus_pipeline.STAGES), given, {}
    for name in stages:
        folder = f"{tempfile.mkdtemp(prefix='spark-stage-')}/{name}"
        stages[name](spark, state, DATA).write.parquet(folder)
        before, state = state, spark.read.parquet(folder)
        seen[name] = state.toPandas()
        if name != "sentencepiece":
            assert state.columns == given.columns and name
        if name == "language_id":
            gone = set(before.toPandas().doc_id) - set(seen[name].doc_id)
            assert {9_003, 9_004, 9_006} <= gone and len(gone) < 12
        if name == "simhash_near_dedup":
            rows = sorted((r.doc_id, five_words(re.sub("[A-Z]", lambda c: c[0].lower(), r.text))) for r in before.collect())
            root = {i: i for i, _ in rows}

            def top(x):
                while root[x] != x:  # noqa: B023
                    x = root[x]  # noqa: B023
                return x

            for n, (i, x) in enumerate(rows):
                for j, y in rows[n + 1 :]:
                    if min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and len(x & y) >= 0.8 * len(x | y) and top(i) != top(j):
                        root[max(top(i), top(j))] = min(top(i), top(j))
            assert set(seen[name].doc_id) == {top(i) for i, _ in rows} and 9_002 not in set(seen[name].doc_id)
        if name == "suffix_array_dedup":
            rows = sorted((r.doc_id, r.text) for r in before.collect())
            kept = {i: n - removed for (i, _), (n, removed, _, _) in zip(rows, kept_by_brute_force([t for _, t in rows]), strict=True)}
            assert all(0 <= len(r.text.encode()) - kept[r.doc_id] <= 6 and len(r.text) == r.n_chars for r in seen[name].itertuples())  # cut characters stay
        if name == "source_mixing":
            size = before.toPandas().assign(n=lambda d: d.text.map(lambda t: len(words(t))))
            taken = seen[name].assign(n=lambda d: d.text.map(lambda t: len(words(t)))).groupby("source", dropna=False).n.sum()
            targets = mixing.source_targets(spark.createDataFrame(size[["source", "n"]].rename(columns={"n": "size"}))).toPandas().set_index("source").target
            assert all(abs(taken.get(k, 0) - t) <= size.n.max() / 2 for k, t in targets.items())
            assert seen[name].groupby("doc_id").size().max() <= 2
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    out, texts = seen["sentencepiece"], seen["source_mixing"].drop_duplicates("doc_id").set_index("doc_id").text
    assert out.round_trip.all() and len(out) == len(seen["source_mixing"])
    assert all(list(r.token_ids) == library.encode(texts[r.doc_id]) for r in out.itertuples())


def test_sentencepiece_bpe_paths_are_those_of_merging():
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    codec = sentencepiece_codec.Codec(sentencepiece_codec.load_pieces())
    assert codec.p.merges.ordered  # so units up to LONG characters go through viterbi()
    rng = np.random.default_rng(2)
    pieces = [library.id_to_piece(i).replace("▁", " ") for i in range(259, library.get_piece_size())]
    texts = ["".join(pieces[i] for i in rng.integers(0, len(pieces), int(n))) for n in rng.integers(1, 9, 4000)]
    texts += ["".join(rng.choice(list("aabbcdeé日🙂 .x1"), int(n))) for n in rng.integers(1, 120, 1500)]
    offsets, ids = codec.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == library.encode(texts)
    assert codec.decode(offsets, ids) == [t.encode() for t in texts]


def test_sentencepiece_long_words_are_merged_together():
    """Words over LONG characters, up to a million, with runs, ties and characters that no piece holds."""
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    codec = sentencepiece_codec.Codec(sentencepiece_codec.load_pieces())
    rng = np.random.default_rng(4)
    letters = "".join(rng.choice(list("etaoinshrdlucmfwypvbgk"), 1_000_000))
    texts = ["".join(rng.choice(list(kind), int(n))) for kind in ("ab", "aab", "esst", "日本é", "🙂x") for n in rng.integers(60, 400, 60)]
    texts += [c * n for c in ("a", "ab", "aab", "=", "-", "🙂") for n in range(63, 140)] + ["ab" * 500_000, "a" * 1_000_000, letters, letters[:65], None, ""]
    offsets, ids = codec.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == [library.encode(t) if t else [] for t in texts]
    assert codec.decode(offsets, ids) == [(t or "").encode() for t in texts]
    assert max(map(len, codec._new)) <= sentencepiece_codec.LONG


def recall(found, ids, m, k=20):
    """Share of exact neighbours found: by score, so equal ones count alike."""
    hits = n = 0
    for q, g in found.groupby("query_id"):
        s = m @ m[ids == q][0]
        s[np.flatnonzero(ids == q)[0]] = -np.inf
        n += min(k, len(ids) - 1)
        hits += (g.score.to_numpy() >= np.sort(s)[::-1][: k][-1] - 1e-9).sum()
    return hits / n


def test_each_query_gets_its_rows_and_goes_where_they_are(spark):
    """Four long vectors in a band of their own come first for all queries, and don't fill k rows; and a few queries
    are unlike the rest."""
    rng = np.random.default_rng(3)
    m = rng.standard_normal((4000, 16))
    m[[20, 40, 60, 77]] *= 50
    m[100:140] = rng.standard_normal((40, 16)) * 0.01 - m[100]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, F.col("vec_id") % 20 == 0, shard_rows=512).toPandas()
    assert (got.groupby("query_id").size() == 20).all() and got.query_id.nunique() == 200
    ids = np.arange(4000)
    each = {q: recall(g, ids, m) for q, g in got.groupby("query_id")}
    assert np.mean(list(each.values())) >= 0.95 and min(each.values()) >= 0.6


@pytest.mark.parametrize("kind", ["gaussian", "lengths", "groups"])
def test_neighbours_over_several_shards(spark, kind):
    rng = np.random.default_rng(8)
    m = rng.standard_normal((2400, 24))
    if kind == "lengths":
        m *= rng.lognormal(0, 1, (2400, 1))
    if kind == "groups":  # tight ones, larger than a node's links, and many copies of one vector
        m = np.repeat(rng.standard_normal((12, 24)), 200, 0) + rng.standard_normal((2400, 24)) * 0.01
        m[:800] = m[0]
    rows = [(i, x.tolist()) for i, x in enumerate(m)] + [(40, m[7].tolist()), (5000, [1.0, 2.0]), (5020, [2.0, 1.0]), (5040, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, F.col("vec_id") % 20 == 0, shard_rows=256, query_rows=64).toPandas()
    ids = np.array([r[0] for r in rows[:2401]])
    full = np.vstack((m, m[7]))
    own = got[(got.query_id < 5000) & (got.query_id != 40)]
    assert own.query_id.nunique() == 119 and recall(own, ids, full) >= 0.9
    assert len(got[got.query_id == 40]) == 40  # two rows of one vec_id, each with its own answers
    short = got[got.query_id >= 5000].sort_values(["query_id", "rank"])
    assert short[["query_id", "vec_id"]].values.tolist() == [[5000, 5020], [5000, 5040], [5020, 5000], [5020, 5040], [5040, 5000], [5040, 5020]]
    if kind == "groups":
        assert own[own.query_id == 60].sort_values("rank").vec_id.tolist() == list(range(20))
