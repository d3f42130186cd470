"""Operator 1: language identification by interpolated Kneser-Ney character models."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, cut, fold, mix, spare, table

#: Labelled documents of a language that teach, and their characters, about: the only bound on what is learned.
DOCS_PER_LANGUAGE, CHARACTERS_PER_LANGUAGE = 2_000, 4_000_000
ORDER = 5
UNKNOWN = "und"
RESULTS = ("lang_pred", "score", "cross_entropy", "rejected")
_LETTERS = regex.compile(r"\p{L}+")
_EDGE = "\x02"  # stands before and after each word
_SLICE = 1 << 20  # characters scored at a time
_NOTHING = np.uint64(1)  # the hash of the context of a single character


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters."""
    return _LETTERS.findall(text.lower()) if text else []


def _hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n code points that end at each position, from the n-th on."""
    h = np.full(len(codes) - n + 1, n, np.uint64)
    for k in range(n):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + codes[k : len(codes) - n + 1 + k])
    return h


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


@dataclass(frozen=True)
class _Order:
    """One order of one language: sorted hashes of its n-grams with their probabilities, and of its contexts with
    the weight that is left for the next lower order."""

    grams: np.ndarray
    prob: np.ndarray
    contexts: np.ndarray
    rest: np.ndarray


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), default)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], default)


def kneser_ney(orders: list[pd.DataFrame], alphabet: int) -> list[_Order]:
    """Interpolated Kneser-Ney tables, lowest order first, from each order's n-grams in hashes: gram, context, suffix
    (the gram without its first character) and n.

    n is the count in the highest order, and the number of different characters to the left in lower ones; each order
    has its own discount n1 / (n1 + 2 n2). Order 0 is uniform over the alphabet.
    """
    tables: list[_Order] = []
    for k, level in enumerate(orders):
        n = level["n"].to_numpy(float)
        ones, twos = (n == 1).sum(), (n == 2).sum()
        discount = min(max(ones / (ones + 2 * twos) if ones else 0.5, 0.1), 0.9)
        contexts, of = np.unique(level["context"].to_numpy(), return_inverse=True)
        total, kinds = np.bincount(of, n), np.bincount(of)
        rest = discount * kinds / total
        below = _find(tables[-1].grams, tables[-1].prob, level["suffix"].to_numpy(), 0.0) if k else np.full(len(n), 1 / alphabet)
        prob = (n - discount) / total[of] + rest[of] * below
        by = np.argsort(level["gram"].to_numpy())
        tables.append(_Order(level["gram"].to_numpy()[by], prob[by], contexts, rest))
    return tables


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    tables: tuple[tuple[_Order, ...], ...]
    alphabet: int
    sharpness: float = 1.0  # of the posterior, fitted on calibration documents
    centre: tuple[float, ...] = ()  # usual cross-entropy of a language's own documents
    spread: tuple[float, ...] = ()  # high quantile of (cross-entropy - centre) * sqrt(characters)

    def word_scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Characters (the closing edge included) and summed log probability by language of each word."""
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        pad = _EDGE * (ORDER - 1)
        codes = _code_points("".join(pad + w + _EDGE for w in words))
        width = sizes + ORDER - 1
        first = np.cumsum(width) - width
        ends = np.repeat(first + ORDER - 1 - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())  # of each scored character
        full, at, back = np.unique(_hashes(codes, ORDER)[ends - ORDER + 1], return_index=True, return_inverse=True)
        ends = ends[at]
        grams = [_hashes(codes, n)[ends - n + 1] for n in range(1, ORDER)] + [full]
        contexts = [np.full(len(ends), _NOTHING)] + [_hashes(codes, n - 1)[ends - n + 1] for n in range(2, ORDER + 1)]
        out = np.empty((len(words), len(self.languages)))
        for j, orders in enumerate(self.tables):
            p = np.full(len(full), 1 / self.alphabet)
            for n, o in enumerate(orders):
                rest = _find(o.contexts, o.rest, contexts[n], 1.0)
                seen = _find(o.grams, o.prob, grams[n], np.nan)
                p = np.where(np.isnan(seen), rest * p, seen)
            out[:, j] = np.add.reduceat(np.log(p)[back], np.cumsum(sizes) - sizes)
        return sizes, out

    def cross_entropy(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Scored characters of each text, and its cross-entropy (nats a character) in each language; 0 without letters."""
        found = [words_of(t) for t in texts]
        count = np.fromiter(map(len, found), np.int64, len(found))
        chars, total = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(self.languages)))
        if count.sum():
            codes, words = pd.factorize(np.array([w for ws in found for w in ws], dtype=object))
            size, score = self.word_scores(list(words))
            full = np.flatnonzero(count)
            begin = (np.cumsum(count) - count)[full]
            chars[full] = np.add.reduceat(size[codes], begin)
            for j in range(len(self.languages)):
                total[full, j] = np.add.reduceat(score[codes, j], begin)
        return chars, -total / np.maximum(chars, 1)[:, None]

    def decide(self, chars: np.ndarray, ce: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its posterior, its cross-entropy, and whether that is too high for the language."""
        best = ce.argmin(1)
        low = ce[np.arange(len(ce)), best]
        logit = -(ce - low[:, None]) * (self.sharpness * np.sqrt(np.maximum(chars, 1)))[:, None]
        score = 1 / np.exp(logit).sum(1)
        if not self.centre:
            return best, score, low, np.zeros(len(best), bool)
        centre, spread = np.array(self.centre)[best], np.array(self.spread)[best]
        return best, score, low, low > centre * 1.2 + spread / np.sqrt(np.maximum(chars, 1))

    def calibrated(self, chars: np.ndarray, ce: np.ndarray, truth: np.ndarray) -> LanguageModel:
        """With sharpness and rejection limits fitted on documents whose n-grams were not counted: their scored
        characters, cross-entropies and the index of their language."""
        centre, spread = np.full(len(self.languages), np.log(self.alphabet)), np.zeros(len(self.languages))
        for j in range(len(self.languages)):
            if (own := (truth == j) & (chars > 0)).any():
                centre[j] = np.average(ce[own, j], weights=chars[own])
                spread[j] = max(np.quantile((ce[own, j] - centre[j]) * np.sqrt(chars[own]), 0.999), 0) * 1.5
        best, sharpness = np.inf, 1.0
        for s in (0.5, 1.0, 2.0, 4.0, 8.0, 16.0):
            logit = -(ce - ce.min(1, keepdims=True)) * (s * np.sqrt(np.maximum(chars, 1)))[:, None]
            p = np.exp(logit[np.arange(len(truth)), truth]) / np.exp(logit).sum(1)
            if len(p) and (loss := -np.log(np.maximum(p, 1e-6)).mean()) < best - 1e-6:
                best, sharpness = loss, s
        return replace(self, sharpness=sharpness, centre=tuple(centre), spread=tuple(spread))


def _count_grams(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for lang, texts in frame.groupby("lang")["text"]:
            grams: Counter = Counter()
            words = Counter(w for t in texts for w in words_of(t))
            for w, c in words.items():
                padded = _EDGE * (ORDER - 1) + w + _EDGE
                for i in range(len(w) + 1):
                    grams[padded[i : i + ORDER]] += c
            rows.append(pd.DataFrame({"lang": lang, "gram": list(grams), "n": list(grams.values())}))
        if rows:
            yield pd.concat(rows)


@F.arrow_udf(T.StructType().add("gram", "long").add("context", "long").add("suffix", "long"))
def _gram_keys(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Hashes of n-grams of one length, of each without its last and without its first character."""
    for array in arrays:
        grams = array.to_pylist()
        n = len(grams[0]) if grams else 1
        codes = _code_points("".join(grams))
        whole = _hashes(codes, n)[::n] if grams else np.zeros(0, np.uint64)
        context = _hashes(codes, n - 1)[::n][: len(grams)] if n > 1 else np.full(len(grams), _NOTHING)
        suffix = _hashes(codes, n - 1)[1::n][: len(grams)] if n > 1 else np.full(len(grams), _NOTHING)
        yield pa.StructArray.from_arrays([pa.array(x.view(np.int64)) for x in (whole, context, suffix)], ["gram", "context", "suffix"])


def _sample(known: DataFrame, docs_per_language: int, characters_per_language: int) -> DataFrame:
    """About docs_per_language rows of each language of known (doc_id, text, lang), fewer if they have more than
    characters_per_language, but at least one, drawn by a hash of doc_id and text. Equal rows teach once."""
    unit = F.xxhash64("doc_id", "text").bitwiseAND(F.lit((1 << 30) - 1)) / float(1 << 30)
    size = known.groupBy("lang").agg(F.count("*").alias("rows"), F.sum(F.length("text")).alias("characters"), F.min(unit).alias("least"))
    share = F.least(F.lit(1.0), docs_per_language / F.col("rows"), characters_per_language / F.greatest(F.col("characters"), F.lit(1)))
    share = cut(size.select(F.col("lang").alias("of"), share.alias("share"), "least"), "shares")  # a row a language: Spark broadcasts it while it is small
    drawn = (unit < F.col("share")) | (unit == F.col("least"))
    return known.join(share, F.col("lang") == F.col("of")).where(drawn).drop("of", "share", "least").distinct()


def fit(docs: DataFrame, *, docs_per_language: int = DOCS_PER_LANGUAGE, characters_per_language: int = CHARACTERS_PER_LANGUAGE) -> LanguageModel:
    """Learn a model from doc_id, text, lang (rows with a null in any of them teach nothing).

    Each language is learned from a bounded sample of its labelled rows (_sample); a tenth of it, but never all of a
    language's documents, only calibrates.
    Executors count n-grams, and of these the characters to the left of each shorter one; no n-gram of the sample is
    left out, so counts of counts and discounts are those of the whole sample. The driver gets the tables, which are
    as large as the samples' n-grams, and the calibration documents' cross-entropies.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    known = docs.select("doc_id", "text", "lang").where("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL")
    sample = cut(_sample(known, docs_per_language, characters_per_language), "labelled")
    # The document of the least key teaches in any case: a language of few documents is not lost to calibration.
    key = F.xxhash64(F.lit("trial"), "doc_id")
    sample = cut(sample.join(sample.groupBy("lang").agg(F.min(key).alias("teaches")), "lang").select(*sample.columns, ((F.pmod(key, F.lit(10)) == 0) & (key != F.col("teaches"))).alias("trial")), "shared")
    trial = F.col("trial")
    grams = sample.where(~trial).select("lang", "text").mapInPandas(_count_grams, "lang string, gram string, n long")
    level, levels = cut(grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams"), []
    alphabet = 1 + level.agg(F.count_distinct(F.substring("gram", -1, 1))).first()[0]
    for k in range(ORDER, 0, -1):
        levels.append(level.select("lang", F.lit(k).alias("k"), _gram_keys("gram").alias("keys"), "n").select("lang", "k", "keys.*", "n"))
        level = level.groupBy("lang", F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("n"))
    found = [x.toPandas().astype({c: np.uint64 for c in ("gram", "context", "suffix")}) for x in levels[::-1]]
    languages = tuple(sorted(found[0]["lang"].unique()))
    if not languages:
        return LanguageModel((), (), 2)
    model = LanguageModel(languages, tuple(tuple(kneser_ney([x[x["lang"] == lang] for x in found], alphabet)) for lang in languages), alphabet)
    shared = spark.sparkContext.broadcast(model)

    def trials(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            chars, ce = shared.value.cross_entropy(list(frame["text"]))
            yield pd.DataFrame({"lang": frame["lang"], "chars": chars, "ce": list(ce)})

    tried = sample.where(trial & F.col("lang").isin(*languages)).select("lang", "text").mapInPandas(trials, "lang string, chars long, ce array<double>").toPandas()
    shared.unpersist()
    tried = tried.assign(key=tried["ce"].map(tuple)).sort_values(["lang", "chars", "key"])  # one order, whatever the partitions
    ce = np.stack(tried["ce"].to_list()) if len(tried) else np.zeros((0, len(languages)))
    truth = np.array([languages.index(x) for x in tried["lang"]], np.int64)
    return model.calibrated(tried["chars"].to_numpy(np.int64), ce, truth)


def _identifier(spark: SparkSession, model: LanguageModel):
    """A column function: struct of RESULTS for a text."""
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # its size is bounded by the samples: CHARACTERS_PER_LANGUAGE a language

    def decide(m: LanguageModel, texts: list[str | None]) -> list[np.ndarray]:
        if not m.languages or not texts:
            return [np.zeros(len(texts), np.int64), np.zeros(len(texts)), np.zeros(len(texts)), np.ones(len(texts), bool)]
        chars, ce = m.cross_entropy(texts)
        best, score, low, no = m.decide(chars, ce)
        none = chars == 0
        return [np.where(none, len(m.languages), best), np.where(none, 0.0, score), np.where(none, 0.0, low), no | none]

    @F.arrow_udf("struct<lang_pred: string, score: double, cross_entropy: double, rejected: boolean>")
    def identify(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m: LanguageModel = shared.value
        names = np.array([*m.languages, UNKNOWN], dtype=object)
        for array in arrays:
            texts, parts, first = array.to_pylist(), [decide(m, [])], 0
            cuts = np.flatnonzero(np.diff(np.cumsum([len(t or "") for t in texts]) // _SLICE)) + 1 if texts else []
            for last in (*cuts, len(texts)):
                parts.append(decide(m, texts[first:last]))
                first = last
            best, score, low, no = (np.concatenate(p) for p in zip(*parts, strict=True))
            yield pa.StructArray.from_arrays([pa.array(names[best], pa.string()), pa.array(score), pa.array(low), pa.array(no)], list(RESULTS))

    return identify


def identify_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs with lang_pred, score (posterior, 0 to 1), cross_entropy (of lang_pred, nats a character) and rejected.

    lang_pred is the language of lowest cross-entropy a character; ties go to the first in code-point order. A null
    text, or one without a letter, is `und` with score 0 and rejected, and so is every text if nothing was learned.
    rejected: the cross-entropy lies above what calibration documents of that length and language reach. Columns of
    these names are replaced; equal texts get equal results; no rows give no rows.
    """
    s = spare(docs, "__language")
    out = docs.withColumn(s, _identifier(docs.sparkSession, model)("text"))
    return out.withColumns({c: F.col(s)[c] for c in RESULTS}).drop(s)


def keep_identified(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of docs that identify_languages doesn't reject, with docs' own columns untouched."""
    return docs.where(~_identifier(docs.sparkSession, model)("text")["rejected"])


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(fold("doc_id", 5) != 0))
    found = identify_languages(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")
