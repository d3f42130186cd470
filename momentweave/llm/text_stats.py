"""Statistics of whole texts, computed for a batch of documents at once over their UTF-8 bytes."""

from __future__ import annotations

import numpy as np

from .common import mix, prefix_hash, span_hash

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = (
    "log_words", "mean_word", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "upper_ratio", "digit_ratio", "punct_ratio",
    "bang_ratio", "alpha_ratio", "wide_ratio", "short_words", "long_words", "distinct_words", "mean_line", "pipe_ratio",
    "caps_words", "top_word", "end_ratio", "brace_ratio",
)
SYMBOLS = b"#*$%&|<>"


def _flags(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


_SPACE, _SYMBOL = _flags(b" \t\n\x0b\x0c\r"), _flags(SYMBOLS)
_UPPER, _LOWER, _DIGIT = _flags(bytes(range(65, 91))), _flags(bytes(range(97, 123))), _flags(b"0123456789")
_PUNCT, _END, _BRACE = _flags(b".,;:!?'\"()-"), _flags(b".!?"), _flags(b"{}[]()=;_/\\")


class _Batch:
    """Documents laid end to end, each followed by a line break, so no word or line crosses two of them."""

    def __init__(self, docs: list[bytes]):
        self.data = np.frombuffer(b"\n".join(docs) + b"\n", np.uint8)
        self.size = np.fromiter(map(len, docs), np.int64, len(docs))
        self.first = np.concatenate(([0], np.cumsum(self.size + 1)))

    def count(self, mask: np.ndarray) -> np.ndarray:
        return np.add.reduceat(mask.view(np.uint8), self.first[:-1], dtype=np.int64)

    def owner(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, positions, "right") - 1


def _own(doc: np.ndarray) -> np.ndarray:
    return mix(doc.astype(np.uint64) + np.uint64(1))


def text_stats(docs: list[bytes]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The exact counts in COUNTS, and a float matrix of FEATURES, for whole texts given as UTF-8 bytes.

    Words are runs without ASCII white space; lines are split at line feeds. n_dup_lines counts lines that
    have a word and equal an earlier line of the text; n_repeat_words counts words inside five-word windows
    that occur at least twice in the text. Strings are compared by 64-bit hashes within one text.
    """
    b, n = _Batch(docs), len(docs)
    data, prefix = b.data, prefix_hash(b.data)
    space = _SPACE[data]
    edge = np.diff(np.concatenate(([True], space)).view(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    doc = b.owner(start)
    n_words = np.bincount(doc, minlength=n)
    wide = data >= 0x80
    word_chars = b.count(~space & ((data & 0xC0) != 0x80))
    word = span_hash(prefix, start, end)

    # Lines with a word.
    stop = np.flatnonzero(data == 10)
    begin = np.concatenate(([0], stop[:-1] + 1))
    words_to = np.searchsorted(start, stop)
    full = words_to > np.concatenate(([0], words_to[:-1]))
    begin, stop = begin[full], stop[full]
    line_doc = b.owner(begin)
    n_lines = np.bincount(line_doc, minlength=n)
    key = span_hash(prefix, begin, stop) ^ _own(line_doc)
    order = np.argsort(key)
    key = key[order]
    again = np.concatenate(([False], key[1:] == key[:-1])) if len(key) else np.zeros(0, bool)
    n_dup_lines = np.bincount(line_doc[order[again]], minlength=n)

    # Five-word windows that occur twice in their text.
    covered = np.zeros(len(word) + 1, np.int64)
    if len(word) >= 5:
        whole = doc[4:] == doc[:-4]
        shingle = word[:-4].copy()
        for k in range(1, 5):
            shingle = shingle * np.uint64(0x9E3779B97F4A7C15) + word[k : len(word) - 4 + k]
        at = np.flatnonzero(whole)
        key = mix(shingle[at]) ^ _own(doc[at])
        order = np.argsort(key)
        run = key[order]
        same = run[1:] == run[:-1]
        hit = at[order[np.concatenate(([False], same)) | np.concatenate((same, [False]))]] if len(run) else at
        np.add.at(covered, hit, 1)
        np.add.at(covered, hit + 5, -1)
    n_repeat_words = np.bincount(doc[np.cumsum(covered[:-1]) > 0], minlength=n)

    counts = dict(zip(COUNTS, (n_words, word_chars, b.count(_SYMBOL[data]), n_dup_lines, n_repeat_words), strict=True))

    # Shape of the text.
    size, words, lines = np.maximum(b.size, 1), np.maximum(n_words, 1), np.maximum(n_lines, 1)
    chars = np.maximum(word_chars, 1)
    upper, lower, length = b.count(_UPPER[data]), b.count(_LOWER[data]), end - start
    ups = np.concatenate(([0], np.cumsum(_UPPER[data])))
    lows = np.concatenate(([0], np.cumsum(_LOWER[data])))
    caps = (ups[end] - ups[start] >= 2) & (lows[end] == lows[start])
    key = word ^ _own(doc)
    order = np.argsort(key)
    key, of = key[order], doc[order]
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    times = np.diff(np.concatenate((new, [len(key)])))
    distinct = np.bincount(of[new], minlength=n)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, of[new], times)
    by = lambda mask: np.bincount(doc[mask], minlength=n) / words
    features = np.column_stack([
        np.log1p(n_words), word_chars / words, counts["n_symbols"] / chars, n_dup_lines / lines, n_repeat_words / words,
        upper / np.maximum(upper + lower, 1), b.count(_DIGIT[data]) / size, b.count(_PUNCT[data]) / size,
        b.count(data == ord("!")) / words, (upper + lower) / size, b.count(wide) / size, by(length <= 2), by(length >= 15),
        distinct / words, n_words / lines, b.count(data == ord("|")) / words, by(caps), top / words,
        b.count(_END[data]) / words, b.count(_BRACE[data]) / size,
    ])
    return counts, features
