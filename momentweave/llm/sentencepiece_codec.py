"""Operator 10: SentencePiece encoding and decoding by batched Viterbi in numpy, for unigram and for BPE models."""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, mix, spare, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNIGRAM, BPE = 1, 2  # fixed values of the model file's format
NORMAL, UNK, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # likewise
LONG = 64  # characters; longer units are few, so vectors over them would be short: these are merged, all of them together
KEPT_UNITS = 100_000  # encoded units, about, that a worker keeps for its next texts; as many again that it has not met since
_UNK_PENALTY = 10.0  # what the library subtracts from the lowest score for an unknown character
_SLICE = 3 << 19  # characters encoded at a time
_NEVER = np.iinfo(np.int64).max


def _rolling(codes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n code points from each position of each row on."""
    h = np.full((codes.shape[0], codes.shape[1] - n + 1), n, np.uint64)
    for k in range(n):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + codes[:, k : codes.shape[1] - n + 1 + k])
    return h


def _codes(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), -1).astype(np.uint64)


class _Keys:
    """Sorted hashes. A probe looks up where those of its leading bits begin, and goes on from there."""

    def __init__(self, hashes: np.ndarray):
        self.order = np.argsort(hashes)
        self.hashes = np.append(hashes[self.order], np.uint64(0))
        bits = max(4, len(hashes).bit_length() + 3)
        self.shift = np.uint64(64 - bits)
        heads = np.searchsorted(self.hashes[:-1], np.arange(1 << bits, dtype=np.uint64) << self.shift)
        self.first, self.size = heads, np.diff(np.append(heads, len(hashes)))
        self.used, self.most = self.size > 0, int(self.size.max(initial=0))

    def probe(self, wanted: np.ndarray) -> np.ndarray:
        """Places of wanted (a vector) among the sorted hashes, -1 where absent."""
        out = np.full(len(wanted), -1)
        head = wanted >> self.shift
        rows = np.flatnonzero(self.used[head])  # most are absent, and go here
        at, mine = self.first[head[rows]], wanted[rows]
        for k in range(self.most):
            hit = self.hashes[np.minimum(at + k, len(self.order))] == mine
            hit &= at + k < len(self.order)
            out[rows[hit]] = at[hit] + k
        return out


class Merges:
    """The merges of a BPE model over its symbols: the ids of its pieces, then single characters that are no piece, the
    last of them for every character that no piece holds.

    A symbol has the place of its merge in the order of merges (-1: a single character) and the two symbols that this
    merge joins. A piece's last merge joins the two parts that stay apart under all earlier merges.
    """

    def __init__(self, usable: dict[str, tuple[int, float]], singles: dict[str, int], other: int):
        self.span = other + 1
        self.place, self.left, self.right = (np.full(self.span, -1, np.int64) for _ in range(3))
        symbol = {p: i for p, (i, _) in usable.items()} | singles
        rank = {p: k for k, p in enumerate(sorted((p for p in usable if len(p) > 1), key=lambda p: -usable[p][1]))}
        splits = [(symbol[p[:k]] * self.span + symbol[p[k:]], rank[p], usable[p][0], len(p)) for p in rank for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol]
        keys, places, ids, length = np.array(splits, np.int64).reshape(-1, 4).T
        self.keys = _Keys(mix(keys.astype(np.uint64)))
        keys, self.places, self.ids, length = (x[self.keys.order] for x in (keys, places, ids, length))
        single = np.zeros(self.span, bool)
        single[list(singles.values())] = True
        for n in np.unique(length):  # the merges of a piece's parts, which are shorter, are known by then
            at = np.flatnonzero(length == n)
            a, b = np.divmod(keys[at], self.span)
            made = ((self.place[a] >= 0) | single[a]) & ((self.place[b] >= 0) | single[b]) & (np.maximum(self.place[a], self.place[b]) < self.places[at])
            at, a, b = at[made], a[made], b[made]
            fits = self.apart(a, b, self.places[at])
            whole = self.ids[at[fits]]
            self.place[whole], self.left[whole], self.right[whole] = self.places[at[fits]], a[fits], b[fits]
        #: Whether every piece is merged after both of its parts; pieces that no text becomes don't count.
        self.ordered = all(self.merged([singles[c] for c in p]) != [usable[p][0]] for p in rank if self.place[usable[p][0]] < 0)

    def pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Places of the pairs that can be merged, -1 of others."""
        return self.keys.probe(mix((a * self.span + b).astype(np.uint64)))

    def apart(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether merging (up to place limit) leaves neighbouring symbols a and b as they are.

        Their merges are undone from the last one on. Two symbols that meet at the boundary on the way stay apart
        only if they can't be merged before one of them is taken up on its own side; of equal merges the left one
        goes first.
        """
        fits, live = np.ones(len(a), bool), np.arange(len(a))
        limit = np.full(len(a), _NEVER) if limit is None else limit
        while len(live):
            at = self.pairs(a, b)
            bad = at >= 0
            bad[bad] = self.places[at[bad]] < limit[bad]
            fits[live[bad]] = False
            more = ~bad & (np.maximum(self.place[a], self.place[b]) >= 0)
            live, a, b = live[more], a[more], b[more]
            back = self.place[a] > self.place[b]
            limit = np.where(back, self.place[a], self.place[b] + 1)
            a, b = np.where(back, self.right[a], a), np.where(back, b, self.left[b])
        return fits

    def merged(self, symbols: list[int]) -> list[int]:
        """Symbols of one word merged pair by pair, with a heap of candidates."""
        n = len(symbols)
        after, before, heap = [*range(1, n), -1], [*range(-1, n - 1)], []

        def offer(lefts: list[int]) -> None:
            lefts = [i for i in lefts if i >= 0 and after[i] >= 0]
            at = self.pairs(np.array([symbols[i] for i in lefts], np.int64), np.array([symbols[after[i]] for i in lefts], np.int64)).tolist()
            for i, k in zip(lefts, at, strict=True):
                if k >= 0:
                    heapq.heappush(heap, (int(self.places[k]), i, symbols[i], symbols[after[i]], int(self.ids[k])))

        offer(list(range(n - 1)))
        while heap:
            _, i, a, b, whole = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j < 0 or symbols[j] != b:
                continue
            symbols[i], symbols[j] = whole, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            after[j] = -1
            offer([before[i], i])
        return [s for s in symbols if s >= 0]

    def merged_together(self, symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Symbols of words that lie one after the other, each beginning at one of the places `first`, after all merges;
        -1 where a symbol is part of the one before it. For models whose merges are ordered.

        There a merge only makes pairs that are merged later, so all pairs of one place in the order of merges are
        merged at once, in every word; of those that share a symbol the left one goes first. A round costs as much as it
        merges, and there are at most as many as different pieces that the words come by.
        """
        n, rank_of = len(symbols), np.iinfo(np.int32).max
        symbols = symbols.astype(np.int32)
        whole = np.zeros(int(self.places.max(initial=-1)) + 1, np.int32)
        whole[self.places] = self.ids
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        before[first] = -1
        after[np.append(first[1:], n) - 1] = n
        rank = np.full(n, rank_of, np.int32)  # of the pair that begins here
        waiting: dict[int, list[np.ndarray]] = defaultdict(list)
        ranks: list[int] = []

        def offer(at: np.ndarray) -> None:
            rank[at] = rank_of
            at = at[after[at] < n]
            found = self.pairs(symbols[at].astype(np.int64), symbols[after[at]].astype(np.int64))
            at, r = at[found >= 0], self.places[found[found >= 0]]
            if not len(at):
                return
            rank[at] = r
            if len(r) > 1:
                order = np.argsort(r, kind="stable")
                at, r = at[order], r[order]
            edges = [0, *(np.flatnonzero(np.diff(r)) + 1).tolist(), len(r)]
            for a, b in zip(edges, edges[1:]):
                if (k := int(r[a])) not in waiting:
                    heapq.heappush(ranks, k)
                waiting[k].append(at[a:b].astype(np.int32))

        for a in range(0, n, _SLICE):
            offer(np.arange(a, min(a + _SLICE, n)))
        while ranks:
            now = heapq.heappop(ranks)
            at = np.concatenate(waiting.pop(now))
            at = np.sort(at[rank[at] == now])
            if not len(at):
                continue
            alone = after[at[:-1]] != at[1:]
            if not alone.all():  # in a run of pairs that share symbols every second one goes
                place = np.arange(len(at))
                at = at[(place - np.maximum.accumulate(np.where(np.append(True, alone), place, 0))) % 2 == 0]
            gone = after[at]
            then = after[gone]
            symbols[at], symbols[gone], rank[gone], after[at] = whole[now], -1, rank_of, then
            before[then[then < n]] = at[then < n]
            left = before[at]
            offer(np.unique(np.concatenate((left[left >= 0], at))))
        return symbols


@dataclass(frozen=True)
class Pieces:
    """A model's pieces as sorted arrays."""

    bytes_: list[bytes]  # what each id decodes to, before the dummy prefix goes
    unk: int
    byte_ids: np.ndarray | None
    by_length: dict[int, tuple[_Keys, np.ndarray, np.ndarray]]  # length -> keys, their ids and scores
    lowest: float
    unit: re.Pattern  # what is encoded by itself: no piece crosses its edges
    points: np.ndarray  # code points of single characters, sorted, and their symbols
    symbols: np.ndarray
    merges: Merges | None  # of a BPE model

    def single(self, codes: np.ndarray) -> np.ndarray:
        """BPE: symbols of single characters."""
        at = np.minimum(np.searchsorted(self.points, codes), len(self.points) - 1)
        return np.where(self.points[at] == codes, self.symbols[at], self.merges.span - 1) if len(self.points) else np.full(codes.shape, self.merges.span - 1)


def load_pieces(path: str = MODEL) -> Pieces:
    """Read a model file with the identity normaliser (any other raises: texts would not survive it)."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    norm = proto.normalizer_spec
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not (norm.add_dummy_prefix and norm.escape_whitespaces):
        raise ValueError("only models with the identity normaliser and a dummy prefix are supported")
    return build_pieces(proto.trainer_spec.model_type, [(p.piece, p.score, p.type) for p in proto.pieces])


def build_pieces(kind: int, vocabulary: list[tuple[str, float, int]]) -> Pieces:
    if kind not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models are supported")
    if any(t in (UNUSED, USER) for *_, t in vocabulary):
        raise ValueError("user-defined and unused pieces are not supported")
    usable = {p: (i, s) for i, (p, s, t) in enumerate(vocabulary) if t == NORMAL}
    if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in usable):
        raise ValueError("pieces across words are not supported")
    byte_of = {int(p[3:-1], 16): i for i, (p, _, t) in enumerate(vocabulary) if t == BYTE}
    unk = next((i for i, (*_, t) in enumerate(vocabulary) if t == UNK), 0)
    decoded = [
        b"" if t == CONTROL else bytes([int(p[3:-1], 16)]) if t == BYTE else b" \xe2\x81\x87 " if t == UNK else p.replace(SPACE, " ").encode()
        for p, _, t in vocabulary
    ]
    singles = {p: i for p, (i, _) in usable.items() if len(p) == 1}
    for c in sorted({c for p in usable for c in p} - set(singles)):
        singles[c] = len(vocabulary) + len(singles)
    merges = Merges(usable, singles, len(vocabulary) + len(singles)) if kind == BPE else None
    lengths = defaultdict(list)
    for p, (i, _) in usable.items():
        if merges is None or (len(p) > 1 and merges.place[i] >= 0):
            lengths[len(p)].append(p)
    by_length = {}
    for n, group in lengths.items():
        keys = _Keys(_rolling(_codes(group), n)[:, 0])
        by_length[n] = (keys, np.array([usable[p][0] for p in group])[keys.order], np.array([usable[p][1] for p in group])[keys.order])
    chars = sorted(singles)
    return Pieces(
        decoded, unk, np.array([byte_of[b] for b in range(256)]) if len(byte_of) == 256 else None, by_length, min((s for _, s in usable.values()), default=0.0),
        _units(usable, len(byte_of) == 256), np.array([ord(c) for c in chars], np.uint64), np.array([singles[c] for c in chars], np.int64), merges,
    )


def _units(pieces: Iterable[str], spelled: bool) -> re.Pattern:
    """What is encoded by itself: space markers and a run of characters that pieces join, directly or by others.

    No piece crosses the edge of such a run. Without byte pieces (not spelled) neighbouring unknown characters become
    one id, so all that stands between spaces stays together.
    """
    if not spelled:
        return re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
    root: dict[str, str] = {}

    def top(c: str) -> str:
        while root.setdefault(c, c) != c:
            c = root[c]
        return c

    for p in pieces:
        core = p.lstrip(SPACE)
        for a, b in zip(core, core[1:]):
            root[max(top(a), top(b))] = min(top(a), top(b))
    kinds = defaultdict(list)
    for c in sorted(root):
        kinds[top(c)].append(re.escape(c))
    runs = [f"[{''.join(k)}]+" for _, k in sorted(kinds.items())]
    return re.compile(f"{SPACE}*(?:{'|'.join([*runs, f'[^{SPACE}]'])})|{SPACE}+")


def viterbi(p: Pieces, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Best segmentations of words of one length: for each word and end, where the last piece of the text up to there
    starts, and which symbol it is (-1: an unknown character).

    All words advance one character at a time: hashes of the substrings that end there probe the sorted pieces of
    each length, and the maximum over lengths gives the score and the backpointer. In a unigram model the score is
    the best sum of piece scores; ties go to the longer piece. In a BPE model a piece scores if merging leaves it
    apart from the last piece of the text before it. Merging gives each part of a word what it gives the part by
    itself, so exactly one piece does, and the path is the one that merging the whole word would give.
    """
    codes = _codes(words)
    n, size = codes.shape
    best = np.full((n, size + 1), -np.inf, order="F")
    best[:, 0] = 0
    back, ids = np.zeros((n, size + 1), np.int64, "F"), np.full((n, size + 1), -1, order="F")
    lengths = sorted((k for k in p.by_length if k <= size), reverse=True)
    hashes = {k: np.asfortranarray(_rolling(codes, k)) for k in lengths}  # a column is read at a time
    single = p.single(codes) if p.merges else None
    for end in range(1, size + 1):
        options = [k for k in lengths if k <= end]
        found = [p.by_length[k][0].probe(hashes[k][:, end - k]) for k in options]
        piece = [p.by_length[k][1][a] for k, a in zip(options, found, strict=True)]
        if p.merges:
            options, piece = [*options, 1], [*piece, single[:, end - 1]]
            rows = [*(np.flatnonzero(a >= 0) for a in found), np.arange(n)]
            before = np.concatenate([ids[r, end - k] for k, r in zip(options, rows, strict=True)])
            here = np.concatenate([x[r] for x, r in zip(piece, rows, strict=True)])
            fits = before < 0  # the word's first piece
            fits[~fits] = p.merges.apart(before[~fits], here[~fits])
            score = np.full((len(options), n), -np.inf)
            score[np.repeat(np.arange(len(options)), [len(r) for r in rows])[fits], np.concatenate(rows)[fits]] = 0
        else:
            best[:, end], back[:, end] = best[:, end - 1] + p.lowest - _UNK_PENALTY, end - 1
            score = np.stack([np.where(a >= 0, best[:, end - k] + p.by_length[k][2][a], -np.inf) for k, a in zip(options, found, strict=True)]) if options else np.empty((0, n))
        if not options:
            continue
        pick = score.argmax(0)
        top = score[pick, np.arange(n)]
        won = top > best[:, end]
        best[won, end] = top[won]
        for j, k in enumerate(options):
            mine = won & (pick == j)
            back[mine, end], ids[mine, end] = end - k, piece[j][mine]
    return back, ids


def _paths(back: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols and starts of the pieces of all words, from the first, and where each word's end. All go back together."""
    n, rows, end, steps = len(ids), np.arange(len(ids)), np.full(len(ids), ids.shape[1] - 1), []
    while len(rows):
        steps.append((rows, ids[rows, end], back[rows, end]))
        rows, end = rows[steps[-1][2] > 0], steps[-1][2][steps[-1][2] > 0]
    word = np.concatenate([r for r, _, _ in steps])
    count = np.bincount(word, minlength=n)
    ends = np.cumsum(count)
    place = ends[word] - 1 - np.repeat(np.arange(len(steps)), [len(r) for r, _, _ in steps])
    symbols, starts = np.empty(len(word), np.int64), np.empty(len(word), np.int64)
    symbols[place], starts[place] = np.concatenate([s for _, s, _ in steps]), np.concatenate([s for _, _, s in steps])
    return symbols, starts, ends


def _spelled(p: Pieces, word: str, symbols: list[int], starts: list[int]) -> bytes:
    """Ids of a word's symbols, as 32-bit integers; characters that are no piece become their bytes or the unknown id."""
    ids: list[int] = []
    for s, start in zip(symbols, starts, strict=True):
        if 0 <= s < len(p.bytes_):
            ids.append(s)
        elif p.byte_ids is not None:
            ids += p.byte_ids[list(word[start].encode("utf-8", "surrogatepass"))].tolist()
        elif not ids or ids[-1] != p.unk:  # the library joins unknown characters
            ids.append(p.unk)
    return np.array(ids, np.int32).tobytes()


def _long_units(p: Pieces, words: list[str]) -> dict[str, bytes]:
    """Ids of each word, by merging them together, about _SLICE characters (or one longer word) at a time."""
    out: dict[str, bytes] = {}
    ends = np.cumsum([len(w) for w in words])
    cuts = [0, *(np.flatnonzero(np.diff(ends // _SLICE)) + 1).tolist(), len(words)]
    for a, b in zip(cuts, cuts[1:]):
        some = words[a:b]
        if not some:
            continue
        last = np.cumsum([len(w) for w in some])
        first = last - [len(w) for w in some]
        symbols = p.merges.merged_together(p.single(_codes(["".join(some)])[0]), first)
        starts = np.flatnonzero(symbols >= 0)
        symbols = symbols[starts]
        edges = np.searchsorted(starts, np.append(first, last[-1])).tolist()
        odd = np.append(0, np.cumsum(symbols >= len(p.bytes_)))
        for w, begin, x, y in zip(some, first.tolist(), edges, edges[1:], strict=False):
            own = symbols[x:y]
            out[w] = own.tobytes() if odd[x] == odd[y] else _spelled(p, w, own.tolist(), (starts[x:y] - begin).tolist())
    return out


def encode_units(p: Pieces, units: list[str]) -> dict[str, bytes]:
    """Ids of each unit, as 32-bit integers; units of one length go together."""
    out: dict[str, bytes] = {}
    groups = defaultdict(list)
    for u in units:
        groups[len(u)].append(u)
    top = len(p.bytes_)
    if p.merges and p.merges.ordered:
        out |= _long_units(p, [w for size in sorted(groups) if size > LONG for w in groups.pop(size)])
    for words in groups.values():
        if p.merges and not p.merges.ordered:
            for w in words:
                symbols = p.merges.merged(p.single(_codes([w])[0]).tolist())
                width = [len(p.bytes_[s].decode()) if s < top else 1 for s in symbols]
                out[w] = _spelled(p, w, symbols, [0, *np.cumsum(width)[:-1].tolist()])
            continue
        symbols, starts, ends = _paths(*viterbi(p, words))
        raw = symbols.astype(np.int32).tobytes()
        edges = [0, *ends.tolist()]
        out |= {w: raw[4 * a : 4 * b] for w, a, b in zip(words, edges, edges[1:])}
        for k in np.unique(np.searchsorted(ends, np.flatnonzero((symbols < 0) | (symbols >= top)), "right")).tolist():
            out[words[k]] = _spelled(p, words[k], symbols[edges[k] : edges[k + 1]].tolist(), starts[edges[k] : edges[k + 1]].tolist())
    return out


class Codec:
    """Encodes and decodes texts; a unit that it has met lately is not encoded again."""

    def __init__(self, p: Pieces):
        self.p = p
        sizes = np.fromiter(map(len, p.bytes_), np.int64, len(p.bytes_))
        self._size, self._first = sizes, np.cumsum(sizes) - sizes
        self._data = np.frombuffer(b"".join(p.bytes_) or b"\0", np.uint8)
        self._new: dict[str, bytes] = {}  # units met lately and their ids, as 32-bit integers
        self._old: dict[str, bytes] = {}

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets (one more than texts) and ids. Null and empty texts have none."""
        find = self.p.unit.findall
        units = [find(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        different = set().union(*units) - self._new.keys()
        met = different & self._old.keys()
        self._new |= {u: self._old[u] for u in met}
        fresh = encode_units(self.p, list(different - met))
        self._new |= fresh
        known = self._new
        parts = [b"".join([known[u] for u in us]) for us in units]
        for u in fresh:
            if len(u) > LONG:  # seldom met again, and of any size
                del known[u]
        if len(known) > KEPT_UNITS:
            self._new, self._old = {}, known if len(known) <= 2 * KEPT_UNITS else {}
        offsets = np.cumsum([0, *(len(x) // 4 for x in parts)])
        return offsets, np.frombuffer(b"".join(parts), np.int32)

    def decode(self, offsets: np.ndarray, ids: np.ndarray) -> list[bytes]:
        """UTF-8 bytes of each sequence of ids, without the dummy prefix."""
        size = self._size[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        whole = self._data[np.repeat(self._first[ids] - (ends - size), size) + np.arange(total)].tobytes()
        ends = np.concatenate(([0], ends))[offsets]
        return [whole[a:b].removeprefix(b" ") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


_codecs: dict[str, Codec] = {}


def _codec(path: str) -> Codec:
    if path not in _codecs:  # once a worker
        _codecs[path] = Codec(load_pieces(path))
    return _codecs[path]


def _slices(array: pa.Array) -> Iterator[pa.Array]:
    """Runs of rows with about _SLICE bytes of text, one row at least; the whole array is never made into strings."""
    size = np.diff(np.frombuffer(array.buffers()[1], np.int32 if pa.types.is_string(array.type) else np.int64)[array.offset : array.offset + len(array) + 1])
    cuts = (np.flatnonzero(np.diff(np.cumsum(size) // _SLICE)) + 1).tolist() if len(array) else []
    for first, last in zip([0, *cuts], [*cuts, len(array)], strict=True):
        yield array.slice(first, last - first)


def encode_decode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """docs with n_tokens, token_ids (of the whole text) and round_trip (decoding them gives the text back, byte for byte).

    model: path of a model file that every executor has. The ids are those of the library for the same file: for a
    unigram model by the best sum of scores, for a BPE model by the one path that merging gives. A null or empty text
    has no ids. A text that contains the space marker itself comes back with spaces there, so its round_trip is false.
    Equal texts get equal ids. Columns of these names are replaced. No rows give no rows. A text is encoded whole: a
    worker needs about 120 bytes for each character of its longest text. A million letters without a space take about
    two seconds, such characters of many scripts and signs about ten.
    """
    bounded_batches(docs.sparkSession)

    @F.arrow_udf("struct<n_tokens: bigint, token_ids: array<int>, round_trip: boolean>")
    def code(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _codec(model)
        for array in arrays:
            counts, parts, same = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], []
            for part in _slices(array):
                texts = part.to_pylist()
                offsets, ids = codec.encode(texts)
                same += [a == (t or "").encode() for a, t in zip(codec.decode(offsets, ids), texts, strict=True)]
                counts.append(np.diff(offsets))
                parts.append(ids)
            n = np.concatenate(counts)
            ends = pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32())
            yield pa.StructArray.from_arrays(
                [pa.array(n), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(parts))), pa.array(same, pa.bool_())],
                ["n_tokens", "token_ids", "round_trip"],
            )

    s = spare(docs, "__tokens")
    out = docs.withColumn(s, code("text"))
    return out.withColumns({c: F.col(s)[c] for c in ("n_tokens", "token_ids", "round_trip")}).drop(s)


def op10_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
