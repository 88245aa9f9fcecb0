"""A language model of texts: a probabilistic suffix tree over words."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .storage import bucketed, persisted
from .words import Chunk, Hasher, chunks, mix

_U = np.uint64
#: Words in a block of documents that is scored in one place.
BLOCK_WORDS = 1_000_000
#: Tokens of the corpus for each part of the tree; contexts that end in a word seen more often are dealt over several parts.
PART_TOKENS = 500_000
#: Bytes of text for each bucket of blocks, and for each part of the vocabulary.
BUCKET_BYTES = 8 << 20
#: A context has at most so many tokens.
DEPTH = 3
#: Words and contexts seen so often in the training texts are told apart, at any size of the corpus.
LEAST = 2
_OTHER, _START, _END, _NONE, _FIRST = 0, 1, 2, 3, 4  # symbols; words told apart have numbers from _FIRST on


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers or floats of one width, byte by byte of the same weight, compressed."""
    held = np.concatenate([np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.ravel() for c in columns])
    return pa.compress(held.tobytes(), codec="zstd", asbytes=True)


def _unpacked(body: bytes, rows: int, columns: int = 1, kind: type = np.int64) -> np.ndarray:
    """The columns that _packed made, as rows of an array."""
    width = np.dtype(kind).itemsize
    held = pa.decompress(body, decompressed_size=rows * columns * width, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(held, np.uint8).reshape(columns, width, rows).transpose(0, 2, 1)).view(kind)[..., 0]


def _steps(column: np.ndarray) -> np.ndarray:
    """What each value adds to the one before it: small in a sorted column. np.cumsum undoes it."""
    return np.diff(column, prepend=0)


def _ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each different key, ascending by key, and which of them each key is."""
    order = np.argsort(keys)
    held = keys[order]
    new = np.ones(len(held), bool)
    new[1:] = held[1:] != held[:-1]
    which = np.empty(len(held), np.int64)
    which[order] = np.cumsum(new) - 1
    return order[new], which


class _Block:
    """Documents as numbers of words, and the words."""

    def __init__(self, shares: int) -> None:
        self.shares = shares
        self.names: list[np.ndarray] = []
        self.words: list[pa.Array] = []
        self.all: list[np.ndarray] = []
        self.train: list[np.ndarray] = []
        self.numbers: list[np.ndarray] = []
        self.docs: list[pa.Array] = []
        self.held: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.held_words = 0

    def add(self, ids: pa.Array, held: np.ndarray, c: Chunk, hashes: np.ndarray) -> None:
        names, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        train = ~held[c.row_of_word()]
        self.names.append(names)
        self.words.append(c.texts(first))
        self.all.append(np.bincount(which, minlength=len(names)))
        self.train.append(np.bincount(which, weights=train, minlength=len(names)).astype(np.int64))
        self.numbers.append(which.astype(np.int32))
        self.docs.append(ids)
        self.held.append(held)
        self.sizes.append(np.diff(c.first))
        self.held_words += len(hashes)

    def row(self) -> pa.RecordBatch:
        names, first, which = np.unique(np.concatenate(self.names), return_index=True, return_inverse=True)
        total = lambda parts: np.bincount(which, weights=np.concatenate(parts), minlength=len(names)).astype(np.int64)
        order = np.argsort(-total(self.all), kind="stable")
        number = np.empty(len(names), np.int32)
        number[order] = np.arange(len(names))
        starts = np.cumsum([0, *map(len, self.names)])
        numbers = np.concatenate([number[which[a:b]][n] for a, b, n in zip(starts, starts[1:], self.numbers)])
        words, counts = pa.concat_arrays(self.words).take(pa.array(first[order])), total(self.train)[order]
        share = (names[order] % _U(self.shares)).astype(np.int64)
        parts = []
        for v in np.unique(share):
            mine = np.flatnonzero(share == v)
            # No word has a space in it.
            said = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(mine)], pa.int32()), words.take(pa.array(mine)).cast(pa.string())), " ")[0].as_py().encode()
            parts.append({"share": int(v), "rows": len(mine), "size": len(said), "words": pa.compress(said, codec="zstd", asbytes=True), "body": _packed(_steps(mine), counts[mine])})
        one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
        block = int.from_bytes(os.urandom(8), "little", signed=True)
        return pa.record_batch({
            "block": pa.array([block], pa.int64()), "ids": one(pa.concat_arrays(self.docs)), "held": one(pa.array(np.concatenate(self.held))), "sizes": one(pa.array(np.concatenate(self.sizes).astype(np.int64))),
            "numbers": pa.array([_packed(numbers)], pa.binary()), "vocabulary": pa.array([parts], pa.list_(_PART)),
        })


_PART = pa.struct([("share", pa.int64()), ("rows", pa.int64()), ("size", pa.int64()), ("words", pa.binary()), ("body", pa.binary())])


def _blocks(batches: Iterator[pa.RecordBatch], shares: int) -> Iterator[pa.RecordBatch]:
    hasher, block = Hasher(), _Block(shares)
    for batch in batches:
        held = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
        for rows, c in chunks(batch.column(1), lower=True):
            block.add(batch.column(0)[rows.start : rows.stop], held[rows], c, hasher.words(c.data, c.starts, c.ends))
            if block.held_words >= BLOCK_WORDS:
                yield block.row()
                block = _Block(shares)
    if block.docs:
        yield block.row()


def _symbols(number: np.ndarray, symbol: np.ndarray, count: np.ndarray) -> bytes:
    # In a share frequent words have low symbols, so counts sink with symbols.
    order = np.lexsort((number, symbol))
    return _packed(number[order], _steps(symbol[order]), _steps(count[order]))


def _told(share: pa.Table, shares: int, part_tokens: int) -> pa.Table:
    """Of one share of the vocabulary, back to each block: numbers, symbols and counts in all training texts of its words.

    The first row says what the share adds to the totals, and which words are
    seen most often. Frequent words get low symbols.
    """
    said = [pa.decompress(w, decompressed_size=n, codec="zstd", asbytes=True) for w, n in zip(share["words"].to_pylist(), share["size"].to_pylist())]
    sizes = share["rows"].to_numpy()
    bodies = [_unpacked(b, n, 2) for b, n in zip(share["body"].to_pylist(), sizes)]
    each = pc.split_pattern(pa.array(said, pa.large_binary()).cast(pa.large_string()), " ").flatten()
    which = pc.dictionary_encode(each).indices.to_numpy()
    count = np.bincount(which, weights=np.concatenate([b[1] for b in bodies])).astype(np.int64)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(-count, kind="stable")] = np.arange(len(count))
    symbol = np.where(count >= LEAST, _FIRST + rank * shares + share["share"][0].as_py(), _OTHER)
    bodies = [_symbols(np.cumsum(b[0]), symbol[w], count[w]) for b, w in zip(bodies, np.split(which, np.cumsum(sizes)[:-1]))]
    first = np.arange(len(sizes)) == 0
    often = np.flatnonzero(count > part_tokens)
    out = {"block": share["block"], "kind": np.full(len(sizes), -1), "rows": sizes, "body": pa.array(bodies, pa.binary()), "tokens": count.sum() * first, "kinds": (count > 0).sum() * first}
    out |= {"told": np.sum((count + 0.1)[count >= LEAST]) * first, "often": pa.array([symbol[often].tolist()] + [[]] * (len(sizes) - 1), pa.list_(pa.int64())), "seen": pa.array([count[often].tolist()] + [[]] * (len(sizes) - 1), pa.list_(pa.int64()))}
    return pa.table(out)


def _longer(context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    return mix(context * _U(0xAF251AF3B0F025B5) + symbol.astype(_U) + _U(1))


@dataclass
class Totals:
    """Of the training texts: all tokens, different ones, texts, and the sum of the counts of words told apart and 0.1 each."""

    tokens: int
    kinds: int
    texts: int
    told: float

    @property
    def norm(self) -> float:
        return self.tokens + 0.1 * (self.kinds + 1)

    @property
    def other(self) -> float:
        """What the words not told apart have of norm, one that is new among them."""
        return self.norm - self.told - (self.texts + 0.1)

    def root(self, symbol: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Chances of symbols without context, those of the base score."""
        mass = np.where(symbol == _OTHER, self.other, np.where(symbol == _END, self.texts, count) + 0.1)
        return np.maximum(mass / self.norm, 1e-300)


@dataclass
class Dealt:
    """How the tree is cut: contexts go to parts by their last word.

    Those that end in a word of `words` (ascending) are dealt over `salts`
    parts by the word before it, and those that end in a pair of `pairs`
    (hash, ascending) over `pair_salts` by the one before that.
    """

    parts: int
    words: np.ndarray
    salts: np.ndarray
    pairs: np.ndarray
    pair_salts: np.ndarray

    @staticmethod
    def _at(held: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(held):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        at = np.minimum(np.searchsorted(held, wanted), len(held) - 1)
        return at, held[at] == wanted

    def often(self, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._at(self.words, last)

    def often_pair(self, last: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._at(self.pairs, _longer(last.astype(_U), second))

    def route(self, last: np.ndarray, second: np.ndarray, third: np.ndarray) -> np.ndarray:
        h = mix(last.astype(_U) + _U(0x9E3779B97F4A7C15))
        at, hit = self.often(last)
        if hit.any():
            h[hit] = mix(h[hit] + _U(1) + mix(second[hit].astype(_U)) % self.salts[at[hit]].astype(_U))
            at, hit = self.often_pair(last, second)
            h[hit] = mix(h[hit] + _U(1) + mix(third[hit].astype(_U) + _U(5)) % self.pair_salts[at[hit]].astype(_U))
        return (h % _U(self.parts)).astype(np.int64)

    def parts_of(self, last: int, second: int | None, pairs: list[tuple[int, int]]) -> list[int]:
        """The parts that hold contexts which end in the word last, or in second and last."""
        salts = int(self.salts[np.searchsorted(self.words, last)])
        base = mix(np.array([last], _U) + _U(0x9E3779B97F4A7C15))
        found: list[np.ndarray] = [] if second is not None else [mix(base + _U(1) + np.arange(salts, dtype=_U))]
        for a, b in pairs:
            if a == last and (second is None or b == second):
                at, _ = self.often_pair(np.array([a]), np.array([b]))
                h = mix(base + _U(1) + mix(np.array([b], _U)) % _U(salts))
                found.append(mix(h + _U(1) + np.arange(int(self.pair_salts[at[0]]), dtype=_U)))
        return np.unique(np.concatenate(found) % _U(self.parts)).astype(np.int64).tolist()


class _Stream:
    """A block in symbols: at each token but starts, the code of its symbol, and those before it.

    names and counts are the symbols by their codes, and the counts of words.
    """

    def __init__(self, block: pa.Table, words: pa.Table):
        self.sizes = block["sizes"][0].values.to_numpy()
        self.held = block["held"][0].values.to_numpy(zero_copy_only=False).astype(bool)
        bodies = [_unpacked(b, rows, 3) for b, rows in zip(words["body"].to_pylist(), words["rows"].to_pylist())]
        bodies = [np.concatenate([b[:1], np.cumsum(b[1:], axis=1)]) for b in bodies]
        number, symbol, count = np.concatenate(bodies, axis=1) if bodies else np.zeros((3, 0), np.int64)
        order = np.argsort(number)
        symbol, self.count = symbol[order], count[order]
        self.numbers = _unpacked(block["numbers"][0].as_py(), int(self.sizes.sum()), kind=np.int32)[0]
        self.names = np.unique(np.append(symbol, [_OTHER, _START, _END, _NONE]))
        code = np.searchsorted(self.names, symbol)
        self.counts = np.zeros(len(self.names), np.int64)
        self.counts[code] = self.count
        self.other = symbol == _OTHER
        # Each text ends with an end.
        self.ends = np.cumsum(self.sizes + 1)
        self.word = np.ones(len(self.numbers) + len(self.sizes), bool)
        self.word[self.ends - 1] = False
        start, end, none = np.searchsorted(self.names, [_START, _END, _NONE])
        self.code = np.full(len(self.word), end, np.int32)
        self.code[self.word] = code.astype(np.int32)[self.numbers]
        first = self.ends - self.sizes - 1
        self.before = []
        for back in range(1, DEPTH + 1):
            said = np.empty_like(self.code)
            said[back:] = self.code[:-back]
            for place in range(back):
                at = first[self.sizes >= place] + place
                said[at] = start if place == back - 1 else none
            self.before.append(said)
        self.train = np.repeat(~self.held, self.sizes + 1)

    def symbols(self, codes: np.ndarray) -> np.ndarray:
        return self.names[codes]

    def grams(self, depth: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of different symbols with so many before them, ascending, and which of these each of the places at is."""
        which = self.code[at].astype(np.int64)
        first = np.zeros(0, np.int64)
        for b in self.before[:depth]:
            first, which = _ranks(which * len(self.names) + b[at])
        return at[first], which


def _heads(block: pa.Table, words: pa.Table, dealt: Dealt, depth: int) -> pa.Table:
    """Of contexts dealt over several parts, the block's training counts of next symbols."""
    s = _Stream(block, words)
    hit = dealt.often(s.names)[1][s.before[0]] & s.train
    if depth == 2:
        maybe = np.flatnonzero(hit)
        hit[maybe] = dealt.often_pair(*(s.symbols(b[maybe]) for b in s.before[:2]))[1]
    places, which = s.grams(depth, np.flatnonzero(hit))
    n = np.bincount(which, minlength=len(places))
    symbol, last, second = (s.symbols(c[places]) for c in (s.code, *s.before[:2]))
    salts = dealt.salts[dealt.often(last)[0]] if depth == 1 else dealt.pair_salts[dealt.often_pair(last, second)[0]]
    share = mix(symbol.astype(_U)) % salts.astype(_U)
    key = (last, second if depth == 2 else np.full(len(last), _NONE), share.astype(np.int64))
    order = np.lexsort(key[::-1])
    key, symbol, count, n = [k[order] for k in key], symbol[order], s.counts[s.code[places[order]]], n[order]
    new = np.flatnonzero(np.append(True, np.any([k[1:] != k[:-1] for k in key], axis=0))) if len(places) else np.zeros(0, np.int64)
    bounds = np.append(new, len(places))
    bodies = [_packed(symbol[a:b], count[a:b], n[a:b]) for a, b in zip(bounds, bounds[1:])]
    return pa.table({"last": key[0][new], "second": key[1][new], "share": key[2][new], "rows": np.diff(bounds), "body": pa.array(bodies, pa.binary())})


def _summed(rows: pa.Table, part_tokens: int) -> pa.Table:
    """The counts of next symbols of one head, of all blocks."""
    symbol, count, n = np.concatenate([_unpacked(b, r, 3) for b, r in zip(rows["body"].to_pylist(), rows["rows"].to_pylist())], axis=1)
    symbol, first, which = np.unique(symbol, return_index=True, return_inverse=True)
    n = np.bincount(which, weights=n).astype(np.int64)
    often = n > part_tokens
    return pa.table({
        "last": rows["last"][:1], "second": rows["second"][:1], "rows": [len(symbol)], "body": pa.array([_packed(symbol, count[first], n)], pa.binary()),
        "often": pa.array([symbol[often].tolist()], pa.list_(pa.int64())), "seen": pa.array([n[often].tolist()], pa.list_(pa.int64())),
    })


def _routed(s: _Stream, dealt: Dealt) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of a block's different runs of a symbol and those before it, by part; bounds of the parts; the parts; which run stands at each token."""
    places, which = s.grams(DEPTH, np.arange(len(s.code)))
    part = dealt.route(*(s.symbols(b[places]) for b in s.before))
    order = np.argsort(part, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    parts, first = np.unique(part[order], return_index=True)
    return places[order], np.append(first, len(order)), parts, rank[which]


def _asked(block: pa.Table, words: pa.Table, dealt: Dealt) -> pa.Table:
    """Of a block, for each part of the tree the runs that the part decides, with their training counts."""
    s = _Stream(block, words)
    places, bounds, parts, which = _routed(s, dealt)
    n = np.bincount(which, weights=s.train, minlength=len(places)).astype(np.int64)
    code, last, *others = (c[places] for c in (s.code, *s.before))
    out = []
    for part, a, b in zip(parts.tolist(), bounds, bounds[1:]):
        # Sorted by symbol, whose count stands once; few words are the last before one, so these are numbered, frequent ones first.
        new = a + np.flatnonzero(np.diff(code[a:b], prepend=-1))
        held, at, often = np.unique(last[a:b], return_inverse=True, return_counts=True)
        order = np.argsort(-often, kind="stable")
        number = np.empty(len(held), np.int64)
        number[order] = np.arange(len(held))
        body = _packed(_steps(s.names[code[a:b]]), number[at], *(s.names[c[a:b]] for c in others), n[a:b])
        out.append({"part": part, "block": block["block"][0].as_py(), "rows": b - a, "body": body, "kinds": len(new), "counts": _packed(s.counts[code[new]]), "lasts": len(held), "last": _packed(s.names[held[order]])})
    return pa.Table.from_pylist(out, _ASKED)


_ASKED = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("rows", pa.int64()), ("body", pa.binary()), ("kinds", pa.int64()), ("counts", pa.binary()), ("lasts", pa.int64()), ("last", pa.binary())])


def _runs(asked: dict) -> np.ndarray:
    """Of a row of _asked: symbols, their counts, the symbols one, two and three before, training counts."""
    symbol, last, second, third, n = _unpacked(asked["body"], asked["rows"], 5)
    symbol = np.cumsum(symbol)
    kind = np.cumsum(np.diff(symbol, prepend=-1) != 0) - 1
    return np.stack([symbol, _unpacked(asked["counts"], asked["kinds"])[0][kind], _unpacked(asked["last"], asked["lasts"])[0][last], second, third, n])


def chances(symbol: np.ndarray, before: list[np.ndarray], p: np.ndarray, counts: list[np.ndarray]) -> np.ndarray:
    """Chances of symbols, given the longest context in the tree before each.

    before holds the symbols one, two, ... places back (_NONE: no such), p the
    chances without context, counts for each depth what each row adds to the
    training count of its context and symbol.

    A context of at least LEAST tokens is in the tree if its next symbols
    diverge from those after the context without its first symbol: the gain in
    log likelihood must pay half a logarithm of its count for each different
    next symbol (the Bayesian criterion). Its counts are smoothed with the
    chances that the next shorter one in the tree gives, which weigh as much
    as it has different next symbols.
    """
    many = 1 + max(int(c.max(initial=0)) for c in (symbol, *before))
    context, shorter = np.zeros(len(symbol), np.int64), p
    for depth, weight in enumerate(counts):
        _, context = _ranks(context * many + before[depth])
        first, pair = _ranks(context * many + symbol)
        n = np.bincount(pair, weights=np.where(before[depth] != _NONE, weight, 0))
        of = context[first]
        total, kinds = np.bincount(of, weights=n), np.bincount(of, weights=n > 0)
        seen = n > 0
        gain = np.bincount(of[seen], weights=n[seen] * np.log(n[seen] / total[of[seen]] / shorter[first[seen]]), minlength=len(total))
        kept = (total >= LEAST) & (gain >= 0.5 * kinds * np.log(np.maximum(total, 1)))
        p = np.where(kept[context], (n[pair] + kinds[context] * p) / np.maximum(total + kinds, 1)[context], p)
        shorter = n[pair] / np.maximum(total, 1)[context]
    return p


def _decided(asked: pa.Table, heads: pa.Table, dealt: Dealt, t: Totals) -> pa.Table:
    """The part's chances (log10) of the runs that blocks ask for, back to the blocks."""
    sizes = asked["rows"].to_numpy()
    if not len(sizes):
        return pa.table({"block": pa.array([], pa.int64()), "kind": pa.array([], pa.int64()), "rows": pa.array([], pa.int64()), "body": pa.array([], pa.binary())})
    symbol, count, last, second, third, n = np.concatenate([_runs(row) for row in asked.to_pylist()], axis=1)
    mine = len(symbol)
    split = dealt.often(last)[1]
    split_pair = split & dealt.often_pair(last, second)[1]
    counts = [np.where(split, 0, n), np.where(split_pair, 0, n), n]
    if heads.num_rows:
        # What is dealt over several parts has its counts of all parts from the heads.
        rows = heads["rows"].to_numpy()
        more = np.concatenate([_unpacked(b, r, 3) for b, r in zip(heads["body"].to_pylist(), rows)], axis=1)
        more_last, more_second = (np.repeat(heads[c].to_numpy(), rows) for c in ("last", "second"))
        single, none = more_second == _NONE, np.zeros(more.shape[1], np.int64)
        symbol, count = np.append(symbol, more[0]), np.append(count, more[1])
        last, second, third = np.append(last, more_last), np.append(second, more_second), np.append(third, none + _NONE)
        counts = [np.append(c, w) for c, w in zip(counts, (np.where(single, more[2], 0), np.where(single, 0, more[2]), none))]
    p = np.log10(chances(symbol, [last, second, third], t.root(symbol, count), counts)[:mine]).astype(np.float32)
    bodies = [_packed(v) for v in np.split(p, np.cumsum(sizes)[:-1])]
    return pa.table({"block": asked["block"], "kind": asked["part"], "rows": sizes, "body": pa.array(bodies, pa.binary())})


def _spread(s: _Stream, of_word: np.ndarray, of_end: float) -> np.ndarray:
    """A value for each token, given those of the block's words by number and that of ends."""
    out = np.full(len(s.word), of_end, of_word.dtype)
    out[s.word] = of_word[s.numbers]
    return out


def _scored(block: pa.Table, found: pa.Table, dealt: Dealt, t: Totals) -> pa.Table:
    """Scores of the texts of a block, of its words (kind -1) and the chances that the parts gave."""
    s = _Stream(block, found.filter(pc.equal(found["kind"], -1)))
    places, bounds, parts, which = _routed(s, dealt)
    given = {k: (b, r) for k, b, r in zip(found["kind"].to_pylist(), found["body"].to_pylist(), found["rows"].to_pylist())}
    p = np.concatenate([_unpacked(*given[k], kind=np.float32)[0] for k in parts.tolist()]).astype(float)[which]
    end = np.log10((t.texts + 0.1) / t.norm)
    plain = _spread(s, np.log10((s.count + 0.1) / t.norm), end)
    # A word not told apart shares the chance of its symbol by the base counts.
    p += _spread(s, np.where(s.other, np.log10((s.count + 0.1) / max(t.other, 0.1)), 0.0), 0.0)
    known = _spread(s, (s.count > 0).astype(np.int64), int(t.texts > 0))
    summed = lambda v: np.add.reduceat(v, s.ends - s.sizes - 1)
    return pa.table({
        "doc_id": block["ids"][0].values, "held_out": block["held"][0].values, "n_tokens": s.sizes + 1, "n_known": summed(known),
        "train_tokens": np.full(len(s.sizes), t.tokens, np.int64), "base_score": summed(plain), "score": summed(p),
    })


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows not learned from: the CRC-32 of the id as text is divisible by 10. Rows without an id are learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 10 == 0, F.lit(False))


_HEADS = "last long, second long, rows long, body binary, often array<long>, seen array<long>"


def _dealt(blocks: DataFrame, words: DataFrame, t: Totals, texts: int, part_tokens: int) -> tuple[Dealt, DataFrame]:
    """How the tree is cut, and for each part the counts of next symbols of the contexts that it shares with others (part, last, second, rows, body).

    Contexts seen part_tokens times are at most one for so many tokens, so
    they are known everywhere.
    """
    found = {w: n for often, seen in words.filter(F.size("often") > 0).select("often", "seen").collect() for w, n in zip(often, seen)}
    found |= {w: n for w, n in ((_START, texts), (_OTHER, int(t.tokens - t.told))) if n > part_tokens}
    hot = np.array(sorted(found), np.int64)
    split = lambda counts: np.array([-(-n // part_tokens) for n in counts], np.int64)
    none = np.zeros(0, np.int64)
    dealt = Dealt(max(1, -(-t.tokens // part_tokens)), hot, split(found[w] for w in hot.tolist()), none.astype(_U), none)
    each = lambda depth: _with_words(blocks, words, lambda a, b: _heads(a, b, dealt, depth), "last long, second long, share long, rows long, body binary")
    total = lambda depth: persisted(each(depth).groupBy("last", "second", "share").applyInArrow(lambda rows: _summed(rows, part_tokens), _HEADS), f"suffix-heads-{depth}")
    spark = blocks.sparkSession
    if not found:
        return dealt, spark.createDataFrame([], "part long, last long, second long, rows long, body binary")
    heads = total(1)
    pairs = {(w, last): n for last, often, seen in heads.filter(F.size("often") > 0).select("last", "often", "seen").collect() for w, n in zip(often, seen) if w in found}
    if pairs:
        key = _longer(np.array([a for a, _ in pairs], np.int64).astype(_U), np.array([b for _, b in pairs], np.int64))
        order = np.argsort(key)
        dealt = Dealt(dealt.parts, hot, dealt.salts, key[order], split(pairs.values())[order])
        heads = heads.union(total(2))
    listed = [(w, None) for w in found] + list(pairs)
    known = list(pairs)
    where = [(a, _NONE if b is None else b, dealt.parts_of(a, b, known)) for a, b in listed]
    where = spark.createDataFrame(where, "last long, second long, parts array<long>")
    return dealt, heads.join(F.broadcast(where), ["last", "second"]).select(F.explode("parts").alias("part"), "last", "second", "rows", "body")


def _with_words(blocks: DataFrame, found: DataFrame, work, schema: str) -> DataFrame:
    return blocks.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(work, schema)


def scored_texts(documents: DataFrame, part_tokens: int = PART_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of documents (doc_id, text).

    A text is its words (A-Z lower-cased) and one end; tokens are both. score
    is the log10 of the chance that a probabilistic suffix tree gives the
    text: the next symbol depends on the longest run of symbols before it that
    the tree has as a context (see chances). Symbols are the start, the end,
    each word seen LEAST times in the training texts, and one for all other
    words, which share its chance by their counts (and 0.1; all new words
    count as one). Without context the chances are those of base_score, the
    sum of log10((c + 0.1) / (N + 0.1 (V + 1))). The logarithm of a token's
    chance is held in 32 bits, so score is exact to about one part in 10**7.

    Documents are packed into blocks of some million words as numbers of the
    block's words. The vocabulary is counted in shares, and each block gets
    the symbols of its words back. A tree of suffixes branches by the last
    word first, so it is cut there, one part
    for part_tokens tokens: each block sends the different runs of
    words in it to the parts that hold their contexts, a part counts and
    tests its contexts and gives the chances of what was asked. What many
    runs end in is dealt over several parts, with its own counts summed
    before. No task or driver needs the whole vocabulary or the whole tree,
    and all that moves is packed.

    A null text is an empty one: its only token is the end. Repeated rows
    count each. Other columns are left alone. No documents give no rows;
    without training texts every token has chance 1 in the base.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out().alias("held"))
    held_bytes, all_texts, texts = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*"), F.count_if(~F.col("held"))).first()
    shares = max(1, -(-held_bytes // BUCKET_BYTES))
    schema = "block long, ids array<long>, held array<boolean>, sizes array<long>, numbers binary, vocabulary array<struct<share long, rows long, size long, words binary, body binary>>"
    packed = bucketed(docs.mapInArrow(lambda it: _blocks(it, shares), schema), "block", shares, "suffix-blocks")
    blocks = packed.select("block", "ids", "held", "sizes", "numbers")
    vocabulary = packed.select("block", F.explode("vocabulary").alias("v")).select("block", "v.*")
    schema = "block long, kind long, rows long, body binary, tokens long, kinds long, told double, often array<long>, seen array<long>"
    words = vocabulary.groupBy("share").applyInArrow(lambda share: _told(share, shares, part_tokens), schema)
    words = bucketed(words.repartition(shares, "block"), "block", shares, "suffix-words")
    tokens, kinds, told = words.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0)), F.coalesce(F.sum("told"), F.lit(0.0))).first()
    totals = Totals(tokens + texts, kinds + (texts > 0), texts, told)
    dealt, heads = _dealt(blocks, words, totals, all_texts, part_tokens)
    mine = words.select("block", "kind", "rows", "body")
    asked = _with_words(blocks, mine, lambda a, b: _asked(a, b, dealt), "part long, block long, rows long, body binary, kinds long, counts binary, lasts long, last binary")
    schema = "block long, kind long, rows long, body binary"
    decided = asked.groupBy("part").cogroup(heads.groupBy("part")).applyInArrow(lambda a, b: _decided(a, b, dealt, totals), schema)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return _with_words(blocks, mine.union(decided), lambda a, b: _scored(a, b, dealt, totals), schema)
