"""Token counts of a byte-pair vocabulary by merging whole arrays of pre-tokens, rank after rank."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .words import CHUNK_BYTES, Powers, mix, ragged_take, raw

_SPACE = 0x2581
_NONE = np.int32(2**31 - 1)
_U = np.uint64
#: Words whose counts a task remembers; only speed depends on it.
REMEMBERED = 1 << 20


@dataclass
class MergeTable:
    """What merging needs of a vocabulary: single characters and all pairs that make a piece."""

    characters: np.ndarray  # code points, ascending
    character_ids: np.ndarray
    pairs: np.ndarray  # left id << 32 | right id, ascending
    ranks: np.ndarray
    merged: np.ndarray
    one_by_one: np.ndarray  # ranks of which a sequence may apply only the leftmost at a time

    @staticmethod
    def of_sentencepiece(path: str) -> MergeTable:
        """From a BPE .model with byte fallback, a space put before each text and no other normalisation.

        Another kind of model raises ValueError: known strings are counted both ways.
        """
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        special = lambda i: library.is_control(i) or library.is_unknown(i) or library.is_byte(i) or library.is_unused(i)
        ids = {library.id_to_piece(i): i for i in range(library.get_piece_size()) if not special(i)}
        order = sorted({-library.get_score(i) for i in ids.values()})
        rank = {cost: r for r, cost in enumerate(order)}
        rank_of = {piece: rank[-library.get_score(i)] for piece, i in ids.items()}
        if any(a != chr(_SPACE) and b == chr(_SPACE) for piece in ids for a, b in zip(piece, piece[1:])):
            raise ValueError("a piece holds a space after another character: texts can't be cut before spaces")
        found, shared = [], {}
        for piece, i in ids.items():
            for cut in range(1, len(piece)):
                left, right = piece[:cut], piece[cut:]
                if left in ids and right in ids:
                    found.append((ids[left] << 32 | ids[right], rank_of[piece], i))
                    # A merge that comes before those of its parts, or ties with another piece's, may change what stands next.
                    for part in (left, right):
                        if len(part) > 1 and rank_of[piece] <= rank_of[part]:
                            shared[rank_of[part]] = shared[rank_of[piece]] = True
        pieces_of: dict[int, int] = {}
        for piece, r in rank_of.items():
            if len(piece) > 1:
                pieces_of[r] = pieces_of.get(r, 0) + 1
        shared |= {r: True for r, n in pieces_of.items() if n > 1}
        pairs = np.array(sorted(found), np.int64).reshape(-1, 3)
        single = np.array(sorted((ord(p), i) for p, i in ids.items() if len(p) == 1), np.int64).reshape(-1, 2)
        one = np.zeros(len(order), bool)
        one[list(shared)] = True
        table = MergeTable(single[:, 0], single[:, 1].astype(np.int32), pairs[:, 0].copy(), pairs[:, 1].astype(np.int32), pairs[:, 2].astype(np.int32), one)
        probes = ["", " ", "a", "  Two  spaces ", "aaaaaaa bananas", "tab\tnew\nline", "　 ﬁ é  ", "<s> <unk> <0x0A> ▁x", "\U0001f600 \x00 " + " " * 40, "1234567890" * 9]
        if Counter(table).count(pa.array(probes)).tolist() != [len(library.encode(x)) for x in probes]:
            raise ValueError("this model does more than merging pairs of a text with a space before it")
        return table


class Counter:
    """Counts tokens of Arrow batches; remembers the counts of words."""

    def __init__(self, table: MergeTable):
        self.table = table
        self.id_of = np.full(0x110000, -1, np.int32)
        self.id_of[table.characters] = table.character_ids
        self.letters = mix(np.arange(0x110000, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(7))
        self.powers = Powers(0xD1342543DE82EF95)
        self.known, self.known_counts = np.zeros(0, _U), np.zeros(0, np.int32)

    def count(self, column: pa.Array) -> np.ndarray:
        """Tokens of each text of the column; a null has none."""
        out = np.zeros(len(column), np.int64)
        if not len(column):
            return out
        data, bounds = raw(column)
        at = 0
        while at < len(column):
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + CHUNK_BYTES, "right")) - 1)
            out[at:to] = self._some(data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at])
            at = to
        return out

    def _some(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        rows = len(bounds) - 1
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        before = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=before[1:])
        bounds = before[bounds]
        full = np.flatnonzero(np.diff(bounds))
        if not len(full):
            return np.zeros(rows, np.int64)
        # A space goes before each text that isn't empty.
        text = np.insert(np.where(points == 0x20, _SPACE, points).astype(np.int64), bounds[full], _SPACE)
        row_starts = bounds[full] + np.arange(len(full))
        is_space = text == _SPACE
        starts = is_space.copy()
        starts[1:] &= ~is_space[:-1]
        starts[row_starts] = True
        starts = np.flatnonzero(starts)
        ends = np.append(starts[1:], len(text))
        up, down = self.powers.take(len(text) + 1)
        total = np.zeros(len(text) + 1, _U)
        np.cumsum(self.letters[text] * up[: len(text)], out=total[1:])
        names, first, which = np.unique(mix((total[ends] - total[starts]) * down[starts]), return_index=True, return_inverse=True)
        tokens = np.concatenate([[0], np.cumsum(self._counts(names, text, starts[first], ends[first])[which])])
        out = np.zeros(rows, np.int64)
        cuts = np.searchsorted(starts, np.append(row_starts, len(text)))
        out[full] = tokens[cuts[1:]] - tokens[cuts[:-1]]
        return out

    def _counts(self, names: np.ndarray, text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        place = np.minimum(np.searchsorted(self.known, names), max(len(self.known) - 1, 0))
        held = self.known[place] == names if len(self.known) else np.zeros(len(names), bool)
        out = np.zeros(len(names), np.int64)
        out[held] = self.known_counts[place[held]]
        new = np.flatnonzero(~held)
        if len(new):
            out[new] = self._merge(*ragged_take(text, starts[new], (ends - starts)[new]))
            if len(self.known) + len(new) > REMEMBERED:
                self.known, self.known_counts = names[:0], np.zeros(0, np.int32)
            both = np.concatenate([self.known, names[new]])
            order = np.argsort(both, kind="stable")
            self.known, self.known_counts = both[order], np.concatenate([self.known_counts, out[new].astype(np.int32)])[order]
        return out

    def _rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        t = self.table
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(t.pairs, key), len(t.pairs) - 1)
        hit = t.pairs[at] == key
        return np.where(hit, t.ranks[at], _NONE), at

    def _merge(self, text: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Symbols that survive in each sequence; a character outside the vocabulary counts its bytes."""
        count = np.zeros(len(bounds) - 1, np.int64)
        symbol = self.id_of[text]
        strange = symbol < 0
        extra = np.where(strange, (text > 0x7F).astype(np.int64) + (text > 0x7FF) + (text > 0xFFFF), 0)
        count += np.add.reduceat(extra, bounds[:-1]) if len(text) else 0
        sequence = np.repeat(np.arange(len(count)), np.diff(bounds))
        rank = np.full(len(text), _NONE, np.int32)
        pair = np.zeros(len(text), np.int64)
        here = np.flatnonzero((sequence[1:] == sequence[:-1]) & ~strange[1:] & ~strange[:-1])
        rank[here], pair[here] = self._rank(symbol[here], symbol[here + 1])
        while len(symbol):
            head = np.flatnonzero(np.concatenate([[True], sequence[1:] != sequence[:-1]]))
            sizes = np.diff(np.append(head, len(symbol)))
            least = np.minimum.reduceat(rank, head)
            done = least == _NONE
            if done.any():
                count[sequence[head[done]]] += sizes[done]
                keep = np.repeat(~done, sizes)
                symbol, sequence, rank, pair = symbol[keep], sequence[keep], rank[keep], pair[keep]
                sizes, least = sizes[~done], least[~done]
                if not len(symbol):
                    break
                head = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            chosen = np.flatnonzero(rank == np.repeat(least, sizes))
            owner = sequence[chosen]
            leftmost = np.concatenate([[True], owner[1:] != owner[:-1]])
            # Pairs that overlap: every second one of a run of neighbours, from the left.
            start = leftmost | np.concatenate([[True], chosen[1:] != chosen[:-1] + 1])
            run = np.maximum.accumulate(np.where(start, np.arange(len(chosen)), 0))
            chosen = chosen[np.where(self.table.one_by_one[rank[chosen]], leftmost, (np.arange(len(chosen)) - run) % 2 == 0)]
            symbol[chosen] = self.table.merged[pair[chosen]]
            keep = np.ones(len(symbol), bool)
            keep[chosen + 1] = False
            moved = (np.cumsum(keep) - 1)[chosen]
            symbol, sequence, rank, pair = symbol[keep], sequence[keep], rank[keep], pair[keep]
            again = np.unique(np.concatenate([moved, moved - 1]))
            again = again[again >= 0]
            inside = again[again < len(symbol) - 1]
            inside = inside[(sequence[inside] == sequence[inside + 1]) & (symbol[inside] >= 0) & (symbol[inside + 1] >= 0)]
            rank[again] = _NONE
            rank[inside], pair[inside] = self._rank(symbol[inside], symbol[inside + 1])
        return count


def _count(batches: Iterator[pa.RecordBatch], table: MergeTable, limit: int) -> Iterator[pa.RecordBatch]:
    counter = Counter(table)
    for batch in batches:
        column = batch.column(1)
        tokens = counter.count(column)
        yield pa.record_batch({"doc_id": batch.column(0), "n_bytes": np.diff(raw(column)[1]) if len(column) else tokens, "n_tokens": tokens, "over_limit": tokens > limit})


def token_counts(documents: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of documents (doc_id, text).

    Rank-synchronous array merging: the distinct pre-tokens of some megabytes
    of texts stand in ragged numpy arrays; in each round every sequence applies
    its lowest-ranked pair at all its places at once, until none has one. The
    symbols that survive are the tokens. Where ranks tie or a merge precedes
    those of its parts, a sequence applies only the leftmost.

    A null text counts as an empty one, which has no tokens; special strings
    in a text are ordinary text; other columns are left alone. The model's
    file is read once, on the driver; its table goes to the tasks.
    """
    table = MergeTable.of_sentencepiece(model_path)
    docs = documents.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean"
    return docs.mapInArrow(lambda it: _count(it, table, limit), schema)
