"""Document quality by a linear-chain conditional random field over lines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .words import Chunk, Hasher, chunks

#: At most so many labelled documents train the model: the first by a hash of their id.
TRAINING_DOCUMENTS = 4000
#: Of a training document only so many lines train the model; every line is scored.
TRAINING_LINES = 400

_CLASS = np.full(256, 5, np.uint8)  # other signs
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58] = 0, 1, 2
_CLASS[0x80:] = 1  # parts of other letters
_CLASS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 3
_CLASS[[ord(x) for x in ".,;:?'-\""]] = 4
FEATURES = ("bias", "upper", "digit", "mark", "sign", "log_words", "word_size", "ends_mark", "sign_words", "capital_words", "repeated", "repeats", "bar", "bang", "few_words", "log_bytes", "short_line")


def _line_table(c: Chunk, hasher: Hasher) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of each line, its bytes, and bounds of the lines of each row; every row has a line."""
    data, rows = c.data, c.rows
    breaks = np.flatnonzero(data == 0x0A)
    starts = np.sort(np.concatenate([c.bounds[:-1], breaks + 1]))
    row_of_break = np.searchsorted(c.bounds, breaks, "right") - 1
    lines = np.bincount(row_of_break, minlength=rows) + 1
    first = np.concatenate([[0], np.cumsum(lines)])
    row = np.repeat(np.arange(rows), lines)
    # A break's line ends before it; the last line of a row with the row.
    ends = np.empty(len(starts), np.int64)
    last = np.zeros(len(starts), bool)
    last[first[1:] - 1] = True
    ends[last], ends[~last] = c.bounds[1:], breaks
    starts = np.empty(len(ends), np.int64)
    head = np.zeros(len(ends), bool)
    head[first[:-1]] = True
    starts[head], starts[~head] = c.bounds[:-1], breaks + 1
    kind = _CLASS[data]

    def within(hit: np.ndarray) -> np.ndarray:
        total = np.zeros(len(hit) + 1, np.int32)
        np.cumsum(hit, out=total[1:], dtype=np.int32)
        return (total[ends] - total[starts]).astype(np.float64)

    upper, digit, mark, sign = (within(kind == k) for k in (0, 2, 4, 5))
    lower = within((kind == 1) & (data < 0x80))
    at_start, at_end, caps = (np.zeros(len(data), bool) for _ in range(3))
    at_start[c.starts] = True
    at_end[c.ends - 1] = kind[c.ends - 1] == 5
    caps[c.starts] = kind[c.starts] == 0
    words, sign_words, capital = within(at_start), within(at_end), within(caps)
    solid = within(kind != 3)
    names = hasher.words(data, starts, ends)
    order = np.lexsort((names, row))
    same = np.zeros(len(order) + 1, bool)
    same[1:-1] = (names[order][1:] == names[order][:-1]) & (row[order][1:] == row[order][:-1])
    twin = np.empty(len(order), bool)
    twin[order] = same[1:] | same[:-1]
    twin &= words > 0
    tail = np.zeros(len(ends), bool)
    full = ends > starts
    tail[full] = (kind[ends[full] - 1] == 4) & (data[ends[full] - 1] != 0x2C)
    size = np.maximum(solid, 1)
    wide = np.maximum(words, 1)
    some = np.add.reduceat((twin * solid), first[:-1]) / np.maximum(np.add.reduceat(solid, first[:-1]), 1)
    table = np.stack([
        np.ones(len(ends)), upper / np.maximum(upper + lower, 1), digit / size, mark / size, np.minimum(sign / size, 0.5) * 2, np.log1p(words) / 5,
        np.minimum(solid / wide, 20) / 10, tail, sign_words / wide, capital / wide, twin, some[row], within(data == 0x7C) / wide, within(data == 0x21) / wide, words < 4, np.log1p(np.add.reduceat(solid, first[:-1]))[row] / 10, solid < 40,
    ], axis=1)
    return table, solid, first


def _with_neighbours(table: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The features of a line, of the line before and of the line behind it; zeros where there is none."""
    before, behind = np.zeros_like(table), np.zeros_like(table)
    before[1:], behind[:-1] = table[:-1], table[1:]
    before[first[:-1]] = 0
    behind[first[1:] - 1] = 0
    return np.concatenate([table, before, behind], axis=1)


@dataclass
class Field:
    """Weights of the emission of a good line, and of staying good, staying bad and starting good."""

    emission: np.ndarray
    stay_good: float
    stay_bad: float
    start: float

    @staticmethod
    def size() -> int:
        return 3 * len(FEATURES) + 3

    @staticmethod
    def of(w: np.ndarray) -> Field:
        return Field(w[:-3], float(w[-3]), float(w[-2]), float(w[-1]))

    def marginals(self, score: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """By forward-backward over all rows at once: for each line the chance of good; of good-good and bad-bad with the line before (0 at a first line); of each row the log of the sum over labellings."""
        n = np.diff(first)
        order = np.argsort(-n, kind="stable")
        counts = np.sort(n)
        g, b = np.zeros(len(score)), np.zeros(len(score))
        out_g, out_b = np.zeros(len(score)), np.zeros(len(score))
        at = first[:-1][order]
        g[at], b[at] = score[at] + self.start, 0.0
        longest = int(n.max(initial=0))
        alive = [len(n) - np.searchsorted(counts, t, "right") for t in range(longest)]
        for t in range(1, longest):
            i = at[: alive[t]] + t
            pg, pb = g[i - 1], b[i - 1]
            g[i] = score[i] + np.logaddexp(pg + self.stay_good, pb)
            b[i] = np.logaddexp(pb + self.stay_bad, pg)
        for t in range(longest - 2, -1, -1):
            i = at[: alive[t + 1]] + t
            ng, nb = out_g[i + 1] + score[i + 1], out_b[i + 1]
            out_g[i] = np.logaddexp(ng + self.stay_good, nb)
            out_b[i] = np.logaddexp(nb + self.stay_bad, ng)
        z = np.logaddexp(g[first[1:] - 1], b[first[1:] - 1])
        each = np.repeat(z, n)
        good = np.exp(g + out_g - each)
        gg, bb = np.zeros(len(score)), np.zeros(len(score))
        inner = np.ones(len(score), bool)
        inner[first[:-1]] = False
        i = np.flatnonzero(inner)
        gg[i] = np.exp(g[i - 1] + self.stay_good + score[i] + out_g[i] - each[i])
        bb[i] = np.exp(b[i - 1] + self.stay_bad + out_b[i] - each[i])
        return good, gg, bb, z


def fit(x: np.ndarray, first: np.ndarray, good: np.ndarray, rounds: int = 150, ridge: float = 2e-3) -> Field:
    """The field whose labelling of all lines of a row by the row's label is likeliest, by Adam.

    Rows weigh alike however many lines they have.
    """
    n = np.diff(first)
    weight = 1.0 / n
    per_line, label = np.repeat(weight, n), np.repeat(good, n)
    w = np.zeros(Field.size())
    step, square = np.zeros_like(w), np.zeros_like(w)
    inner = n - 1
    for t in range(1, rounds + 1):
        field = Field.of(w)
        p, gg, bb, _ = field.marginals(x @ field.emission, first)
        heads = p[first[:-1]]
        slope = np.concatenate([
            x.T @ (per_line * (p - label)),
            [np.dot(weight, np.add.reduceat(gg, first[:-1]) - inner * good), np.dot(weight, np.add.reduceat(bb, first[:-1]) - inner * (1 - good)), np.dot(weight, heads - good)],
        ]) / len(n) + ridge * w
        step, square = 0.9 * step + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        w = w - 0.1 * (step / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
    return Field.of(w)


def _scores(field: Field, c: Chunk, hasher: Hasher) -> np.ndarray:
    table, size, first = _line_table(c, hasher)
    good, *_ = field.marginals(_with_neighbours(table, first) @ field.emission, first)
    weight = size + 1e-6
    return np.clip(np.add.reduceat(good * weight, first[:-1]) / np.add.reduceat(weight, first[:-1]), 0, 1)


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of the lines of labelled documents, as bytes."""
    hasher = Hasher()
    for batch in batches:
        for rows, c in chunks(batch.column(1)):
            table, _, first = _line_table(c, hasher)
            x = _with_neighbours(table, first).astype(np.float32)
            held = [x[a : min(b, a + TRAINING_LINES)].tobytes() for a, b in zip(first[:-1], first[1:])]
            yield pa.record_batch({"good": batch.column(0)[rows.start : rows.stop], "lines": pa.array(held, pa.binary())})


def train(documents: DataFrame, labels: DataFrame) -> Field:
    """A field from at most TRAINING_DOCUMENTS documents (doc_id, text) with a label (doc_id, quality).

    Labels are read where doc_id and quality are not null; conflicting labels
    of a document count each. Without documents of both labels the field is
    flat: every score is 0.5.
    """
    marks = labels.filter("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("_id"), (F.col("quality") > 0).cast("double").alias("good"))
    marks = marks.orderBy(F.xxhash64("_id"), "_id", "good").limit(TRAINING_DOCUMENTS)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # The marks are at most TRAINING_DOCUMENTS rows, so they may be broadcast.
    held = docs.join(F.broadcast(marks), docs["doc_id"] == marks["_id"]).select("good", "text").mapInArrow(_examples, "good double, lines binary")
    rows = sorted((r[0], bytes(r[1])) for r in held.collect())
    if len({good for good, _ in rows}) < 2:
        return Field(np.zeros(3 * len(FEATURES)), 0.0, 0.0, 0.0)
    x = np.concatenate([np.frombuffer(b, np.float32).reshape(-1, 3 * len(FEATURES)) for _, b in rows]).astype(np.float64)
    first = np.concatenate([[0], np.cumsum([len(b) // (12 * len(FEATURES)) for _, b in rows])])
    return fit(x, first, np.array([good for good, _ in rows]))


def quality_scores(documents: DataFrame, field: Field, threshold: float = 0.7) -> DataFrame:
    """documents (doc_id, text) to (doc_id, score, predicted), a row for each row.

    Each line of a text is good or bad by a linear-chain conditional random
    field over features of the line and of both its neighbours; the
    forward-backward chances of good, weighted by the lines' bytes that are
    not white space, average to the score. A null or empty text has one empty
    line. predicted is 1 if score >= threshold, else 0.
    """
    docs = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, predicted int"

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for rows, c in chunks(batch.column(1)):
                s = _scores(field, c, hasher)
                yield pa.record_batch({"doc_id": batch.column(0)[rows.start : rows.stop], "score": s, "predicted": (s >= threshold).astype(np.int32)})

    return docs.mapInArrow(scored, schema)


def held_out(doc_id: str = "doc_id"):
    """Rows never learned from: the CRC-32 of the id as text leaves 2 when divided by 4. False for a row without an id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def without_bad(documents: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The documents that a field trained on the labels accepts; all columns stay."""
    field = train(documents, labels.filter(~held_out()))
    place = documents.columns.index("text")

    # The score depends on the text alone, so the filter needs no join.
    def accepted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for rows, c in chunks(batch.column(place)):
                yield batch.slice(rows.start, rows.stop - rows.start).filter(pa.array(_scores(field, c, hasher) >= threshold))

    return documents.mapInArrow(accepted, documents.schema)
