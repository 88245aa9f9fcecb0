"""Repeated passages across documents: phrases that recur, located again by Aho-Corasick automata."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .storage import persisted
from .words import Chunk, Hasher, chunks, ragged_take

_U = np.uint64
_LOW = _U((1 << 24) - 1)


def _phrases(c: Chunk, h: np.ndarray, hasher: Hasher, k: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows with a whole window: the hash of every run of k words, its first word, its row."""
    words = np.diff(c.first)
    count = np.where(words >= window, words - k + 1, 0)
    starts, _ = ragged_take(np.arange(c.first[-1] + 1), c.first[:-1], count)
    return hasher.runs(h, starts, starts + k), starts, np.repeat(np.arange(c.rows), count)


def _least_of_windows(hashes: np.ndarray, row: np.ndarray, span: int) -> np.ndarray:
    """Places of the least hash of every span of places within one row, the rightmost of equal ones."""
    if len(hashes) < span:
        return np.zeros(0, np.int64)
    place = np.arange(len(hashes), dtype=_U)
    best = (hashes & ~_LOW) | (_LOW - (place & _LOW))
    width = 1
    while 2 * width <= span:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    if width < span:
        best = np.minimum(best[: len(hashes) - span + 1], best[span - width : span - width + len(hashes) - span + 1])
    first = np.flatnonzero(row[: len(row) - span + 1] == row[span - 1 :])
    # The least stands at first <= place < first + span; the low 24 bits name it.
    low = (_LOW - (best[first] & _LOW)).astype(np.int64)
    return np.unique(first + ((low - first) & int(_LOW)))


def _anchors(batches: Iterator[pa.RecordBatch], k: int, window: int) -> Iterator[pa.RecordBatch]:
    """Each document's word count and the hashes of its anchor phrases: any window has one, chosen by its words alone."""
    hasher = Hasher()
    for batch in batches:
        for rows, c in chunks(batch.column(2)):
            h = hasher.words(c.data, c.starts, c.ends)
            runs, _, row = _phrases(c, h, hasher, k, window)
            at = _least_of_windows(runs, row, window - k + 1)
            order = at[np.lexsort((runs[at], row[at]))]
            new = np.ones(len(order), bool)
            new[1:] = (runs[order][1:] != runs[order][:-1]) | (row[order][1:] != row[order][:-1])
            order = order[new]
            bounds = np.searchsorted(row[order], np.arange(c.rows + 1)).astype(np.int32)
            whole = hasher.runs(h, c.first[:-1], c.first[1:])
            part = slice(rows.start, rows.stop)
            yield pa.record_batch({"doc_id": batch.column(0)[part], "t": batch.column(1)[part], "n_words": np.diff(c.first).astype(np.int64), "whole": whole.view(np.int64), "anchors": pa.ListArray.from_arrays(pa.array(bounds), pa.array(runs[order].view(np.int64)))})


def _spaced(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """The words with one space before, between and after them, and where each starts."""
    sizes = c.ends - c.starts
    at = np.ones(len(sizes) + 1, np.int64)
    np.cumsum(sizes + 1, out=at[1:])
    at[1:] += 1
    out = np.full(at[-1], 0x20, np.uint8)
    held, bounds = ragged_take(c.data, c.starts, sizes)
    out[np.arange(len(held)) + np.repeat(at[:-1] - bounds[:-1], sizes)] = held
    return out, at


def _windows(batches: Iterator[pa.RecordBatch], k: int, window: int) -> Iterator[pa.RecordBatch]:
    """Hashes and places of all windows around each occurrence of a recurring phrase.

    An automaton holds the recurring phrases of some megabytes of documents
    and runs over their texts.
    """
    hasher = Hasher()
    for batch in batches:
        recurring = batch.column(3)
        for rows, c in chunks(batch.column(2)):
            h = hasher.words(c.data, c.starts, c.ends)
            runs, first, _ = _phrases(c, h, hasher, k, window)
            wanted = np.unique(recurring[rows.start : rows.stop].flatten().to_numpy()).view(_U)
            if not len(wanted) or not len(runs):
                continue
            text, at = _spaced(c)
            order = np.argsort(runs, kind="stable")
            found = np.searchsorted(runs[order], wanted)
            found = np.minimum(found, len(runs) - 1)
            machine = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
            for word in first[order[found[runs[order[found]] == wanted]]]:
                machine.add_word(text[at[word] - 1 : at[word + k]].tobytes().decode("latin-1"))
            if not len(machine):
                continue
            machine.make_automaton()
            words = np.diff(c.first)
            change = np.zeros(len(h) + 1, np.int64)
            for row in np.flatnonzero(words >= window):
                begin, end = c.first[row], c.first[row + 1]
                from_ = at[begin] - 1
                hits = np.fromiter((e for e, _ in machine.iter(text[from_ : at[end]].tobytes().decode("latin-1"))), np.int64)
                if len(hits):
                    # A hit ends at the space behind the last word of the phrase.
                    last = np.searchsorted(at, hits + from_, "right") - 1
                    np.add.at(change, np.maximum(last - window + 1, begin), 1)
                    np.add.at(change, np.minimum(last - k + 1, end - window) + 1, -1)
            starts = np.flatnonzero(np.cumsum(change[:-1]) > 0)
            row = np.searchsorted(c.first, starts, "right") - 1
            ids, texts = (batch.column(i).to_numpy()[rows][row] for i in (0, 1))
            yield pa.record_batch({"w": hasher.runs(h, starts, starts + window).view(np.int64), "doc_id": ids, "t": texts, "at": (starts - c.first[row]).astype(np.int32)})


def _kept(batches: Iterator[pa.RecordBatch], window: int, with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        copied = batch.column(4).to_pylist()
        for rows, c in chunks(batch.column(2)):
            text, at = _spaced(c)
            change = np.zeros(len(c.starts) + 1, np.int64)
            covered = batch.column(3)[rows.start : rows.stop]
            sizes = np.diff(covered.offsets.to_numpy())
            places = covered.flatten().to_numpy() + np.repeat(c.first[:-1], sizes) if len(covered.flatten()) else np.zeros(0, np.int64)
            np.add.at(change, places, 1)
            np.add.at(change, places + window, -1)
            drop = np.cumsum(change[:-1]) > 0
            for i in np.flatnonzero(copied[rows.start : rows.stop]):
                drop[c.first[i] : c.first[i + 1]] = True
            gone = np.concatenate([[0], np.cumsum(drop)])[c.first]
            clean = np.repeat(~drop, np.diff(at))
            text, ends = text[1:], np.concatenate([[0], np.cumsum(clean)])
            kept = text[clean].tobytes()
            bounds = ends[at[c.first] - 1]
            parts = [kept[a : max(a, b - 1)] for a, b in zip(bounds[:-1], bounds[1:])]
            part = slice(rows.start, rows.stop)
            out = {"doc_id": batch.column(0)[part], "n_words": np.diff(c.first).astype(np.int64), "n_removed": np.diff(gone).astype(np.int64), "kept_sha256": [hashlib.sha256(x).hexdigest() for x in parts]}
            yield pa.record_batch(out | ({"kept": pa.array([x.decode() for x in parts], pa.string())} if with_text else {}))


def _met(rows: DataFrame, found: DataFrame, keys: list[str], label: str) -> DataFrame:
    """rows joined with found (keys, rows, ...), in which rows says how many rows have the keys.

    Keys of more than a thousandth of all rows are less than a thousand, so
    these are broadcast: their rows are dealt over as many salts as they have
    thousandths, and what is found for them goes to each salt.
    """
    found = persisted(found, label)
    part = max(1, rows.count() // 1000)
    salts = F.ceil(F.col("rows") / part).cast("int")
    heavy = found.filter(F.col("rows") > part).select(*keys, salts.alias("salts"))
    salt = F.coalesce(F.pmod(F.xxhash64(*rows.columns), F.col("salts")).cast("int"), F.lit(0))
    salted = rows.join(F.broadcast(heavy), keys, "left").select(*rows.columns, salt.alias("salt"))
    spread = found.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("rows")
    return salted.join(spread, [*keys, "salt"]).drop("salt")


def without_repeats(documents: DataFrame, window: int = 50, k: int = 8, with_text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept]) for every row of documents (doc_id, text).

    A word goes when a window of so many consecutive words covers it whose
    word sequence also starts in a document with a smaller doc_id. kept joins
    the other words by one space.

    Repeated-phrase automata: every window has an anchor, the run of k words
    with the least hash in it, so equal windows have equal anchors. Anchors
    that documents share are confirmed recurring phrases. They are dealt to
    the documents that hold them, compiled into Aho-Corasick automata a few
    megabytes of documents at a time, and the documents stream through to
    locate every occurrence. Only windows around occurrences are compared
    across documents, by 64-bit hashes of their words. Documents with equal
    word sequences count once; all but the first go whole.

    A null text has no words; a text shorter than a window keeps all its
    words; a row without doc_id keeps all and repeats nothing; rows that share
    a doc_id don't repeat each other; other columns are left alone.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("t"), F.col("text").cast("string").alias("text"))
    marked = persisted(docs.mapInArrow(lambda it: _anchors(it, k, window), "doc_id long, t long, n_words long, whole long, anchors array<long>"), "repeats-anchors")
    long = marked.filter(f"doc_id is not null and n_words >= {window}")
    equal = long.groupBy("whole", "n_words").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    long = _met(long, equal, ["whole", "n_words"], "repeats-equal")
    copies = long.filter("doc_id > least").select("doc_id", "t").distinct()
    phrases = persisted(long.filter("doc_id = least").select("doc_id", "t", F.explode("anchors").alias("anchor")), "repeats-phrases")
    recurring = phrases.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("rows")).filter("a <> b").select("anchor", "rows")
    by_document = _met(phrases, recurring, ["anchor"], "repeats-recurring").groupBy("doc_id", "t").agg(F.collect_list("anchor").alias("recurring"))
    near = docs.join(by_document, ["doc_id", "t"]).select("doc_id", "t", "text", "recurring")
    windows = persisted(near.mapInArrow(lambda it: _windows(it, k, window), "w long, doc_id long, t long, at int"), "repeats-windows")
    first = windows.groupBy("w").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("rows")).filter("least <> most").select("w", "least", "rows")
    covered = _met(windows, first, ["w"], "repeats-first").filter("doc_id > least").groupBy("doc_id", "t").agg(F.collect_list("at").alias("at"))
    decided = covered.withColumn("copied", F.lit(False)).unionByName(copies.select("doc_id", "t", F.array().cast("array<int>").alias("at"), F.lit(True).alias("copied")))
    placed = docs.join(decided, ["doc_id", "t"], "left").select("doc_id", "t", "text", F.coalesce("at", F.array().cast("array<int>")).alias("at"), F.coalesce("copied", F.lit(False)).alias("copied"))
    return placed.mapInArrow(lambda it: _kept(it, window, with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text)
