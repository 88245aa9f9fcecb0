"""Test items inside documents, with edits: pigeonhole pieces, then Myers' bit-parallel distance."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Text of test items in one automaton, in bytes; more items make more automata.
SHARD_BYTES = 8 << 20
_WORD = re.compile(r"\w+")
_BETWEEN = re.compile(r"\W+")


@dataclass
class Items:
    """Some test items and the automaton of their pieces."""

    ids: list[int]
    words: list[list[str]]
    errors: list[int]

    def machine(self) -> ahocorasick.Automaton:
        """Every piece leads to the items that have it and to where in them it stands."""
        out: dict[str, list[tuple[int, int]]] = {}
        for n, (words, errors) in enumerate(zip(self.words, self.errors)):
            for i in range(errors + 1):
                a, b = len(words) * i // (errors + 1), len(words) * (i + 1) // (errors + 1)
                out.setdefault(" " + " ".join(words[a:b]) + " ", []).append((n, a))
        found = ahocorasick.Automaton()
        for piece, places in out.items():
            found.add_word(piece, (piece.count(" ") - 1, places))
        found.make_automaton()
        return found


def lowered(text: str) -> str:
    """In lower case, with every character where it was."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


def words_of(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Lower-case words, without punctuation, and where they stand."""
    low = lowered(text)
    spans = [m.span() for m in _WORD.finditer(low)]
    return [low[a:b] for a, b in spans], spans


def myers(pattern: list[str], text: list[str]) -> list[int]:
    """For each word of text: the least edit distance of the pattern to a run that ends there.

    Myers' algorithm: one column of the table in the bits of a few numbers.
    """
    masks: dict[str, int] = {}
    for i, w in enumerate(pattern):
        masks[w] = masks.get(w, 0) | 1 << i
    size = len(pattern)
    full, top = (1 << size) - 1, 1 << (size - 1)
    up, down, score, out = full, 0, size, []
    for w in text:
        same = masks.get(w, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        plus, minus = (down | ~(diagonal | up)) & full, up & diagonal
        score += (plus & top > 0) - (minus & top > 0)
        plus, minus = plus << 1 & full, minus << 1 & full
        up, down = (minus | ~(diagonal | plus)) & full, plus & diagonal
        out.append(score)
    return out


def best_match(item: list[str], errors: int, words: list[str]) -> tuple[int, int, int] | None:
    """(distance, first word, word behind the last) of the nearest run of words, the first of equal ones."""
    ends = myers(item, words)
    least = min(ends, default=errors + 1)
    if least > errors:
        return None
    end = ends.index(least)
    back = myers(item[::-1], words[end::-1])
    # The longest run of that distance that ends there, as an item's own words are in it.
    start = end - max(i for i, d in enumerate(back) if d == least)
    return least, start, end + 1


def _found(text: str, items: Items, machine: ahocorasick.Automaton) -> list[tuple[int, int, int, int, int]]:
    """(number of the item, distance, its words, start, end) of each item in the text."""
    hits = list(machine.iter(_BETWEEN.sub(" ", f" {lowered(text)} "))) if text else []
    if not hits:
        return []
    out = []
    words, spans = words_of(text)
    windows: dict[int, list[tuple[int, int]]] = {}
    # The number of the word before which each hit ends.
    starts = [0]
    for w in words:
        starts.append(starts[-1] + len(w) + 1)
    number = {s: i for i, s in enumerate(starts)}
    for end, (size, places) in hits:
        first = number[end] - size
        for n, at in places:
            e = items.errors[n]
            windows.setdefault(n, []).append((max(0, first - at - e), min(len(words), first - at + len(items.words[n]) + e)))
    for n, found in sorted(windows.items()):
        merged: list[list[int]] = []
        for a, b in sorted(set(found)):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        best = None
        for a, b in merged:
            match = best_match(items.words[n], items.errors[n], words[a:b])
            if match and (best is None or match[0] < best[0]):
                best = (match[0], match[1] + a, match[2] + a)
        if best:
            out.append((n, best[0], len(items.words[n]), spans[best[1]][0], spans[best[2] - 1][1]))
    return out


def _matches(batches: Iterator[pa.RecordBatch], items: Items) -> Iterator[pa.RecordBatch]:
    machine = items.machine()
    for batch in batches:
        rows = [(row, items.ids[found[0]], *found[1:]) for row, text in enumerate(batch.column(1).to_pylist()) for found in _found(text, items, machine)]
        at, *columns = list(zip(*rows)) or [[]] * 6
        yield pa.record_batch([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", "item_id", "distance", "item_words", "start", "end"])


def _clean(batches: Iterator[pa.RecordBatch], items: Items, place: int) -> Iterator[pa.RecordBatch]:
    machine = items.machine()
    for batch in batches:
        yield batch.filter(pa.array([not _found(text, items, machine) for text in batch.column(place).cast(pa.large_string()).to_pylist()], pa.bool_()))


def _shards(benchmark: DataFrame, error_rate: float, min_words: int) -> Iterator[Items]:
    """All items of benchmark, as many at once as have SHARD_BYTES of text."""
    tests = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null and text is not null")
    total = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = -(-2 * total // SHARD_BYTES) or 1
    for shard in range(shards):
        some = tests.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == shard).orderBy("item_id", "text").collect()
        items = Items([], [], [])
        for item_id, text in some:
            words, _ = words_of(text)
            if words:
                items.ids.append(item_id)
                items.words.append(words)
                items.errors.append(min(len(words) - 1, int(error_rate * len(words))) if len(words) >= min_words else 0)
        if items.ids:
            yield items


def contaminated(documents: DataFrame, benchmark: DataFrame, error_rate: float = 0.2, min_words: int = 5) -> DataFrame:
    """(doc_id, item_id, distance, item_words, start, end): every test item in every document that holds it.

    A document of documents (doc_id, text) holds an item of benchmark
    (item_id, text) when a run of its words is at most floor(error_rate *
    words of the item) word edits (one word put in, left out or changed) from
    the item. Words are runs of letters, digits and _, in lower case. start and
    end are code points of the nearest such run (the first of equal ones, as
    long as that distance allows).

    Pigeonhole edit matching: an item of a budget of e errors is cut into e + 1
    pieces, so an occurrence holds at least one unchanged. An Aho-Corasick
    automaton finds all hits of pieces in one run over a text; around hits,
    Myers' bit-parallel algorithm finds the distance.

    Items with fewer than min_words words allow no edits; those without words
    match nothing, as do items or documents with a null id or text. Rows that
    repeat an item or a document give repeated rows; a doc_id may be of any
    type; other columns are left alone. Without items or documents there are
    no rows. Items are read in shards of SHARD_BYTES of text; each shard's
    automaton goes to the tasks, and documents are read once for each shard.
    """
    docs = documents.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id long, distance long, item_words long, start long, end long"
    out = docs.sparkSession.createDataFrame([], schema)
    for items in _shards(benchmark, error_rate, min_words):
        out = out.union(docs.mapInArrow(lambda batches, items=items: _matches(batches, items), schema))
    return out


def without_contaminated(documents: DataFrame, benchmark: DataFrame, error_rate: float = 0.2, min_words: int = 5) -> DataFrame:
    """The documents whose text holds no test item (see contaminated); all columns stay.

    Each row is judged by its own text, so rows without doc_id and rows that
    share one need no rule of their own; a null text holds nothing.
    """
    place = documents.columns.index("text")
    for items in _shards(benchmark, error_rate, min_words):
        documents = documents.mapInArrow(lambda batches, items=items: _clean(batches, items, place), documents.schema)
    return documents
