"""Near copies by the Jaccard similarity of word shingles: a size-aware heavy-light join."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .components import components
from .storage import persisted
from .words import Chunk, Hasher, chunks, mix, ragged_take

_U = np.uint64
NEEDED_BITS = 23
#: A set of this size is the largest that may count as small.
SMALL_AT_MOST = 16
#: Lists of more sets count as long.
LONG = 16
#: Lists are looked at again with other leaders while their pairs are more than so many times their entries.
PAIRS_AN_ENTRY = 4


def least_overlap(a: int, b: int, percent: int) -> int:
    """Elements that sets of sizes a and b must share to be similar enough."""
    return -(-percent * (a + b) // (100 + percent))


def shingles(c: Chunk, hasher: Hasher, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, ascending; their bounds; the row of each."""
    words = np.diff(c.first)
    count = np.where(words >= k, words - k + 1, np.minimum(words, 1))
    starts, _ = ragged_take(np.arange(c.first[-1] + 1), c.first[:-1], count)
    row = np.repeat(np.arange(c.rows), count)
    h = hasher.runs(hasher.words(c.data, c.starts, c.ends), starts, np.minimum(starts + k, c.first[1:][row]))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    return h, np.searchsorted(row, np.arange(c.rows + 1)), row


def _sum_by_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, _U)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _signature(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that do not depend on the order of a set's elements."""
    return _sum_by_row(mix(h), bounds).view(np.int64), _sum_by_row(mix(h ^ _U(0xA0761D6478BD642F)), bounds).view(np.int64)


def _profile(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Size and signature of the set of each document."""
    hasher = Hasher()
    for batch in batches:
        for rows, c in chunks(batch.column(1), lower=True):
            h, bounds, _ = shingles(c, hasher, k)
            s1, s2 = _signature(h, bounds)
            yield pa.record_batch({"doc_id": batch.column(0).slice(rows.start, rows.stop - rows.start), "n": np.diff(bounds).astype(np.int64), "s1": s1, "s2": s2})


class Classes:
    """Classes of sizes, such that sets similar enough are of the same class or the next.

    Sets of class i meet as the smaller one in instance i, and as the larger
    one in instance i - 1. In an instance the hash space is cut into `parts`
    equal ranges, more than the `apart` elements that only one of two similar
    sets may have: so they agree in some range.
    """

    def __init__(self, percent: int, most: int = 1 << 40):
        first = [1]
        while first[-1] <= most:
            first.append(max(first[-1] * 100 // percent + 1, first[-1] + first[-1] // 8))
        self.percent = percent
        self.first = np.array(first, np.int64)
        last = self.first[1:] - 1
        self.apart = np.append((last + last * 100 // percent) * (100 - percent) // (100 + percent), 0)
        self.parts = self.apart + self.apart // 8 + 3

    def keys(self, h: np.ndarray, bounds: np.ndarray, row: np.ndarray, larger: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys of the inverted lists that each set is in, their bounds, and how many ranges hold elements.

        A key is a range with all the set's elements in it. Only sets that
        have so few elements that the ranges without any could be all in which
        they agree are in the lists of the elements of their prefix, too.
        """
        n = np.diff(bounds)
        instance = np.searchsorted(self.first, n, "right") - 1 - larger
        use = (n > 0) & (instance >= 0)
        parts, apart = np.where(use, self.parts[instance], 0), np.where(use, self.apart[instance], 0)
        part = ((h >> _U(32)) * parts.astype(_U)[row]) >> _U(32)
        new = np.ones(len(h), bool)
        new[1:] = (part[1:] != part[:-1]) | (row[1:] != row[:-1])
        at = np.flatnonzero(new)
        at = at[use[row[at]]]
        ends = np.searchsorted(np.append(np.flatnonzero(new), len(h)), at, "right")
        ends = np.append(np.flatnonzero(new), len(h))[ends]
        total = np.zeros(len(h) + 1, _U)
        np.cumsum(mix(h ^ _U(0x8EBC6AF09C88C6E3)), out=total[1:])
        of = row[at]
        salt = mix(instance.astype(_U) * _U(0x9E3779B97F4A7C15) + _U(7))
        keys = mix(total[ends] - total[at] + part[at] * _U(0xAF251AF3B0F025B5) + salt[of])
        filled = np.bincount(of, minlength=len(n))
        few = np.flatnonzero(use & (filled <= apart))
        if len(few):
            more, cut = ragged_take(h, bounds[few], n[few] - -(-self.percent * n[few] // 100) + 1)
            of = np.concatenate([of, np.repeat(few, np.diff(cut))])
            keys = np.concatenate([keys, mix(more ^ salt[of[len(keys) :]])])
            order = np.argsort(of, kind="stable")
            of, keys = of[order], keys[order]
        return keys, np.searchsorted(of, np.arange(len(n) + 1)), filled


def _subset_keys(sets: np.ndarray, a: int, b: int, size: int) -> np.ndarray:
    """Of rows of equally large sorted sets: a hash of each subset of that size, salted with the pair of sizes."""
    at = np.array(list(combinations(range(sets.shape[1]), size)), np.int64)
    key = np.full((len(sets), len(at)), (a * 1000 + b) * 1000 + size, _U)
    for i in range(size):
        key = mix(key * _U(0x9E3779B97F4A7C15) + sets[:, at[:, i]])
    return key


def plan_small(sizes: dict[int, int], percent: int) -> int:
    """The boundary: the largest size that counts as small, where the estimated cost is least.

    A small set costs one row for each subset that it enumerates; a large set,
    and a small one that may have a large partner, costs two for each of its
    inverted lists, as these are also scanned and verified.
    """
    classes = Classes(percent, 1 << 20)

    def subsets(a: int, most: int) -> int:
        return sum(math.comb(a, c) for b in range(1, most + 1) if (c := least_overlap(a, b, percent)) <= min(a, b))

    def lists(a: int) -> int:
        at = int(np.searchsorted(classes.first, a, "right")) - 1
        return sum(min(a, int(classes.parts[i])) for i in (at - 1, at) if i >= 0)

    def cost(most: int) -> int:
        from_ = -(-percent * (most + 1) // 100)
        return sum(n * (subsets(a, most) * (a <= most) + 2 * lists(a) * (a >= from_)) for a, n in sizes.items())

    return min(range(SMALL_AT_MOST + 1), key=cost)


#: What a row of a list says besides its key and set: the size of the set, how many ranges it fills, and in which part it is there.
_SMALLER, _SUBSET_SMALLER, _SUBSET_LARGER, _LARGER = range(4)


def _entries(batches: Iterator[pa.RecordBatch], k: int, percent: int, small: int) -> Iterator[pa.RecordBatch]:
    """Keys of subsets of small sets, and of the inverted lists of sets that are not small or may have a partner that is not."""
    hasher, classes = Hasher(), Classes(percent)

    def out(ids: pa.Array, s1: np.ndarray, n: np.ndarray, filled: np.ndarray, part: int, keys: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(keys.view(np.int64)))
        return pa.record_batch({"doc_id": ids, "s1": s1, "info": (n.astype(np.int64) << 32) | (filled << 2) | part, "keys": lists})

    for batch in batches:
        for rows, c in chunks(batch.column(1), lower=True):
            ids = batch.column(0).slice(rows.start, rows.stop - rows.start)
            h, bounds, row = shingles(c, hasher, k)
            s1, _ = _signature(h, bounds)
            n = np.diff(bounds)
            for a in range(1, small + 1):
                if not len(mine := np.flatnonzero(n == a)):
                    continue
                sets = h[bounds[mine][:, None] + np.arange(a)]
                for part, partners in ((_SUBSET_SMALLER, range(a, small + 1)), (_SUBSET_LARGER, range(1, a))):
                    keys = [_subset_keys(sets, min(a, b), max(a, b), size) for b in partners if (size := least_overlap(a, b, percent)) <= min(a, b)]
                    if keys:
                        keys = np.concatenate(keys, axis=1)
                        yield out(ids.take(pa.array(mine)), s1[mine], n[mine], np.zeros(len(mine), np.int64), part, keys.ravel(), np.arange(len(mine) + 1) * keys.shape[1])
            least = max(1, -(-percent * (small + 1) // 100))
            for part in (_SMALLER, _LARGER):
                keys, at, filled = classes.keys(h, bounds, row, part == _LARGER)
                mine = np.flatnonzero((n >= least) & (np.diff(at) > 0))
                if len(mine) < len(n):
                    keys, at = ragged_take(keys, at[mine], np.diff(at)[mine])
                yield out(ids.take(pa.array(mine)), s1[mine], n[mine], filled[mine], part, keys, at)


def _sets(batches: Iterator[pa.RecordBatch], k: int, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The whole sets of the documents whose bit is set."""
    hasher = Hasher()
    for batch in batches:
        at = batch.column(2).to_numpy() - 1
        batch = batch.filter(pa.array((bits[at >> 3] >> (at & 7)) & 1 == 1))
        for rows, c in chunks(batch.column(1), lower=True):
            h, bounds, _ = shingles(c, hasher, k)
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(h.view(np.int64)))
            yield pa.record_batch({"doc_id": batch.column(0).slice(rows.start, rows.stop - rows.start), "elements": lists})


def _whole_sets(ids: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, elements) of the documents with these ids, made again from their texts."""
    place = lambda c: 1 + F.pmod(F.xxhash64(c), F.lit(1 << NEEDED_BITS))  # noqa: E731  as bitmaps count from 1
    # A bitmap of fixed size: documents without a bit are not wanted; the join removes what else passes.
    marked = ids.select(place("id").alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    bits = np.zeros((1 << NEEDED_BITS) // 8, np.uint8)
    for b, held in marked.collect():
        bits[(b - 1) * 4096 : b * 4096] = np.frombuffer(held, np.uint8)
    sets = docs.select("doc_id", "text", place("doc_id").alias("p")).filter("doc_id is not null").mapInArrow(lambda it: _sets(it, k, bits), "doc_id long, elements array<long>")
    return sets.join(ids, sets["doc_id"] == ids["id"], "left_semi")


def _verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int, label: str) -> DataFrame:
    """Those of the pairs (u, v) whose sets, made again from the texts, are similar enough."""
    pairs = persisted(pairs.select("u", "v").distinct(), f"{label}-candidates")
    sets = persisted(_whole_sets(pairs.select(F.col("u").alias("id")).union(pairs.select("v")).distinct(), docs, k), f"{label}-sets")
    left = pairs.join(sets.select(F.col("doc_id").alias("u"), F.col("elements").alias("x")), "u")
    both = left.join(sets.select(F.col("doc_id").alias("v"), F.col("elements").alias("y")), "v")
    common = F.size(F.array_intersect("x", "y"))
    return both.filter(common * (100 + percent) >= percent * (F.size("x") + F.size("y"))).select("u", "v").distinct()


def _differ(sizes: str, percent: int) -> str:
    """So many elements at most are only in one of two similar sets of together that size."""
    return f"(({sizes}) * {100 - percent} div {100 + percent})"


def _without_long(lists: DataFrame, percent: int) -> DataFrame:
    """Each set without its longest lists, as many as it can miss; dropped says how many those are.

    A set that fills f ranges agrees with a similar one in at least f less
    those that may differ. With lists in one order, short ones first, as many
    less one can be left out at the end: similar sets still meet in a list.
    Only long ones are left out, and sets that are in too few lists.
    """
    of_set = Window.partitionBy("rep", "smaller")
    lists = lists.withColumns({"met": F.count("*").over(of_set), "longs": F.count(F.when(F.col("len") > LONG, 1)).over(of_set), "at": F.row_number().over(of_set.orderBy(F.desc("len"), "key"))})
    lists = lists.withColumn("need", F.expr(f"greatest(1, f - {_differ(f'n + if(smaller, n * 100 div {percent}, n)', percent)})")).filter("met >= need")
    lists = lists.withColumn("dropped", F.least("longs", F.col("need") - 1)).filter("at > dropped")
    central = F.min(F.when(F.col("smaller"), F.struct((F.col("f") - F.col("met")).alias("own"), "rep"))).over(Window.partitionBy("key"))
    return lists.withColumn("leader", central["rep"]).drop("met", "longs", "at", "need", "len")


def _apart_still(open_sets: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (u, v) of sets (rep, n, c) of different clusters c that may be similar enough.

    The lists of the single elements in the prefixes of these sets, seldom
    elements first: what two sets share from one of them on must be enough.
    """
    sets = _whole_sets(open_sets.select(F.col("rep").alias("id")), docs, k)
    each = sets.join(open_sets, sets["doc_id"] == open_sets["rep"]).select("rep", "n", "c", F.explode("elements").alias("key"))
    of_key, of_set = Window.partitionBy("key"), Window.partitionBy("rep")
    each = each.withColumns({"len": F.count("*").over(of_key), "low": F.min("c").over(of_key), "high": F.max("c").over(of_key)}).filter("len > 1")
    # Elements of one set only stand first.
    each = each.withColumn("after", F.col("n") - F.row_number().over(of_set.orderBy("len", "key")) + 1 - (F.col("n") - F.count("*").over(of_set)))
    each = each.filter(f"low <> high and after * 100 >= n * {percent}").select("key", "rep", "n", "c", "after")
    each = persisted(each, "jaccard-prefixes")
    x, y = (each.select("key", *(F.col(a).alias(b) for a, b in zip(("rep", "n", "c", "after"), names))) for names in (("u", "n", "c", "p"), ("v", "m", "d", "q")))
    return x.join(y, "key").filter(f"u < v and c <> d and least(p, q) * {100 + percent} >= {percent} * (n + m)").select("u", "v").distinct()


def near_copies(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of documents (doc_id, text).

    The set of a document holds its distinct runs of k words after A-Z is
    lower-cased, its whole word sequence if that is shorter, nothing without
    words. Documents link when 100 * |intersection| >= percent * |union|;
    component_id is the least doc_id that links reach.

    Size-aware heavy-light join: rows with equal sets become one
    representative first. Small sets enumerate their subsets of the size that
    a pair of their sizes must share, so a common subset is a link. Large sets
    go to inverted lists. The lists of single elements grow with the square
    of what is common in a corpus, so a list is one of a range of the hash
    space and all the elements that a set has there; the ranges are more than
    the elements that two similar sets may differ in, so these have a list in
    common, in proportion to their likeness (Classes). The boundary is where
    the estimated cost is least (plan_small).

    Scanning a list never makes all its pairs. Each set is first held against
    the leader of its lists that it meets most often; links make clusters. As
    long as lists with several clusters would give many pairs, other clusters
    lead them. Pairs are made only of what then is in one list and in several
    clusters, by how often they meet, so no link is lost. All links are
    verified on whole sets. Sets are of 64-bit hashes.

    A null text is an empty one; empty documents link with nothing and are
    their own component; a row without doc_id links with nothing and has a
    null component; rows that share a doc_id are one document with several
    texts; other columns are left alone.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = persisted(docs.mapInArrow(lambda it: _profile(it, k), "doc_id long, n long, s1 long, s2 long"), "jaccard-profile")
    histogram = rows.filter("n > 0").groupBy(F.least("n", F.lit(4 * SMALL_AT_MOST)).alias("n")).count()
    small = plan_small({n: count for n, count in histogram.collect()}, percent)

    by_set = rows.filter("n > 0 and doc_id is not null").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep"))
    by_set = persisted(by_set, "jaccard-representatives")
    copies = rows.filter("n > 0").join(by_set, ["s1", "s2", "n"]).filter("doc_id <> rep").select("doc_id", "s1").distinct()
    copies = persisted(copies, "jaccard-copies")
    made = docs.filter("doc_id is not null").mapInArrow(lambda it: _entries(it, k, percent, small), "doc_id long, s1 long, info long, keys array<long>")
    entries = made.join(copies, ["doc_id", "s1"], "left_anti").select(F.explode("keys").alias("key"), F.col("doc_id").alias("rep"), "info")

    of_list, part = Window.partitionBy("key"), F.col("info").bitwiseAND(3)
    leads = F.when(part.isin(_SMALLER, _SUBSET_SMALLER), F.col("rep"))
    entries = entries.withColumns({"first": F.min("rep").over(of_list), "last": F.max("rep").over(of_list), "least": F.min(leads).over(of_list), "len": F.count("*").over(of_list)})
    shared = persisted(entries.filter("first <> last and least is not null").drop("first", "last"), "jaccard-lists")
    in_subsets = part.isin(_SUBSET_SMALLER, _SUBSET_LARGER)
    light = shared.filter(in_subsets).filter("least <> rep").select(F.col("least").alias("u"), F.col("rep").alias("v")).distinct()
    size, filled = F.shiftright("info", 32), F.shiftright("info", 2).bitwiseAND((1 << 30) - 1)
    lists = shared.filter(~in_subsets).select("key", "rep", size.alias("n"), filled.alias("f"), (part == _SMALLER).alias("smaller"), "len")
    open_, edges, before = persisted(_without_long(lists, percent), "jaccard-lists-kept"), light, math.inf
    for turn in itertools.count():
        # A share of the lists is enough to try a leader: what is left out here comes up again.
        tried = open_.filter("leader <> rep").groupBy(F.col("rep").alias("v"), F.col("leader").alias("u")).agg(F.count("*").alias("common"), *(F.first(c).alias(c) for c in ("n", "f", "dropped")))
        tried = tried.filter(f"3 * common >= f - dropped - {_differ('2 * n', percent)}").groupBy("v").agg(F.max_by("u", F.struct("common", -F.col("u"))).alias("u"))
        edges = persisted(edges.union(_verified(tried, docs, k, percent, f"jaccard-{turn}")), f"jaccard-edges-{turn}")
        found = components(edges, f"jaccard-found-{turn}")
        placed = open_.drop("leader", "c").join(found, open_["rep"] == found["node"], "left").withColumn("c", F.coalesce("component", "rep")).drop("node", "component")
        leads = F.min(F.when(F.col("smaller"), F.struct(F.xxhash64("c", F.lit(turn)), "c", "rep"))).over(of_list)
        placed = placed.withColumns({"low": F.min("c").over(of_list), "high": F.max("c").over(of_list), "leads": leads}).filter("low <> high and leads is not null")
        placed = placed.withColumn("leader", F.when(F.col("leads.c") == F.col("c"), F.col("rep")).otherwise(F.col("leads.rep")))
        open_ = persisted(placed.drop("low", "high", "leads"), f"jaccard-open-{turn}")
        of_cluster = open_.groupBy("key", "c").agg(F.count("*").alias("s"))
        of_key = of_cluster.groupBy("key").agg(F.sum("s").alias("t"), F.sum(F.col("s") * F.col("s")).alias("q"))
        entries_left, pairs_left = of_key.agg(F.coalesce(F.sum("t"), F.lit(0)), F.coalesce(F.sum((F.col("t") * F.col("t") - F.col("q")) / 2), F.lit(0))).first()
        if pairs_left <= PAIRS_AN_ENTRY * entries_left or pairs_left > 0.8 * before:
            break
        before = pairs_left
    pairs = _apart_still(open_.groupBy("rep").agg(F.first("n").alias("n"), F.first("c").alias("c")), docs, k, percent)
    late = _verified(pairs, docs, k, percent, "jaccard-rest")
    found = components(found.select(F.col("node").alias("u"), F.col("component").alias("v")).union(late), "jaccard-all")

    whole = by_set.join(found, by_set["rep"] == found["node"], "left").select("s1", "s2", "n", F.coalesce("component", "rep").alias("component"))
    placed_rows = rows.join(whole, ["s1", "s2", "n"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return placed_rows.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def one_of_each(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents without those that have a smaller doc_id in their component.

    All columns stay. Rows without doc_id stay; of rows that repeat a doc_id
    all stay or none.
    """
    found = near_copies(documents, k, percent)
    copies = found.filter("component_id < doc_id").select(F.col("doc_id").alias("_copy")).distinct()
    return documents.join(copies, documents["doc_id"] == copies["_copy"], "left_anti")
