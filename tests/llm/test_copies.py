"""Jaccard join, repeated passages and decontamination against brute force."""

import hashlib
import random

import numpy as np

from aeonframe.llm import components as C, decontamination as D, jaccard_join as J, repeats as R
from tests.llm import cases


def jaccard_by_force(rows, k=5, percent=80):
    sets = {}
    for row in rows:
        if row[0] is not None:
            w = cases.words(row[1], lower=True)
            s = frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
            sets.setdefault(row[0], []).append(s)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, x in enumerate(ids):
        for y in ids[:n]:
            if any(a and b and 100 * len(a & b) >= percent * len(a | b) for a in sets[x] for b in sets[y]):
                p, q = root(x), root(y)
                parent[max(p, q)] = min(p, q)
    return {(i, len(s), root(i)) for i in ids for s in sets[i]}


def test_jaccard_join_is_brute_force(spark):
    found = [tuple(r) for r in J.near_copies(cases.documents(spark)).collect()]
    assert len(found) == len(cases.rows())
    assert {r for r in found if r[0] is not None} == jaccard_by_force(cases.rows())
    assert [r[2] for r in found if r[0] is None] == [None]


def test_jaccard_join_of_many_near_copies(spark):
    r = random.Random(5)
    rows = []
    for i in range(160):
        base = cases.passage(i % 7, (i % 7 + 1) * 5 + 4)
        edited = [w if r.random() > 0.02 else "edit" + str(r.randint(0, 3)) for w in base]
        rows.append((i, " ".join(edited), *[None] * 12))
    found = {tuple(x) for x in J.near_copies(cases.documents(spark, rows)).collect()}
    assert found == jaccard_by_force(rows)


def test_long_lists_of_a_large_cluster(spark, monkeypatch):
    monkeypatch.setattr(J, "LONG", 2)
    r = random.Random(6)
    base = cases.passage(9, 90)
    rows = [(i, " ".join(w if r.random() > 0.015 else f"e{r.randint(0, 9)}" for w in base), *[None] * 12) for i in range(60)]
    assert {tuple(x) for x in J.near_copies(cases.documents(spark, rows)).collect()} == jaccard_by_force(rows)


def test_similar_sets_meet_in_a_range():
    r = np.random.default_rng(3)
    for percent in (50, 80, 95, 100):
        classes = J.Classes(percent)
        for n in (1, 2, 5, 9, 17, 40, 133, 700):
            whole = np.unique(r.integers(0, 1 << 63, 2 * n).astype(np.uint64))
            x = np.sort(whole[:n])
            m = int(r.integers(n, n * 100 // percent + 1))
            common = max(J.least_overlap(n, m, percent), n + m - len(whole))
            y = np.sort(np.concatenate([r.permutation(x)[:common], whole[n : n + m - common]]))
            h, bounds, row = np.concatenate([x, y]), np.array([0, n, n + m]), np.repeat([0, 1], [n, m])
            keys, at, _ = classes.keys(h, bounds, row, False)
            others, to, _ = classes.keys(h, bounds, row, True)
            mine = set(keys[at[0] : at[1]])
            assert mine & (set(keys[at[1] : at[2]]) | set(others[to[1] : to[2]])), (percent, n, m)


def test_sets_of_few_words_and_chains(spark):
    r = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[i * 3 : i * 3 + 60]), *[None] * 12) for i in range(40)]
    rows += [(100 + i, " ".join(r.choice("abc") for _ in range(r.randint(3, 80))), *[None] * 12) for i in range(80)]
    rows += [(300 + i, " ".join(words[: 100 + 12 * i]), *[None] * 12) for i in range(20)]
    assert {tuple(x) for x in J.near_copies(cases.documents(spark, rows)).collect()} == jaccard_by_force(rows)


def test_jaccard_join_of_nothing(spark):
    assert J.near_copies(cases.documents(spark, [])).count() == 0
    assert J.near_copies(cases.documents(spark, [(1, None, *[None] * 12)])).collect()[0].component_id == 1


def test_one_of_each_keeps_columns(spark):
    docs = cases.documents(spark)
    kept = J.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert ids == {c for _, _, c in jaccard_by_force(cases.rows())} | {None}


def test_boundary_follows_cost():
    assert J.plan_small({2: 100}, 80) >= 2
    assert J.plan_small({500: 100}, 80) == J.plan_small({500: 1}, 80)
    assert J.plan_small({}, 80) == 0


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 9), (9, 9), (7, 8), (8, 7), (None, 1)]
    found = dict(tuple(r) for r in C.components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert found == {5: 3, 4: 3, 3: 3, 9: 3, 7: 7, 8: 7}
    chain = [(i, i + 1) for i in range(50)]
    assert {r[1] for r in C.components(spark.createDataFrame(chain, "u long, v long")).collect()} == {0}


def repeats_by_force(rows, window=50):
    first = {}
    for row in rows:
        if row[0] is not None:
            w = cases.words(row[1])
            for i in range(len(w) - window + 1):
                key = tuple(w[i : i + window])
                first[key] = min(first.get(key, row[0]), row[0])
    out = []
    for row in rows:
        w = cases.words(row[1])
        gone = [False] * len(w)
        for i in range(len(w) - window + 1) if row[0] is not None else ():
            if first[tuple(w[i : i + window])] < row[0]:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((row[0], len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


def order(rows):
    return sorted(map(tuple, rows), key=repr)


def test_repeats_are_brute_force(spark):
    assert order(R.without_repeats(cases.documents(spark)).collect()) == order(repeats_by_force(cases.rows()))
    assert any(r[2] for r in repeats_by_force(cases.rows()))


def test_repeats_of_short_windows(spark):
    r = random.Random(8)
    pool = [cases.passage(i, 40) for i in range(6)]
    rows = [(i, " ".join(sum((r.choice(pool)[: r.randint(5, 40)] for _ in range(3)), cases.passage(100 + i, 9))), *[None] * 12) for i in range(40)]
    found = R.without_repeats(cases.documents(spark, rows), window=12, k=4).collect()
    assert order(found) == order(repeats_by_force(rows, 12))


def test_repeats_of_nothing(spark):
    assert R.without_repeats(cases.documents(spark, [])).count() == 0


def distance_by_force(item, words):
    """Least edit distance of the item to any run of words."""
    before = [0] * (len(words) + 1)
    for i, x in enumerate(item, 1):
        now = [i]
        for j, y in enumerate(words, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
        before = now
    return min(before)


def test_myers_is_the_table():
    r = random.Random(1)
    for _ in range(300):
        item = [r.choice("abc") for _ in range(r.randint(1, 9))]
        text = [r.choice("abcd") for _ in range(r.randint(1, 20))]
        assert min(D.myers(item, text)) == min(distance_by_force(item, text), len(item)) or distance_by_force(item, text) == len(item)


def test_contaminated_is_brute_force(spark):
    r = random.Random(3)
    items = [(i, " ".join(cases.passage(50 + i, 12 + 5 * i))) for i in range(8)] + [(90, None), (91, ""), (92, "too short"), (None, "no id at all in this row")]
    rows = []
    for i in range(60):
        own = items[i % 8][1].split()
        edited = [w if r.random() > 0.1 * (i % 4) else "x" + w for w in own]
        if i % 5 == 0:
            del edited[len(edited) // 2]
        body = cases.passage(200 + i, 30) + edited + cases.passage(300 + i, 30)
        rows.append((i, ", ".join(body).upper() if i % 3 else " ".join(body), *[None] * 12))
    rows += cases.rows()[6:9]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = {(x.doc_id, x.item_id, x.distance) for x in D.contaminated(cases.documents(spark, rows), benchmark).collect()}
    wanted = set()
    for row in rows:
        words = D.words_of(row[1] or "")[0]
        for item_id, text in items[:8]:
            item = D.words_of(text)[0]
            d = distance_by_force(item, words)
            if d <= int(0.2 * len(item)):
                wanted.add((row[0], item_id, d))
    assert found == wanted and len(wanted) > 20


def test_span_of_a_match(spark):
    item = " ".join(cases.passage(77, 15))
    doc = "Ünïcode İ start: " + item.replace(" ", ",  ") + ". End"
    found = D.contaminated(spark.createDataFrame([(1, doc)], "doc_id long, text string"), spark.createDataFrame([(5, item)], "item_id long, text string")).collect()
    assert [(r.distance, doc[r.start : r.end]) for r in found] == [(0, item.replace(" ", ",  "))]


def test_nothing_to_find(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = cases.documents(spark)
    assert D.contaminated(docs, none).count() == 0
    assert D.without_contaminated(docs, none).count() == docs.count()


def test_items_and_documents_of_any_id(spark):
    item = " ".join(cases.passage(60, 20))
    docs = [(1, f"before {item} after"), (2, "none of it"), (None, f"no id {item}"), (3, "yes indeed"), (4, None)]
    for kind in ("smallint", "string", "decimal(9,0)"):
        df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr(f"cast(doc_id as {kind}) as doc_id", "text", "1 as other")
        tests = spark.createDataFrame([(7, item), (8, "yes"), (9, "")], "item_id long, text string")
        assert {(int(r.doc_id), r.item_id) for r in D.contaminated(df, tests).collect()} == {(1, 7), (3, 8)}
        kept = D.without_contaminated(df, tests)
        assert kept.columns == df.columns and sorted(int(r.doc_id) for r in kept.collect()) == [2, 4]
