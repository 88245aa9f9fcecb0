"""Quality, personal data, language model, fingerprints, tokens, pages and the mix."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from aeonframe.llm import html_text as H, mixing as M, pii as P, quality as Q, suffix_tree_lm as L, token_counts as T, winnowing as W
from tests.llm import cases

TOKENIZERS = pytest.importorskip("public_tokenizers")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


# Quality


def labelled(spark):
    good = [(i, "\n".join(" ".join(cases.passage(i * 9 + j, 12)).capitalize() + "." for j in range(4)), 1) for i in range(60)]
    bad = [(100 + i, "\n".join(" ".join(w.upper() + "!!" for w in cases.passage(i * 7 + j, 5)) for j in range(6)), 0) for i in range(60)]
    rows = [(i, t, None, None, len(t), *[None] * 9) for i, t, _ in good + bad]
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in good + bad] + [(None, 1, 0), (3, None, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    return cases.documents(spark, rows), labels, {i: q for i, _, q in good + bad}


def test_quality_on_rows_not_learned_from(spark):
    docs, labels, truth = labelled(spark)
    field = Q.train(docs, labels.filter(~Q.held_out()))
    scores = Q.quality_scores(docs, field).withColumn("held_out", Q.held_out()).collect()
    held = [r for r in scores if r.held_out]
    assert len(held) > 10 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in scores)
    assert all(r.predicted == truth[r.doc_id] == (r.score >= 0.7) for r in held)
    kept = Q.without_bad(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, q in truth.items() if q}
    odd = Q.quality_scores(cases.documents(spark), field).collect()
    assert len(odd) == len(cases.rows()) and all(0 <= r.score <= 1 for r in odd)


def test_quality_without_labels(spark):
    docs, labels, _ = labelled(spark)
    field = Q.train(docs, labels.limit(0))
    assert all(abs(r.score - 0.5) < 1e-9 for r in Q.quality_scores(docs, field).collect())
    assert Q.quality_scores(cases.documents(spark, []), field).count() == 0


def test_forward_backward_is_enumeration():
    r = np.random.default_rng(0)
    first = np.array([0, 3, 4, 8])
    score = r.normal(size=8)
    field = Q.Field(np.zeros(1), 0.7, -0.3, 0.4)
    good, gg, bb, z = field.marginals(score, first)
    for a, b, zz in zip(first[:-1], first[1:], z):
        weight = {}
        for labels in np.ndindex(*[2] * (b - a)):
            s = sum(score[a + i] for i, y in enumerate(labels) if y) + 0.4 * labels[0]
            s += sum(0.7 if x and y else -0.3 if not x and not y else 0 for x, y in zip(labels, labels[1:]))
            weight[labels] = math.exp(s)
        total = sum(weight.values())
        assert abs(math.log(total) - zz) < 1e-9
        for i in range(b - a):
            assert abs(sum(w for y, w in weight.items() if y[i]) / total - good[a + i]) < 1e-9
            if i:
                assert abs(sum(w for y, w in weight.items() if y[i] and y[i - 1]) / total - gg[a + i]) < 1e-9
                assert abs(sum(w for y, w in weight.items() if not y[i] and not y[i - 1]) / total - bb[a + i]) < 1e-9


# Personal data

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(s):
    total = 0
    for i, c in enumerate(reversed(s)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_by_force(text):
    out = []
    for n, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if good:
                out.append((n, *m.span()))
    return out


ODD = [
    "a@b.c_d@e.f x@y@z.com a@@b.c a@b..c .@a.b.", "1.2.3.4.5.6.7.8 999.1.2.3.4 256.1.1.1 0001.02.003.4 1.2.3 " + "9" * 3000 + ".1.1.1", "4111111111111111 4111-1111-1111-1111 4111 1111 1111 1112 41111111111111111111 1 2 3",
    "+1 (555) 123-4567 +12 +1.2.3.4.5.6.7.8.9 ++49 30 123456 x+1-2", "日本 bob@例.com bob@mail.example.com é 10.0.0.1", "@" * 500 + "." * 500 + "a" * 3000, "tel +49 (30) 1234567, 4111 1111 1111 1111+1 555 1234567", "a.b@c.d" * 200,
]


def test_base_spans_are_the_plain_patterns(spark):
    rows = [*cases.rows(), *[(1000 + i, t, *[None] * 12) for i, t in enumerate(ODD)]]
    found = P.personal_data(cases.documents(spark, rows)).collect()
    assert len(found) == len(rows)
    wanted = sorted(repr((r[0], base_by_force(r[1]))) for r in rows)
    assert sorted(repr((r.doc_id, [tuple(s) for s in r.base])) for r in found) == wanted
    assert all({tuple(s) for s in r.base} <= {tuple(s) for s in r.spans} for r in found)


def test_wider_spans_need_votes(spark):
    base = [(i, f"write to ann{i}@mail.example.com or call +1 (212) 555-01{i:02d} now", *[None] * 12) for i in range(40)]
    extra = [(100, "contact phone: (212) 555-0199 today", *[None] * 12), (101, "please mail bob.lee [at] mail [dot] example [dot] com", *[None] * 12), (102, "version 1-234-567 and 12:30", *[None] * 12)]
    found = by_id(P.personal_data(cases.documents(spark, base + extra)))
    text = dict((r[0], r[1]) for r in extra)
    kinds = {i: [(P.KINDS[s.kind], text[i][s.start : s.end]) for s in found[i].spans] for i in text}
    assert kinds[100] == [("phone", "(212) 555-0199")]
    assert kinds[102] == []
    assert all(len(found[i].spans) == 2 for i in range(40))


def test_redaction(spark):
    docs = cases.documents(spark)
    out = P.redacted(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    row = by_id(out)[21]
    assert row.text == "mail [EMAIL] or [IP], card [CARD], call [PHONE]." and row.n_chars == len(row.text)
    assert by_id(out)[0].text == cases.texts()[0]
    assert P.personal_data(cases.documents(spark, [])).count() == 0


def test_reliabilities_find_the_bad_labeler():
    r = np.random.default_rng(4)
    patterns = Counter()
    for _ in range(3000):
        y = r.random() < 0.6
        patterns[tuple(int(v) for v in (y if r.random() < 0.95 else not y, y if r.random() < 0.9 else not y, r.random() < 0.5))] += 1
    _, rate, posterior = P.reliabilities(sorted(patterns.items()))
    assert rate[0][1] - rate[0][0] > 0.7 and abs(rate[2][1] - rate[2][0]) < 0.2
    assert posterior[(1, 1, 0)] > 0.9 > 0.1 > posterior[(0, 0, 1)]


# Language model


def test_language_model_base_and_counts(spark):
    rows = cases.rows()
    found = L.scored_texts(cases.documents(spark)).collect()
    assert len(found) == len(rows)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    counts = Counter()
    for r in rows:
        if not held(r[0]):
            counts.update([*cases.words(r[1], lower=True), None])
    total, kinds = sum(counts.values()), len(counts)
    wanted = []
    for r in rows:
        tokens = [*cases.words(r[1], lower=True), None]
        wanted.append((repr(r[0]), held(r[0]), len(tokens), sum(counts[t] > 0 for t in tokens), total, round(sum(math.log10((counts[t] + 0.1) / (total + 0.1 * (kinds + 1))) for t in tokens), 6)))
    assert sorted((repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found) == sorted(wanted)
    assert all(r.score <= 0 and math.isfinite(r.score) for r in found)


def test_language_model_learns_contexts(spark):
    rows = [(i, " ".join(["red", "green", "blue"] * 20 + cases.passage(i, 10)), *[None] * 12) for i in range(80)]
    found = [r for r in L.scored_texts(cases.documents(spark, rows)).collect() if r.held_out]
    assert found and all(r.score > r.base_score + 10 for r in found)


def test_language_model_tells_rare_words_apart(spark):
    held = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    learned = [i for i in range(held + 1, held + 100) if zlib.crc32(str(i).encode()) % 10][:50]
    rows = [(i, " ".join(f"{i}w{j}" for j in range(1200)) + (" quill ember sprocket lantern" * (k < 3)), *[None] * 12) for k, i in enumerate(learned)]
    found = L.scored_texts(cases.documents(spark, [*rows, (held, "quill ember sprocket lantern", *[None] * 12)])).collect()
    # Three of 60,000 tokens a word: after each, the next one is all but certain.
    score = next(r for r in found if r.doc_id == held)
    assert score.train_tokens > 60_000 and score.score > score.base_score + 10


def tree_by_force(rows, held):
    """Scores by a plain suffix tree of dictionaries."""
    texts = [(held(r[0]), cases.words(r[1], lower=True)) for r in rows]
    counts = Counter(w for h, t in texts if not h for w in t)
    ends = sum(not h for h, _ in texts)
    norm = sum(counts.values()) + ends + 0.1 * (len(counts) + (ends > 0) + 1)
    often = {w for w, c in counts.items() if c >= L.LEAST}
    other = norm - sum(counts[w] + 0.1 for w in often) - (ends + 0.1)
    # Symbols: words, 0 for those not told apart, None for the end.
    root = lambda s: max((ends + 0.1 if s is None else other if s == 0 else counts[s] + 0.1) / norm, 1e-300)
    named = [(h, ["^start", *(w if w in often else 0 for w in t), None]) for h, t in texts]
    after = {}
    for h, s in named:
        for i in range(1, len(s)) if not h else ():
            for depth in range(1, min(i, L.DEPTH) + 1):
                after.setdefault(tuple(s[i - depth : i]), Counter())[s[i]] += 1
    share = lambda c, s: after[c][s] / sum(after[c].values()) if c else root(s)
    tree = {}
    for c, n in after.items():
        gain = sum(k * math.log(share(c, s) / share(c[1:], s)) for s, k in n.items())
        if sum(n.values()) >= L.LEAST and gain >= 0.5 * len(n) * math.log(sum(n.values())):
            tree[c] = n
    out = []
    for (_, words), (_, s) in zip(texts, named):
        score = 0.0
        for i in range(1, len(s)):
            p = root(s[i])
            for depth in range(1, min(i, L.DEPTH) + 1):
                if n := tree.get(tuple(s[i - depth : i])):
                    p = (n[s[i]] + len(n) * p) / (sum(n.values()) + len(n))
            score += math.log10(p) + (math.log10((counts[words[i - 1]] + 0.1) / max(other, 0.1)) if s[i] == 0 else 0)
        out.append(score)
    return out


@pytest.mark.parametrize("part_tokens", [1 << 40, 400, 25])
def test_language_model_is_the_plain_suffix_tree(spark, part_tokens):
    """At any number of parts, also where words and pairs of words are dealt over several."""
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    r = np.random.default_rng(6)
    made = [" ".join(["of the", "a", "of the cat", "dog ran", "ran of", f"w{i % 11}"][j] for j in r.integers(0, 6, 40)) for i in range(60)]
    rows = [*cases.rows(), *[(500 + i, t, *[None] * 12) for i, t in enumerate(made)]]
    found = L.scored_texts(cases.documents(spark, rows), part_tokens).collect()
    wanted = sorted((repr(row[0]), s) for row, s in zip(rows, tree_by_force(rows, held)))
    got = sorted((repr(row.doc_id), row.score) for row in found)
    assert [a[0] for a in got] == [a[0] for a in wanted]
    assert all(abs(a[1] - b[1]) <= 1e-5 * max(1, abs(b[1])) for a, b in zip(got, wanted))


def test_chances_sum_to_one():
    r = np.random.default_rng(1)
    symbols = np.array([L._OTHER, L._END, 4, 5, 6])
    learned = [np.where(r.random(400) < 0.3, 4, r.choice(symbols, 400)) for _ in range(4)]
    totals = L.Totals(150, 20, 10, 100.3)
    count = lambda s: np.select([s == 4, s == 5, s == 6], [50, 30, 20])
    assert abs(totals.root(symbols, count(symbols)).sum() - 1) < 1e-9
    for before in ([L._START, L._NONE, L._NONE], [4, L._START, L._NONE], [4, 4, 5], [L._OTHER] * 3):
        columns = [np.append(a, b) for a, b in zip(learned, [symbols, *(np.full(5, b) for b in before)])]
        weight = np.append(np.ones(400), np.zeros(5))
        p = L.chances(columns[0], columns[1:], totals.root(columns[0], count(columns[0])), [weight] * 3)
        assert abs(p[-5:].sum() - 1) < 1e-6


def test_language_model_of_nothing(spark):
    assert L.scored_texts(cases.documents(spark, [])).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    only = L.scored_texts(cases.documents(spark, [(held, "never learned", *[None] * 12)])).collect()[0]
    assert (only.n_tokens, only.n_known, only.train_tokens) == (3, 0, 0)


# Fingerprints


def test_fingerprints(spark):
    rows = [r for r in cases.rows() if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values())
    found = by_id(W.fingerprinted(cases.documents(spark, rows)))
    text = {r[0]: r[1] or "" for r in rows}
    ids = sorted(text, reverse=True)
    for i, nxt in zip(ids, ids[1:] + ids[:1]):
        half = len(text[i]) // 2
        edited = text[i][: len(text[i]) - half] + text[nxt][:half]
        assert found[i].n_chars == len(text[i])
        assert found[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= found[i].near_edited <= 1 and 0 <= found[i].near_next <= 1
    assert found[0].fingerprint == found[2].fingerprint and found[9].fingerprint == found[10].fingerprint
    assert found[6].fingerprint == found[7].fingerprint == found[8].fingerprint == ""
    assert found[1].near_next > 0.9 and found[5].near_next < 0.3


def test_winnowing_keeps_the_rightmost_least_of_each_window(spark):
    rows = [(i, t) for i, t in enumerate(cases.texts())]
    k, window = 4, 16
    df = spark.createDataFrame(rows, "doc_id long, text string")
    hashes = df.select("doc_id", F.transform(F.filter(F.split(F.coalesce("text", F.lit("")), W.SPACES), lambda w: w != ""), lambda w: F.xxhash64(w)).alias("h"))
    words = {r.doc_id: [x & (2**64 - 1) for x in r.h] for r in hashes.collect()}
    found = {r.doc_id: r.own for r in W.fingerprints(df, "text", "own", k, window).collect()}
    turn = lambda x, n: (x << n | x >> (64 - n)) & (2**64 - 1)
    for i, w in words.items():
        size = 1
        while size < k:
            if len(w) <= size:
                break
            w = [turn(a, size) ^ b for a, b in zip(w, w[size:])]
            size *= 2
        runs = [x >> 25 for x in w]
        if len(words[i]) < k or len(runs) < window:
            continue
        wanted = []
        for a in range(len(runs) - window + 1):
            least = min(runs[a : a + window])
            at = max(j for j in range(a, a + window) if runs[j] == least)
            if (least, at) not in wanted:
                wanted.append((least, at))
        assert [(x >> 24, (2**24 - 1) - (x & (2**24 - 1))) for x in found[i]] == wanted


def test_shared_runs_share_a_hash(spark):
    shared = cases.passage(70, 19)
    rows = [(i, " ".join(cases.passage(80 + i, 40) + shared + cases.passage(90 + i, 40))) for i in range(12)]
    df = W.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), "text", "own")
    sets = [set(r.h) for r in df.select(W.hashes_of(F.col("own")).alias("h")).collect()]
    assert set.intersection(*sets)


def test_next_of_all(spark):
    for ids in ([], [7], [3, 9, 1, 4, 100, 50, 51]):
        rows = [(i, f"t{i}") for i in ids]
        found = {r.doc_id: r.next.text for r in W.with_next(spark.createDataFrame(rows, "doc_id long, text string"), ["text"]).collect()}
        down = sorted(ids, reverse=True)
        assert found == {i: f"t{n}" for i, n in zip(down, down[1:] + down[:1])}


def test_next_of_far_null_and_repeated_ids(spark):
    rows = [(i, f"t{i}") for i in range(500)] + [(10**17, "far"), (7, "a"), (7, "b"), (None, "n2"), (None, "n1")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = sorted((r.doc_id is None, -(r.doc_id or 0), r.text, r.next.text) for r in W.with_next(df, ["text"]).collect())
    texts = [f[2] for f in found]
    assert [f[3] for f in found] == texts[1:] + texts[:1] and texts[0] == "far" and texts[-2:] == ["n1", "n2"]


def test_fingerprints_of_odd_rows(spark):
    rows = cases.rows()
    assert W.fingerprinted(cases.documents(spark, rows)).count() == len(rows)
    assert W.fingerprinted(cases.documents(spark, [])).count() == 0


# Mixing


def test_mix_meets_targets(spark):
    rows = [(i, " ".join(cases.passage(i, 5 + i % 40)), None, [None, "a", "b", "c"][min(i % 7, 3)], None, *[None] * 9) for i in range(700)]
    docs = cases.documents(spark, rows)
    found = M.mixed(docs).collect()
    assert len(found) == 700 and [(r.doc_id, r.taken) for r in sorted(found)] == [(r.doc_id, r.taken) for r in sorted(M.mixed(docs.repartition(5)).collect())]
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(cases.words(r[1]))
    weights = dict(zip(["a", "b", "c", None], [1, 2, 3, 1]))
    targets, free, left = {}, dict(weights), sum(sizes.values())
    while free:
        level = left / sum(free.values())
        over = [s for s, w in free.items() if level * w > 3 * sizes[s] + 1e-9]
        if not over:
            targets |= {s: level * w for s, w in free.items()}
            break
        for s in over:
            targets[s] = 3 * sizes[s]
            left -= targets[s]
            del free[s]
    for s in sizes:
        own = [r for r in found if r.source == s]
        assert all(r.source_size == sizes[s] and abs(r.target - targets[s]) < 1e-6 and r.taken <= 3 * int(r.size) for r in own)
        assert abs(sum(r.taken for r in own) - targets[s]) <= 45
        assert all(r.copies in (int(targets[s] / sizes[s]), int(targets[s] / sizes[s]) + 1) for r in own)


def test_mix_of_odd_rows(spark):
    found = M.mixed(cases.documents(spark)).collect()
    assert len(found) == len(cases.rows())
    assert all(r.size == len(cases.words(t)) for r in found for t in [r.text])
    assert M.mixed(cases.documents(spark, [])).count() == 0
    blank = M.mixed(cases.documents(spark, [(1, None, None, "a", None, *[None] * 9)])).collect()[0]
    assert (blank.size, blank.taken) == (0, 0)


# Tokens


def test_token_counts_are_the_library(spark):
    import sentencepiece

    path = TOKENIZERS.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    found = T.token_counts(cases.documents(spark), path).collect()
    wanted = sorted(repr((r[0], len((r[1] or "").encode()), len(library.encode(r[1] or "")))) for r in cases.rows())
    assert sorted(repr((r.doc_id, r.n_bytes, r.n_tokens)) for r in found) == wanted
    assert all(r.over_limit == (r.n_tokens > 4096) for r in found) and any(r.over_limit for r in found)
    table = T.MergeTable.of_sentencepiece(path)
    r = np.random.default_rng(3)
    alphabet = list("ab the▁ \t\n é漢\U0001f600<s>0xAAaa  ing…")
    texts = ["".join(r.choice(alphabet, n)) for n in r.integers(0, 80, 400)] + [" " * n for n in range(40)] + ["a" * n for n in range(40)]
    assert T.Counter(table).count(pa.array(texts)).tolist() == [len(x) for x in library.encode(texts)]
    assert T.token_counts(cases.documents(spark, []), path).count() == 0


# Pages

PAGE = """<!DOCTYPE html><html><head><title>x</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body class="with-sidebar">
<header><h1>Site</h1><a href=/>Home</a></header><div class="cookie-notice">We use cookies, all the time.</div><nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav>
<main><article><header class="entry-header"><h1>Title &amp; more</h1></header><p>First   para with <a href=x>a link</a> and
text, long enough.<p>Second &eacute; para &#8212; ok.</p><!-- <p>hidden</p> --><ul><li>item one</li><li>item two</li></ul><div class="ad">Buy now!</div><p>Last<br>para.</p></article>
<aside class="sidebar"><p>Some other story that is quite long and has commas, and full stops.</p></aside><section id="comments"><h2>Comments</h2><p>Great article, thanks!</p></section>
<form><label>Name</label><input></form></main><footer>&copy; 2020</footer></body></html>"""


def test_main_text(spark):
    pages = [(1, "u", PAGE), (2, None, None), (3, "v", ""), (4, "w", "<p>only</p"), (5, "z", PAGE[: PAGE.index("Last")]), (6, "y", "no tags & all text, quite plain"), (7, "x", "<div><div><div>" * 200 + "deep, deep text."), (7, "x", "<nav>menu</nav>")]
    found = H.main_texts(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    text = {(r.page_id, r.url): r for r in found}
    wanted = "Title & more\nFirst para with a link and text, long enough.\nSecond é para — ok.\nitem one\nitem two\nLast para."
    assert text[1, "u"].text == wanted and text[1, "u"].n_chars == len(wanted)
    assert text[5, "z"].text == wanted.removesuffix("\nLast para.")
    assert text[2, None].text == text[3, "v"].text == "" and len(found) == len(pages)
    assert text[6, "y"].text == "no tags & all text, quite plain"


def test_minimum_cut():
    from itertools import product

    r = np.random.default_rng(0)
    for _ in range(200):
        n = int(r.integers(1, 7))
        cost = r.integers(-4, 5, n).astype(float)
        edges = [(i, j, float(r.integers(0, 4))) for i in range(n) for j in range(i) if r.random() < 0.5]
        value = lambda side: sum(abs(c) for c, s in zip(cost, side) if (c > 0) != bool(s) and c) + sum(w for a, b, w in edges if side[a] != side[b])  # noqa: E731, B023
        assert abs(value(H.min_cut(cost, edges)) - min(value(s) for s in product([0, 1], repeat=n))) < 1e-6


CLASHES = ("last", "first", "certain", "inclusion", "_source", "_cut", "_spans", "_hash", "_digest", "target", "c", "n", "key", "bin")


def test_extra_columns_may_have_any_name(spark):
    docs = cases.documents(spark).select("doc_id", "text", "source", "n_chars")
    wide = docs.select("*", *(F.lit("mine").alias(c) for c in CLASHES))
    of = lambda df, *names: sorted(map(tuple, df.select(*names).collect()), key=repr)
    mixed_rows = of(M.mixed(docs), "doc_id", "taken", "copies")
    assert of(M.mixed(wide), "doc_id", "taken", "copies") == mixed_rows
    out = P.redacted(wide)
    assert out.columns == wide.columns and of(out, "doc_id", "text") == of(P.redacted(docs), "doc_id", "text")
    assert {tuple(r) for r in out.select(*CLASHES).collect()} == {("mine",) * len(CLASHES)}


def test_held_out_is_never_null(spark):
    ids = spark.createDataFrame([(None,), (1,), (2,)], "doc_id long")
    assert {r[0] for r in ids.select(Q.held_out()).collect()} <= {True, False}


def test_spans_of_a_long_text(spark):
    text = "bob.smith@mail.co " * 8000 + "last +1 (555) 123-4567"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = P.personal_data(docs).first()
    assert [tuple(s) for s in found.base[:2]] == [(0, 0, 17), (0, 18, 35)] and len(found.base) == 8001
    assert tuple(found.base[-1]) == (3, len(text) - 17, len(text))
    assert P.redacted(docs).first().text == "[EMAIL] " * 8000 + "last [PHONE]"
