"""Personal data by weak supervision: labelers vote, EM weighs them, a classifier decides. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .storage import persisted, unused

KINDS = ("email", "ip", "card", "phone")

# Base patterns. They find what the plain ones in the comments find, in linear
# time: possessive, and not tried again inside a run that has failed.
_MAIL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:\G|(?<![{_MAIL}]))[{_MAIL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",  # [..]+@[..]+(\.[..]+)+
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",  # [0-9]+(\.[0-9]+){3}
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])",  # [0-9]([ -]?[0-9])+ of 16 to 19 digits
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
# What else may be personal data; the votes decide.
WIDER = {
    "email": rf"(?i)(?<![{_MAIL}])[{_MAIL}]{{1,64}}+\s?(?:\[at\]|\(at\))\s?[A-Za-z0-9-]{{1,63}}+(?:\s?(?:\[dot\]|\(dot\)|\.)\s?[A-Za-z0-9-]{{1,63}}+){{1,5}}+",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,14}+(?![ -]?[0-9])",
    "phone": r"(?<![0-9+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9.-])",
}
# What stands before personal data, and what it ends or begins with.
CONTEXT = {
    "email": "mail|e-mail|contact|write|reach|schreib|correo|courriel",
    "ip": "ip|host|server|address|adresse|ping|login",
    "card": "card|visa|mastercard|amex|credit|karte|carte|tarjeta|pay",
    "phone": "phone|tel|call|fax|mobile|cell|ruf|tél|llam",
}
GAZETTEER = {
    "email": r"(?i)(?:\.|dot[\])]\s?)(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu|us|ch|at)$",
    "ip": r"(?i)^(?:10\.|127\.|192\.168\.|[1-9]|fe80|fc|fd|2[0-9a-f]{3}:)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5)|35|30[0-5]|3[68])",
    "phone": r"^(?:\+(?:1|3[0-9]|4[0-9])[ (.-]|\(?[2-9][0-9]{2}[) .-])",
}
LABELERS = ("shape", "gazetteer", "context", "border", "checksum")
#: Characters before a span in which context counts.
CONTEXT_CHARS = 30
CHUNK_CHARS = 4096


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    back = F.reverse(_digits(value))
    digit = lambda i: F.substring(back, i, F.lit(1)).cast("int")
    doubled = lambda i: F.when(i % 2 == 0, 2 * digit(i) - F.when(digit(i) > 4, 9).otherwise(0)).otherwise(digit(i))
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(back), F.lit(1))), F.lit(0), lambda s, i: s + F.coalesce(doubled(i), F.lit(0))) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(256)) <= 255)
    if kind == "card":
        return _luhn(value)
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _scan(numbers: Column, joined) -> Column:
    """For each of at least one number: what joined (of two numbers, 0 at first) makes of all before it.

    Blocks of a square root of the numbers, so that long texts cost n * sqrt(n) steps.
    """
    folded = lambda a: F.aggregate(a, F.lit(0), joined)

    def by_block(s: Column) -> Column:
        a, width = s["a"], s["width"]
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / width).cast("int")), lambda k: folded(F.slice(a, k * width + 1, width)))
        until = lambda b: F.transform(F.sequence(F.lit(0), F.size(b) - 1), lambda k: folded(F.slice(b, F.lit(1), k)))
        block = lambda i: F.floor(i / width).cast("int")
        inner = lambda i: folded(F.slice(a, block(i) * width + 1, i - block(i) * width))
        return _let(_let(blocks, until), lambda o: F.transform(F.sequence(F.lit(0), F.size(a) - 1), lambda i: joined(F.get(o, block(i)), inner(i))))

    return _let(F.struct(numbers.alias("a"), F.ceil(F.sqrt(F.size(numbers))).cast("int").alias("width")), by_block)


def _spans(text: Column, pattern: str, seen: Column) -> Column:
    """Array of (start, end, value, before, after) of all matches, in code points; seen: a cheap test that must hold."""
    none = F.array().cast("array<struct<start:int,end:int,value:string,before:string,after:string>>")

    # The pieces between matches and the matches alternate, so their lengths give the places.
    def placed(s: Column) -> Column:
        values, between, until = s["values"], s["between"], s["until"]
        # A match has four characters at least, so what stands before one is in the last pieces.
        piece = lambda j, i: F.concat(F.right(F.get(between, j), F.lit(CONTEXT_CHARS)), F.when(j < i, F.get(values, j)).otherwise(""))

        def span(i: Column) -> Column:
            start = F.get(until, i) + F.length(F.get(between, i))
            pieces = F.transform(F.sequence(F.greatest(i - CONTEXT_CHARS // 4 - 1, F.lit(0)), i), lambda j: piece(j, i))
            following = F.concat(F.substring(F.get(between, i + 1), 1, 1), F.coalesce(F.get(values, i + 1), F.lit("")))
            return F.struct(
                start.alias("start"), (start + F.length(F.get(values, i))).alias("end"), F.get(values, i).alias("value"),
                F.right(F.array_join(pieces, ""), F.lit(CONTEXT_CHARS)).alias("before"), F.substring(following, 1, 1).alias("after"),
            )

        return F.transform(F.sequence(F.lit(0), F.size(values) - 1), span)

    def measured(s: Column) -> Column:
        lengths = F.transform(F.sequence(F.lit(0), F.size(s["values"]) - 1), lambda i: F.length(F.get(s["between"], i)) + F.length(F.get(s["values"], i)))
        return F.struct(s["values"].alias("values"), s["between"].alias("between"), _scan(lengths, lambda x, y: x + y).alias("until"))

    parts = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("values"), F.split(text, pattern, -1).alias("between"))
    return F.when(seen, _let(_let(parts, measured), placed)).otherwise(none)


def _vote(kind: str, s: Column) -> Column:
    """1 and 0 are votes, -1 abstains."""
    value, before = s["value"], s["before"]
    digits = F.length(_digits(value))
    yes = lambda c: F.when(c, 1).otherwise(0)
    shape = {
        "email": yes(~value.rlike(r"\.\.|^\.|\.@") & (F.length(value) <= 254)),
        "ip": yes(value.rlike(r"^(?:(?:0|[1-9][0-9]{0,2})(?:\.|$)){4}$|:")),
        "card": yes(value.rlike(r"^(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4,6}\1[0-9]{4,5}(?:\1[0-9]{4})?)$")),
        "phone": yes(digits.between(10, 13) & ~value.rlike(r"[ .-]{2}|\([^)]*$")),
    }[kind]
    letter = before.rlike(r"[\p{L}\p{N}_/=:.#-]$") | s["after"].rlike(r"^[\p{L}\p{N}_/=@]")
    checksum = {"card": yes(_luhn(value)), "ip": yes(F.when(value.contains("."), _valid("ip", value)).otherwise(F.lit(True)))}.get(kind, F.lit(-1))
    votes = {
        "shape": shape,
        "gazetteer": yes(value.rlike(GAZETTEER[kind])),
        "context": F.when(F.lower(before).rlike(rf"(?:{CONTEXT[kind]})[\p{{L}}]*\W*(?:\w+\W+){{0,2}}$"), 1).otherwise(-1),
        "border": yes(~letter),
        "checksum": checksum,
    }
    return F.struct(*(votes[name].cast("byte").alias(name) for name in LABELERS))


def _passes(kind: str):
    return lambda s: _valid(kind, s["value"])


def candidates(documents: DataFrame) -> DataFrame:
    """(doc_id, spans): all base spans and wider candidates of each text with the votes on them, without the texts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = documents.select(F.col("doc_id"), text.alias("text"))
    seen = {"email": F.col("text").contains("@"), "phone": F.col("text").contains("+")}
    for n, kind in enumerate(KINDS):
        for wide, pattern in ((False, BASE[kind]), (True, WIDER[kind])):
            hit = F.col("text").rlike(pattern)
            spans = _spans(F.col("text"), pattern, seen[kind] & hit if not wide and kind in seen else hit)
            kept = spans if wide else F.filter(spans, _passes(kind))
            voted = F.transform(kept, _described(n, kind, wide))
            docs = docs.withColumn(f"s{n}{int(wide)}", voted)
    base = F.concat(*(F.col(f"s{n}0") for n in range(len(KINDS))))
    docs = docs.withColumn("base", base)
    clear = F.filter(F.concat(*(F.col(f"s{n}1") for n in range(len(KINDS)))), lambda w: ~F.exists("base", lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])))
    return docs.select("doc_id", F.concat("base", clear).alias("spans"))


def _described(n: int, kind: str, wide: bool):
    return lambda s: F.struct(F.lit(n).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit(wide).alias("wide"), F.least((s["end"] - s["start"]) / 8, F.lit(4)).cast("int").alias("length"), _vote(kind, s).alias("votes"))


def reliabilities(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> tuple[float, list[list[float]], dict[tuple[int, ...], float]]:
    """Dawid-Skene EM over vote patterns and their counts.

    Returns the share of true spans, for each labeler its chance of a yes on a
    false and on a true span, and the posterior of each pattern. Rates are
    smoothed by pseudo-counts that say a labeler is better than chance.
    """
    size = len(patterns[0][0]) if patterns else 0
    prior, rate = 0.7, [[0.3, 0.8] for _ in range(size)]
    posterior: dict[tuple[int, ...], float] = {}
    for _ in range(rounds):
        for votes, _n in patterns:
            odds = math.log(prior / (1 - prior))
            for (no, yes), v in zip(rate, votes):
                if v >= 0:
                    odds += math.log(yes / no) if v else math.log((1 - yes) / (1 - no))
            posterior[votes] = 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))
        true = sum(n * posterior[v] for v, n in patterns)
        total = sum(n for _, n in patterns)
        prior = min(0.99, max(0.01, (true + 7) / (total + 10)))
        for i in range(size):
            for side in (0, 1):
                weight = lambda v: posterior[v] if side else 1 - posterior[v]  # noqa: E731, B023
                said = sum(n * weight(v) for v, n in patterns if v[i] == 1)
                asked = sum(n * weight(v) for v, n in patterns if v[i] >= 0)
                rate[i][side] = (said + (8 if side else 3)) / (asked + (10 if side else 10))
    return prior, rate, posterior


def _features(kind: int, wide: bool, length: int, votes: tuple[int, ...]) -> list[float]:
    return [1.0, *(float(kind == k) for k in range(len(KINDS))), float(wide), length / 4, *(float(v == 1) - float(v == 0) for v in votes)]


def train(rows: list[tuple[int, bool, int, tuple[int, ...], int]], rounds: int = 300) -> list[float]:
    """Weights of a logistic classifier of spans, learned from the posteriors of EM.

    rows: kind, wide, length, votes and how often; there are few, whatever the
    corpus, as each is a combination of small numbers.
    """
    target: list[tuple[list[float], float, float]] = []
    for kind in range(len(KINDS)):
        own = [r for r in rows if r[0] == kind]
        merged: dict[tuple[int, ...], int] = {}
        for r in own:
            merged[r[3]] = merged.get(r[3], 0) + r[4]
        _, _, posterior = reliabilities(sorted(merged.items()))
        target += [(_features(*r[:4]), posterior[r[3]], math.log1p(r[4])) for r in own]
    weights = [0.0] * len(_features(0, False, 0, (0,) * len(LABELERS)))
    total = sum(n for _, _, n in target) or 1.0
    for _ in range(rounds):
        slope = [0.01 * w for w in weights]
        for x, y, n in target:
            p = 1 / (1 + math.exp(-max(-50.0, min(50.0, sum(a * b for a, b in zip(weights, x))))))
            for i, v in enumerate(x):
                slope[i] += n / total * (p - y) * v
        weights = [w - 1.0 * s for w, s in zip(weights, slope)]
    return weights


def _score(s: Column, weights: list[float]) -> Column:
    kinds = [F.when(s["kind"] == k, F.lit(weights[1 + k])).otherwise(0.0) for k in range(len(KINDS))]
    after = weights[1 + len(KINDS) :]
    votes = [F.lit(w) * F.when(s["votes"][name] == 1, 1).when(s["votes"][name] == 0, -1).otherwise(0) for w, name in zip(after[2:], LABELERS)]
    total = F.lit(weights[0]) + F.lit(after[0]) * s["wide"].cast("int") + F.lit(after[1]) * s["length"] / 4
    for c in [*kinds, *votes]:
        total = total + c
    return 1 / (1 + F.exp(-total))


def personal_data(documents: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(doc_id, base, spans) for every row of documents (doc_id, text): arrays of (kind, start, end).

    Base spans are those of the base patterns that pass their checks (leftmost,
    not overlapping within a kind; code points; end exclusive); they always
    count. Wider patterns give more candidates, and labelers (shape,
    gazetteer, context, border, checksum) vote on all of them or abstain. EM
    estimates from all votes of the corpus how reliable each labeler is for
    each kind, and its posteriors train a logistic classifier of spans. A wider
    candidate that overlaps no base span is added where the classifier gives
    at least `threshold`. Arrays are ordered by kind (email, ip, card, phone),
    then start.

    A null text is an empty one, with no spans; an id may be null or repeated,
    each row has its own spans; other columns are left alone; no documents give
    no rows. Texts don't leave the first pass: what is written between holds
    places and votes only.
    """
    found = persisted(candidates(documents), "pii-candidates")
    each = found.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.wide", "s.length", *(F.col(f"s.votes.{n}").alias(n) for n in LABELERS)).count()
    weights = train(sorted((r[0], r[1], r[2], tuple(r[3:-1]), r[-1]) for r in each.collect()))
    base = F.filter("spans", lambda s: ~s["wide"])
    kept = F.filter("spans", lambda s: ~s["wide"] | (_score(s, weights) >= threshold))
    bare = lambda a: F.array_sort(F.transform(a, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))
    return found.select("doc_id", bare(base).alias("base"), bare(kept).alias("spans"))


def printed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    name = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(documents: DataFrame, threshold: float = 0.9) -> DataFrame:
    """documents with [EMAIL], [IP], [CARD] or [PHONE] in place of each span; n_chars, where there is one, follows.

    Of spans that overlap, the leftmost (then the longest) names the gap that
    all of them leave. All columns and rows stay, whatever their names; equal
    texts become equal ones; a null text stays null.
    """
    # The same text has the same spans, so they go back by a hash of it.
    digest, hashed, held = unused(documents, "_digest", "_hash", "_spans")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = documents.withColumn(digest, F.sha2(text.cast("binary"), 256))
    some = keyed.select(F.col(digest).alias("doc_id"), "text").filter(F.col("text").rlike("[0-9]|@|(?i)[\\[(]at[\\])]"))
    found = personal_data(some, threshold).filter(F.size("spans") > 0).groupBy(F.col("doc_id").alias(hashed)).agg(F.first("spans").alias(held))
    joined = keyed.join(found, keyed[digest] == found[hashed], "left")
    order = F.array_sort(F.transform(held, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("end"), s["kind"].alias("kind"))))
    label = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    chunks = F.transform(F.sequence(F.lit(0), F.floor(F.length("text") / CHUNK_CHARS).cast("int")), lambda c: F.substring("text", c * CHUNK_CHARS + 1, F.lit(2 * CHUNK_CHARS)))

    def cut(s: Column) -> Column:
        spans, until, chunks = s["spans"], s["until"], s["chunks"]
        # A substring is looked for from the start of a string, so short ones are taken from chunks.
        near = lambda at, size: F.substring(F.get(chunks, F.floor(at / CHUNK_CHARS).cast("int")), at % CHUNK_CHARS + 1, size)
        piece = lambda at, size: F.when(size <= CHUNK_CHARS, near(at, size)).otherwise(F.substring("text", at + 1, size))

        def gap(i: Column) -> Column:
            span, at = F.get(spans, i), F.get(until, i)
            return F.when(span["start"] < at, "").otherwise(F.concat(piece(at, span["start"] - at), F.get(label, span["kind"])))

        last = F.array_max(F.transform(spans, lambda x: -x["end"]))
        return F.concat(F.array_join(F.transform(F.sequence(F.lit(0), F.size(spans) - 1), gap), ""), F.substring("text", last + 1, F.length("text")))

    until = _let(order, lambda o: F.struct(o.alias("spans"), _scan(F.transform(o, lambda x: -x["end"]), lambda x, y: F.greatest(x, y)).alias("until"), chunks.alias("chunks")))
    cut = _let(until, cut)
    out = joined.withColumn("text", F.when(F.col(held).isNull(), F.col("text")).otherwise(cut))
    if "n_chars" in documents.columns:
        kind = documents.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col(held).isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind))
    return out.select(documents.columns)
