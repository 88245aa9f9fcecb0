"""Documents with nulls, empty and long texts, ties, repeated rows, and columns whose names clash with inner ones."""

import random
import re

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, n int, score double, size string, spans string, block string, t string, p int, bin string"


def passage(seed, n):
    r = random.Random(seed)
    return [r.choice("the of and to in a is that for it was on be as with".split()) if r.random() < 0.4 else "".join(r.choice(["th", "er", "an", "in", "on", "re", "ent", "ti"]) for _ in range(r.randint(1, 4))) for _ in range(n)]


def texts():
    a, b = passage(1, 300), passage(2, 120)
    near = a[:150] + ["changed"] + a[151:]
    apart = a[:100] + passage(3, 200)
    return [
        " ".join(a), " ".join(near), " ".join(a), " ".join(apart), " ".join(b), " ".join(passage(4, 80) + b[20:90] + passage(5, 30)), None, "", "   \n\t ", "one", "one", "two words", "a b c d e", "A b C d e", "a b c d f",
        " ".join(["same"] * 200), "x" * 5000, " ".join(passage(6, 3000)), "é ñ ü ß 日本語   thin space", "line one.\nline two.\n\nline two.\n", " ".join(a[:150] + ["changed", "twice"] + a[152:]),
        "mail bob.smith@mail.example.org or 10.0.0.1, card 4111 1111 1111 1111, call +1 (555) 123-4567.", "GO!!! NOW!!! BUY!!!\n" * 30, " ".join(passage(7, 60)), "\x00 nul ▁ block", "tie tie tie tie tie tie", "tie tie tie tie tie tie",
    ]


def rows():
    out = [(i, t, "en", None if i % 5 == 0 else f"s{i % 3}", len(t) if t is not None else None, "k", i, 0.5, "z", "q", "b", "t", 1, "x") for i, t in enumerate(texts())]
    return [*out, out[3], (None, "a row without an id " * 4, None, None, None, None, None, None, None, None, None, None, None, None)]


def documents(spark, some=None):
    return spark.createDataFrame(rows() if some is None else some, SCHEMA).repartition(3)


def words(text, lower=False):
    return WORD.findall((text or "").translate(LOWER) if lower else text or "")
