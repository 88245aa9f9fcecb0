"""The queries opN_ over the tables of a folder, thin over their operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .decontamination import contaminated
from .html_text import main_texts
from .jaccard_join import near_copies
from .mixing import mixed
from .pii import personal_data, printed as printed_spans
from .quality import held_out, quality_scores, train
from .repeats import without_repeats
from .suffix_tree_lm import scored_texts
from .token_counts import token_counts
from .winnowing import fingerprinted


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_quality_crf(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents")
    field = train(documents, _table(spark, folder, "labels").filter(~held_out()))
    return quality_scores(documents, field).withColumn("held_out", held_out()).select("doc_id", "held_out", "score", "predicted")


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contaminated(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op3_weak_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = personal_data(_table(spark, folder, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    counts = [count(n).alias(f"n_{name}") for n, name in enumerate(("email", "ip", "card", "phone"))]
    return found.select("doc_id", *counts, F.sha2(printed_spans(F.col("base")).cast("binary"), 256).alias("base_sha256"), printed_spans(F.col("spans")).alias("spans"))


def op4_suffix_tree_lm(spark: SparkSession, folder: str) -> DataFrame:
    return scored_texts(_table(spark, folder, "documents"))


def op5_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return near_copies(_table(spark, folder, "documents"))


def op6_winnowing(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprinted(_table(spark, folder, "documents"))


def op7_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixed(_table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return token_counts(_table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_html_mincut(spark: SparkSession, folder: str) -> DataFrame:
    return main_texts(_table(spark, folder, "pages"))


def op10_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return without_repeats(_table(spark, folder, "documents"), with_text=False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_crf": op1_quality_crf,
    "op2_decontamination": op2_decontamination,
    "op3_weak_pii": op3_weak_pii,
    "op4_suffix_tree_lm": op4_suffix_tree_lm,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_winnowing": op6_winnowing,
    "op7_source_mixing": op7_source_mixing,
    "op8_token_counts": op8_token_counts,
    "op9_html_mincut": op9_html_mincut,
    "op10_substring_dedup": op10_substring_dedup,
}

_WORDS = r"""
w AS (SELECT doc_id, list_filter(string_split_regex(TEXT, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents)"""

ORACLE_SQL: dict[str, str] = {
    "op5_jaccard_join": "WITH RECURSIVE"
    + _WORDS.replace("TEXT", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
    + """,
k AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS s FROM (SELECT doc_id, words, unnest(generate_series(1, greatest(len(words) - 4, least(len(words), 1)))) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM k GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM k a JOIN k b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, g.b FROM reach r JOIN both_ways g ON r.b = g.a)
SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, least(w.doc_id, coalesce(min(r.b), w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN reach r ON r.a = w.doc_id GROUP BY w.doc_id""",
    "op10_substring_dedup": "WITH"
    + _WORDS.replace("TEXT", "coalesce(text, '')")
    + """,
s AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS s FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 49)) AS i FROM w)),
f AS (SELECT s, min(doc_id) AS least FROM s GROUP BY s),
c AS (SELECT DISTINCT doc_id, i + o AS i FROM (SELECT doc_id, i, unnest(generate_series(0, 49)) AS o FROM s JOIN f USING (s) WHERE doc_id > least)),
x AS (SELECT doc_id, unnest(words) AS word, unnest(generate_series(1, len(words))) AS i FROM w),
k AS (SELECT x.doc_id, count(c.i) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY x.i) FILTER (c.i IS NULL), '') AS kept FROM x LEFT JOIN c USING (doc_id, i) GROUP BY x.doc_id)
SELECT w.doc_id, len(words) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)""",
}
