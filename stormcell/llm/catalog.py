"""Queries of the llm operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (fingerprints, mixing, ngram_join, packing, passages, quality_classifier, quality_rules, ranked_search,
               simhash_join, token_counts, toxicity, url_filter, whitening)
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


WORDS = r"[^\x20\x09-\x0D]+"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_JACCARD_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '{WORDS}'), []) AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM d),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS o
  FROM items AS a JOIN items AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2, 3, 4),
links AS (SELECT x, y FROM pairs WHERE 100 * o >= 75 * (nx + ny - o)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y AS x, x AS y FROM links),
reach(x, y) AS (SELECT x, y FROM edges UNION SELECT r.x, e.y FROM reach AS r JOIN edges AS e ON r.y = e.x),
least AS (SELECT x, min(y) AS m FROM reach GROUP BY x)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, least(s.doc_id, coalesce(l.m, s.doc_id)) AS component_id
FROM sets AS s LEFT JOIN least AS l ON s.doc_id = l.x
"""


@register("op5_ngram_jaccard_join", _JACCARD_SQL)
def q_jaccard(spark, sf_dir):
    """Operator 5: components of documents whose 5-word shingle sets have a Jaccard similarity of 0.75 or more."""
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


_PASSAGES_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '{WORDS}'), []) AS w FROM documents),
h AS (
  SELECT doc_id, unnest(range(1, len(w) - 48)) AS i,
    unnest(list_transform(range(1, len(w) - 48), lambda i: md5(array_to_string(w[i:i + 49], ' ')))) AS m
  FROM d WHERE len(w) >= 50),
late AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY m) AS first_doc FROM h) AS f WHERE first_doc < doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM late CROSS JOIN (SELECT unnest(range(0, 50)) AS k) AS o),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d),
kept AS (
  SELECT w.doc_id, string_agg(w.x, ' ' ORDER BY w.p) AS t, count(*) AS n
  FROM words AS w ANTI JOIN gone AS g ON w.doc_id = g.doc_id AND w.p = g.p GROUP BY w.doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, (len(d.w) - coalesce(k.n, 0))::BIGINT AS n_removed,
  sha256(coalesce(k.t, '')) AS kept_sha256
FROM d LEFT JOIN kept AS k ON d.doc_id = k.doc_id
"""


@register("op10_repeated_passages", _PASSAGES_SQL)
def q_passages(spark, sf_dir):
    """Operator 10: words covered by a 50-word window that a document with a smaller doc_id has too."""
    return passages.passage_digest(table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    """The public byte-level BPE vocabulary of the queries."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@register("op1_token_counts")
def q_token_counts(spark, sf_dir):
    """Operator 1: token counts of all documents before and after edits, re-encoding only what the edits touch."""
    return token_counts.edited_counts(table(spark, sf_dir, "documents"), tokenizer_path(), token_counts.middle_edits)


@register("op2_best_fit_packing")
def q_packing(spark, sf_dir):
    """Operator 2: all documents packed into sequences of at most 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


@register("op3_toxicity")
def q_toxicity(spark, sf_dir):
    """Operator 3: toxicity scores of all documents."""
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op4_quality_classifier")
def q_quality(spark, sf_dir):
    """Operator 4: quality scores of all documents."""
    return quality_classifier.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op6_temperature_mixing")
def q_mixing(spark, sf_dir):
    """Operator 6: every document with its epochs and places in the mixed order; all sources are seen once at least."""
    tokens = mixing.bpe_tokens(spark, tokenizer_path())
    return mixing.mix(table(spark, sf_dir, "documents"), tokens).select("doc_id", "source", "mix_epoch", "mix_block", "mix_place")


@register("op7_fingerprints")
def q_fingerprints(spark, sf_dir):
    """Operator 7: fingerprints of all documents and of their edited texts, and the near copies of every 50th doc_id."""
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"), fingerprints.NEAR_RADIUS)


@register("op8_quality_rules")
def q_rules(spark, sf_dir):
    """Operator 8: rule statistics and the forest's verdict on all documents."""
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op9_url_filter")
def q_urls(spark, sf_dir):
    """Operator 9: verdict on every page's url."""
    return url_filter.judge(table(spark, sf_dir, "pages"))


@register("op13_simhash_near_dedup")
def q_simhash(spark, sf_dir):
    """Operator 13: fingerprints of all documents and the components of those at two differing bits or fewer."""
    return simhash_join.near_components(table(spark, sf_dir, "documents"))


@register("op11_embedding_whitening")
def q_whitening(spark, sf_dir):
    """Operator 11: all embeddings projected on the four leading components, whitened."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


_TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_SEARCH_SQL = rf"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '{_TERMS}')) AS g FROM documents),
tf AS (SELECT doc_id, g, count(*)::BIGINT AS tf FROM t GROUP BY 1, 2),
n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY 1),
s AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS l FROM n),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER}, '{_TERMS}')) AS g FROM benchmark),
df AS (SELECT g, count(*) AS df FROM tf GROUP BY g),
w AS (SELECT g, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM df CROSS JOIN s),
m AS (SELECT doc_id, (100 - 50 + ((50 * n * nd) // l))::BIGINT AS m FROM n CROSS JOIN s),
scored AS (
  SELECT q.item_id, tf.doc_id, sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 20 * m.m)))::BIGINT AS score
  FROM q JOIN w ON q.g = w.g JOIN tf ON q.g = tf.g JOIN m ON tf.doc_id = m.doc_id GROUP BY 1, 2)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 50
"""


@register("op12_ranked_search", _SEARCH_SQL)
def q_search(spark, sf_dir):
    """Operator 12: the 50 best documents of every benchmark item."""
    return ranked_search.top_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
