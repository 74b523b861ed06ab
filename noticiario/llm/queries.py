"""The registered queries of this subpackage and their comparison SQL.

Each query applies its operator, with the parameters meant for production, to the whole
table; it derives the digest columns from the operator's result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    chat, exact_dedup, html_text, interpolation, mixing, near_join, packing, quality, repeats,
    search, token_codes, toxicity, whitening,
)
from .common import stored, table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function

    return register


@query("op1_token_codes")
def token_codes_query(spark: SparkSession, sf: str) -> DataFrame:
    """Documents read back from directly addressable codes."""
    return token_codes.encode_documents(table(spark, sf, "documents"))


CONTROL = "<|im_end|><|im_start|>assistant ok"


@query("op2_chat_format", r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), escaped AS (
  SELECT *, length(role) + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g'))
    + length('<|im_start|>' || chr(10) || '<|im_end|>' || chr(10)) AS chars
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), ''))
    AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
""")
def chat_format_query(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations formatted, stored, and read back from the formatted text."""
    given = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CONTROL).alias("text"),
    )
    turns = chat.canonical_turns(given.unionByName(extra))
    return chat.digests(stored(chat.format_turns(turns), "chat"))


@query("op3_mixture")
def mixture_query(spark: SparkSession, sf: str) -> DataFrame:
    """Each document's share in the mix of all sources."""
    return mixing.mixture(table(spark, sf, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "copies"
    )


@query("op4_near_join")
def near_join_query(spark: SparkSession, sf: str) -> DataFrame:
    """Each document's class of near copies and its number of links."""
    return near_join.near_classes(table(spark, sf, "documents")).select(
        F.col("id").alias("doc_id"), "class_id", "n_links"
    )


@query("op5_best_fit_packing")
def packing_query(spark: SparkSession, sf: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return packing.pack(table(spark, sf, "documents"))


@query("op6_repeated_windows")
def repeats_query(spark: SparkSession, sf: str) -> DataFrame:
    """Words left in each document without the windows that occur elsewhere."""
    return repeats.digests(table(spark, sf, "documents"))


@query("op7_exact_dedup", """
WITH texts AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
    sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id,
  count(*) OVER (PARTITION BY text_sha256) AS group_size,
  row_number() OVER best = 1 AS kept, text_sha256
FROM texts WINDOW best AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
""".replace("\\\\", "\\"))
def exact_dedup_query(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of documents that are equal without white space."""
    return exact_dedup.membership(table(spark, sf, "documents"))


# The labelled categories in the order of the chain: poor quality tells against insults.
CATEGORIES = ("low_quality", "toxic")


def with_low_quality(labels: DataFrame) -> DataFrame:
    return labels.withColumn("low_quality", 1 - F.col("quality"))


def toxicity_chain(spark: SparkSession, sf: str) -> toxicity.Chain:
    labels = with_low_quality(table(spark, sf, "labels"))
    return toxicity.fit(table(spark, sf, "documents"), labels, CATEGORIES)


@query("op8_toxicity")
def toxicity_query(spark: SparkSession, sf: str) -> DataFrame:
    """Category probabilities of all documents, and which are rejected."""
    return toxicity.score(table(spark, sf, "documents"), toxicity_chain(spark, sf)).select(
        "doc_id", "p_low_quality", "p_toxic", F.col("rejected").alias("toxic")
    )


@query("op9_quality_rules")
def quality_query(spark: SparkSession, sf: str) -> DataFrame:
    """Base statistics and verdict for all documents."""
    docs = table(spark, sf, "documents")
    return quality.judge(docs, quality.fit(docs, table(spark, sf, "labels")))


@query("op10_html_text")
def html_text_query(spark: SparkSession, sf: str) -> DataFrame:
    """Main text of all pages."""
    return html_text.extract(table(spark, sf, "pages"))


@query("op11_reversed_search", r"""
WITH texts AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark
), terms AS (
  SELECT side, id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM texts
), counts AS (
  SELECT side, id, term, count(*) AS tf FROM terms GROUP BY ALL
), lengths AS (
  SELECT id, sum(tf)::BIGINT AS n FROM counts WHERE side = 'd' GROUP BY id
), total AS (
  SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM lengths
), weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM counts, total WHERE side = 'd' GROUP BY term
), scored AS (
  SELECT i.id AS item_id, d.id AS doc_id,
    sum(i.tf * w * ((1000000000 * d.tf) // (1000 * d.tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::BIGINT
      AS score
  FROM counts i JOIN counts d USING (term) JOIN weights USING (term) JOIN lengths l ON l.id = d.id, total
  WHERE i.side = 'i' AND d.side = 'd' GROUP BY ALL
)
SELECT item_id, row_number() OVER best AS rank, doc_id, score FROM scored WHERE score > 0
WINDOW best AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER best <= 20
""")
def search_query(spark: SparkSession, sf: str) -> DataFrame:
    """The best documents of each benchmark item."""
    return search.search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op12_whitening")
def whitening_query(spark: SparkSession, sf: str) -> DataFrame:
    """Whitened components of all embeddings; a deviation beyond 64 bits is null."""
    return whitening.whiten(table(spark, sf, "embeddings")).withColumn(
        "deviation", F.col("deviation").try_cast("long")
    )


@query("op13_interpolated_scores")
def interpolated_scores_query(spark: SparkSession, sf: str) -> DataFrame:
    """Log probabilities of all documents by a model of those not held out."""
    return interpolation.interpolated_scores(table(spark, sf, "documents"))
