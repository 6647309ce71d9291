"""Registered queries of searching and of keeping indexes up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import digests, fulltext, search
from ..sources.scratch import scratch_folder
from ..sources.tables import sf_table
from .queries import query

_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{Nd}]+')"


@query("index_search", f"""
WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
c AS (SELECT doc_id, len(list_filter(w, lambda x: x = 'the')) AS a, len(list_filter(w, lambda x: starts_with(x, 'li'))) AS b,
  len(list_filter(range(1, len(w)), lambda i: w[i] = 'the' AND w[i + 1] = 'and')) AS c FROM w)
SELECT 'documents' AS match_source, CAST(doc_id AS VARCHAR) AS id, a + b + c AS score FROM c WHERE a > 0 AND b > 0 AND c > 0 ORDER BY score DESC, match_source, id LIMIT 20
""")
def index_search(spark: SparkSession, d: str) -> DataFrame:
    """A word, a beginning of words and a phrase, over the inverted index of all documents, which is written first."""
    index = fulltext.built([("documents", sf_table(spark, d, "documents"), "doc_id", "text")])
    index = fulltext.written(index, scratch_folder(spark, "text-index"))
    return fulltext.search(index, words=("The",), phrases=(("the", "and"),), prefixes=("li",))


@query("index_changes", """
WITH s AS (SELECT doc_id, CASE WHEN doc_id % 97 = 5 THEN 'new' ELSE sha256(text) END AS h FROM documents WHERE doc_id % 89 <> 7 OR doc_id % 2 = 0),
i AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 83 <> 11 OR doc_id % 89 = 7)
SELECT coalesce(s.doc_id, i.doc_id) AS doc_id, CASE WHEN s.doc_id IS NULL THEN 'stale' WHEN i.doc_id IS NULL THEN 'new' ELSE 'changed' END AS state
FROM s FULL JOIN i ON s.doc_id = i.doc_id WHERE s.h IS DISTINCT FROM i.h
""")
def index_changes(spark: SparkSession, d: str) -> DataFrame:
    """What a new version of the documents changes in a stored one, found by the digests of its buckets."""
    docs = sf_table(spark, d, "documents").select("doc_id", text.content_hash(F.col("text")).alias("content_hash"))
    path, compared = scratch_folder(spark, "bucketed"), ["content_hash"]
    digests.written(docs.filter("doc_id % 83 <> 11 OR doc_id % 89 = 7"), path, "doc_id", compared)
    now = docs.filter("doc_id % 89 <> 7 OR doc_id % 2 = 0").withColumn("content_hash", F.when(F.col("doc_id") % 97 == 5, F.lit("new")).otherwise(F.col("content_hash")))
    return digests.changes(now, digests.stored_rows(spark, path), digests.stored_tree(spark, path), "doc_id", compared)


_PLAIN = r"trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{Nd}]', ' ', 'g'), '[ \t\n\r\f\v]+', ' ', 'g'))"
_TERMS = r"list_distinct(list_filter(str_split(trim(regexp_replace(lower(text), '[^\p{L}\p{Nd}]+', ' ', 'g')), ' '), lambda w: length(w) >= 2))"


@query("lexical_candidates", f"""
WITH q AS (SELECT item_id, {_PLAIN} AS plain, {_TERMS} AS terms FROM benchmark),
s AS (SELECT doc_id, {_TERMS} AS terms, array_to_string(list_slice(str_split({_PLAIN}, ' '), 3, 4), ' ') AS phrase FROM documents),
p AS (SELECT item_id, doc_id, list_filter(q.terms, lambda t: list_contains(s.terms, t) AND t NOT IN ({", ".join(repr(w) for w in text.STOP_WORDS)})) AS terms FROM q JOIN s ON contains(plain, phrase))
SELECT item_id, doc_id, len(terms) AS shared, CAST(row_number() OVER (PARTITION BY item_id ORDER BY len(terms) DESC, doc_id) AS INTEGER) AS rank FROM p WHERE len(terms) > 0
""")
def lexical_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items as queries, documents as sources, and as a document's signal its third and fourth word."""
    queries = sf_table(spark, d, "benchmark").select("item_id", F.col("text").alias("query"))
    docs = sf_table(spark, d, "documents").select("doc_id", F.col("text").alias("content"))
    signals = docs.select("doc_id", F.array_join(F.slice(F.split(search.plain_words(F.col("content")), " "), 3, 2), " ").alias("phrase"))
    found = search.lexical_candidates(queries, docs, signals, "item_id", "doc_id")
    return found.select("item_id", "doc_id", F.size("overlap").cast("long").alias("shared"), "rank")
