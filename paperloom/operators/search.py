"""Lexical matching, and full-text search as an extension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lexical_terms
from ..sources.scratch import scratch_folder

LEAST_QUERY = 2
#: Rare terms in which two texts meet before they are compared.
DEPTH = 2


def plain_words(x: Column) -> Column:
    """The words of a text as phrases are looked for in it: lower-cased, anything but letters and digits made one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), r"[^\p{L}\p{Nd}]", " "), r"\s+", " "))


def _grams(x: Column) -> Column:
    """The distinct runs of three characters."""
    return F.when(F.length(x) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(x) - 2), lambda i: F.substring(x, i, F.lit(3)))))


def phrase_hits(queries: DataFrame, signals: DataFrame, query_id: str, source_id: str) -> DataFrame:
    """(query_id, source_id): the sources one of whose phrases is in the query's ``plain`` text.

    A phrase is looked for only where its rarest run of three characters is: queries and
    phrases meet by a join of these. Shorter phrases are looked for in every query; a blank one is in all.
    """
    phrases = signals.filter("phrase IS NOT NULL").select(source_id, F.lower("phrase").alias("phrase")).distinct()
    runs = queries.select(query_id, "plain", F.explode(_grams(F.col("plain"))).alias("gram"))
    counts = runs.groupBy("gram").agg(F.count(F.lit(1)).alias("held"))
    asked = phrases.select("phrase").distinct().select("phrase", F.explode(_grams(F.col("phrase"))).alias("gram"))
    # A phrase with a run that no query has is in none: its count stays null and orders first.
    rarest = asked.join(counts, "gram", "left").groupBy("phrase").agg(F.min(F.struct(F.coalesce("held", F.lit(0)).alias("held"), "gram")).alias("r")).filter("r.held > 0")
    met = runs.join(rarest.select("phrase", F.col("r.gram").alias("gram")), "gram").filter(F.contains("plain", F.col("phrase"))).select(query_id, "phrase")
    short = phrases.filter(F.length("phrase") < 3).select("phrase").distinct()
    near = queries.select(query_id, "plain").join(short, F.contains("plain", F.col("phrase"))).select(query_id, "phrase")
    return met.unionByName(near).join(phrases, "phrase").select(query_id, source_id).distinct()


def lexical_candidates(queries: DataFrame, sources: DataFrame, signals: DataFrame, query_id: str = "query_id", source_id: str = "source_id") -> DataFrame:
    """(query_id, source_id, overlap, rank) of sources with a signal phrase in the query and a common term.

    ``queries`` (query_id, query), ``sources`` (source_id, content) active and internal
    ones only, ``signals`` (source_id, phrase). Phrases decide which pairs there are, and
    only the terms of these are compared.
    """
    asked = queries.select(query_id, plain_words(F.col("query")).alias("plain"), lexical_terms(F.col("query")).alias("asked"))
    pairs = phrase_hits(asked.select(query_id, "plain"), signals, query_id, source_id)
    held = sources.select(source_id, lexical_terms(F.col("content")).alias("held"))
    both = held.join(pairs, source_id).join(asked.select(query_id, "asked"), query_id)
    found = both.select(query_id, source_id, F.sort_array(F.array_intersect("asked", "held")).alias("overlap")).filter(F.size("overlap") > 0)
    order = Window.partitionBy(query_id).orderBy(F.size("overlap").desc(), F.col(source_id))
    return found.select(query_id, source_id, "overlap", F.row_number().over(order).alias("rank"))


def _kept(terms: DataFrame) -> DataFrame:
    """``terms`` as a table that was written, so that texts are cut into words once for all that reads it."""
    path = scratch_folder(terms.sparkSession, "terms")
    terms.write.parquet(path)
    return terms.sparkSession.read.schema(terms.schema).parquet(path)


def overlap(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_text: str = "text", right_text: str = "text", least: int = 1, depth: int = DEPTH) -> DataFrame:
    """(left_id, right_id, shared): the number of common terms of each pair that has at least ``least``.

    With ``least`` > 1 only the postings of rare terms meet. In the order of how many texts
    of the left side hold them, all but the ``least`` - d most frequent terms of a text on
    the right share at least d with any text that it overlaps enough; terms that the left
    side doesn't have are out from the start, and so are texts that then have too few. Pairs
    that meet in fewer than d = ``depth`` of these terms are dropped, the others compared
    in whole. So what is joined grows with the pairs that have rare terms in common, and a
    frequent term meets only where a text has hardly any other. The terms of both sides are
    written once under the scratch folder, as several steps read them. Texts without an
    id or with null text are in no pair; ids name one text each.
    """
    a = left.select(left_id, lexical_terms(F.col(left_text)).alias("terms"))
    b = right.select(right_id, lexical_terms(F.col(right_text)).alias("terms"))
    if least > 1:
        a, b = _kept(a), _kept(b)
    a, b = a.filter(F.size("terms") >= least), b.filter(F.size("terms") >= least)
    posted = a.select(left_id, F.explode("terms").alias("term"))
    asked = b.select(right_id, F.explode("terms").alias("term"))
    if least <= 1:
        return posted.join(asked, "term").groupBy(left_id, right_id).agg(F.count(F.lit(1)).alias("shared"))
    depth = max(1, min(depth, least))
    held = posted.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("held"))
    own = Window.partitionBy(right_id)
    ranked = asked.join(held, "term").select(right_id, "term", F.row_number().over(own.orderBy("held", "term")).alias("place"), F.count(F.lit(1)).over(own).alias("n"))
    rare = ranked.filter(F.col("place") <= F.col("n") - least + depth).filter(F.col("n") >= least).select(right_id, "term")
    met = posted.join(rare, "term").groupBy(left_id, right_id).agg(F.count(F.lit(1)).alias("met")).filter(F.col("met") >= depth).select(left_id, right_id)
    sides = a.withColumnRenamed("terms", "__a").join(met, left_id).join(b.withColumnRenamed("terms", "__b"), right_id)
    # As a generated column: the filter on it would be moved below, where it compares each pair a second time.
    shared = F.explode(F.array(F.size(F.array_intersect("__a", "__b")).cast("long"))).alias("shared")
    return sides.select(left_id, right_id, shared).filter(F.col("shared") >= least)


def search_texts(sources: list[tuple[str, DataFrame, str, str]], q: str, top: int = 20) -> DataFrame:
    """(match_source, id, score, snippet): texts that hold all words of the query, by how often.

    ``sources`` are (name, rows, id column, text column). An extension: the ranking is ours.
    """
    words = sorted({w for w in q.lower().split() if w})
    if len(q.strip()) < LEAST_QUERY:
        raise ValueError(f"a search takes at least {LEAST_QUERY} characters")
    found = None
    for name, rows, key, text in sources:
        lowered = F.lower(F.coalesce(text, F.lit("")))
        kept = rows
        for w in words:
            kept = kept.filter(F.contains(F.lower(text), F.lit(w)))
        times = sum(((F.length(lowered) - F.length(F.replace(lowered, F.lit(w), F.lit("")))) / len(w) for w in words), F.lit(0.0))
        at = F.greatest(F.instr(lowered, words[0]) - 40, F.lit(1))
        part = kept.select(F.lit(name).alias("match_source"), F.col(key).cast("string").alias("id"), times.alias("score"), F.substring(F.col(text), at, F.lit(120)).alias("snippet"))
        found = part if found is None else found.unionByName(part)
    return found.orderBy(F.col("score").desc(), "match_source", "id").limit(top)
