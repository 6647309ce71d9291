"""Full-text search over an inverted index: a table of postings by term, and one of the terms.

A posting is a term in a text with the positions it stands at. Written in order of the
terms, a query for words, phrases and beginnings of words reads the row groups of its terms
and no texts. An extension: the ranking, by how often the clauses are met, is ours.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A term: a run of letters and digits, lower-cased.
TERM = r"[\p{L}\p{Nd}]+"
#: Texts that are scored first, for each one asked for.
AHEAD = 4
DOC = ["match_source", "id"]


@dataclass(frozen=True)
class TextIndex:
    """``postings`` (term, match_source, id, positions) and ``terms`` (term, held, most): in how many texts, and how often in one at most."""

    postings: DataFrame
    terms: DataFrame


@dataclass(frozen=True)
class Clause:
    """Words in a row; of the last one only the beginning if ``prefix``."""

    words: tuple[str, ...]
    prefix: bool = False

    def __post_init__(self):
        if not self.words or not all(self.words) or (self.prefix and len(self.words) > 1):
            raise ValueError("a clause has a word, several words in a row, or one beginning of a word")


def clauses(words: tuple[str, ...] = (), phrases: tuple[tuple[str, ...], ...] = (), prefixes: tuple[str, ...] = ()) -> list[Clause]:
    lowered = lambda part: tuple(w.lower() for w in part)
    found = [Clause(lowered([w])) for w in words] + [Clause(lowered(p)) for p in phrases] + [Clause(lowered([p]), prefix=True) for p in prefixes]
    if not found:
        raise ValueError("a search has a clause")
    return list(dict.fromkeys(found))


def _posted(texts: DataFrame) -> DataFrame:
    """(term, match_source, id, positions) of each row of (match_source, id, words): a row's words in order, cut where the term changes. Nothing is shuffled."""
    held = texts.select(*DOC, F.sort_array(F.transform("words", lambda w, i: F.struct(w.alias("term"), i.alias("position")))).alias("held")).filter(F.size("held") > 0)
    term = lambda i: F.get(F.col("held"), i)["term"]
    firsts = F.filter(F.sequence(F.lit(0), F.size("held") - 1), lambda i: (i == 0) | (term(i) != term(i - 1)))
    cut = held.select(*DOC, "held", firsts.alias("firsts"))
    size = lambda i, j: F.coalesce(F.get(F.col("firsts"), j + 1), F.size("held")) - i
    places = lambda i, j: F.transform(F.slice(F.col("held"), i + 1, size(i, j)), lambda x: x["position"])
    rows = cut.select(*DOC, F.inline(F.transform("firsts", lambda i, j: F.struct(term(i).alias("term"), places(i, j).alias("positions")))))
    return rows.select("term", *DOC, "positions")


def built(sources: list[tuple[str, DataFrame, str, str]]) -> TextIndex:
    """The index of texts; ``sources`` are (name, rows, id column, text column). Null texts have no postings.

    A row's postings are made inside it. Whether ids repeat is looked up first; only the
    postings of those that do are grouped.
    """
    found = None
    for name, rows, key, text in sources:
        words = F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))
        part = rows.filter(F.col(text).isNotNull()).select(F.lit(name).alias("match_source"), F.col(key).cast("string").alias("id"), words.alias("words"))
        found = part if found is None else found.unionByName(part)
    repeated = found.groupBy(*DOC).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select(F.col("match_source").alias("source"), F.col("id").alias("name"))
    if repeated.isEmpty():
        postings = _posted(found)
    else:
        same = F.col("match_source").eqNullSafe(F.col("source")) & F.col("id").eqNullSafe(F.col("name"))
        merged = _posted(found.join(repeated, same, "left_semi")).groupBy("term", *DOC).agg(F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))
        postings = _posted(found.join(repeated, same, "left_anti")).unionByName(merged)
    return TextIndex(postings, _terms(postings))


def _terms(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("held"), F.max(F.size("positions")).alias("most"))


def written(index: TextIndex, path: str, mode: str = "errorifexists") -> TextIndex:
    """The index as two tables under ``path``, each in order of its terms so that readers skip what they aren't asked for."""
    spark = index.postings.sparkSession
    index.postings.repartitionByRange("term", *DOC).sortWithinPartitions("term", *DOC).write.mode(mode).parquet(f"{path}/postings")
    # The terms are counted from the stored postings.
    terms = _terms(spark.read.parquet(f"{path}/postings"))
    terms.repartitionByRange("term").sortWithinPartitions("term").write.mode(mode).parquet(f"{path}/terms")
    return read(spark, path)


def read(spark: SparkSession, path: str) -> TextIndex:
    return TextIndex(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/terms"))


def _is_term(clause: Clause) -> Column:
    """Whether a row's term is one of the clause's: a filter that reaches the scan."""
    if clause.prefix:
        return F.startswith(F.col("term"), F.lit(clause.words[0]))
    return F.col("term").isin(*clause.words)


def _any(found: list[Clause]) -> Column:
    out = F.lit(False)
    for c in found:
        out = out | _is_term(c)
    return out


def _shifted(places: Column, by: int) -> Column:
    return F.transform(places, lambda p: p - by)


def _times(clause: Clause, name: str) -> Column:
    """How often the clause is met in a text, over its postings."""
    if len(clause.words) == 1:
        return F.sum(F.when(_is_term(clause), F.size("positions")).otherwise(0)).cast("long").alias(name)
    places = [F.coalesce(F.max(F.when(F.col("term") == w, F.col("positions"))), F.array().cast("array<int>")) for w in clause.words]
    # Where the first word starts a phrase, the others stand at the places after it.
    starts = places[0]
    for i, place in enumerate(places[1:], 1):
        starts = F.array_intersect(starts, _shifted(place, i))
    return F.size(starts).cast("long").alias(name)


def _scored(postings: DataFrame, found: list[Clause], among: DataFrame | None = None) -> DataFrame:
    """(match_source, id, score) of the texts that meet all clauses; of those ``among`` only."""
    rows = postings.filter(_any(found))
    if among is not None:
        rows = rows.join(among, DOC, "left_semi")
    names = [f"c{i}" for i in range(len(found))]
    counted = rows.groupBy(*DOC).agg(*[_times(c, n) for c, n in zip(found, names, strict=True)])
    met, score = F.lit(True), F.lit(0).cast("long")
    for n in names:
        met, score = met & (F.col(n) > 0), score + F.col(n)
    return counted.filter(met).select(*DOC, score.alias("score"))


def search(index: TextIndex, words: tuple[str, ...] = (), phrases: tuple[tuple[str, ...], ...] = (), prefixes: tuple[str, ...] = (), top: int = 20) -> DataFrame:
    """(match_source, id, score): the best texts that meet all clauses, by how often, then by source and id.

    The clause with the fewest texts leads: only its texts can meet all. Of these a few that
    meet it most often are scored first. The last of them gives a floor, and a text whose
    count of the leading clause, with the most that the others can add, stays below it
    isn't looked at.
    """
    found = clauses(words, phrases, prefixes)
    order = [F.col("score").desc(), *DOC]
    # A row: for each clause how many texts it can have at most, and how often one can meet it.
    stats = index.terms.filter(_any(found)).agg(*[x for i, c in enumerate(found) for x in _limits(c, i)]).first()
    held, most = ([stats[f"{k}{i}"] or 0 for i in range(len(found))] for k in ("held", "most"))
    lead = min(range(len(found)), key=lambda i: (held[i], i))
    rest = sum(most) - most[lead]
    led = _scored(index.postings, [found[lead]]).withColumnRenamed("score", "led")
    if len(found) > 1:
        ahead = led.orderBy(F.col("led").desc(), *DOC).limit(AHEAD * top).select(*DOC)
        best = _scored(index.postings, found, F.broadcast(ahead)).orderBy(*order).limit(top)  # AHEAD * top texts
        floor = best.agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("score")).first()
        if floor.n == top:
            led = led.filter(F.col("led") + rest >= floor.score)
    return _scored(index.postings, found, led.select(*DOC)).orderBy(*order).limit(top)


def _limits(clause: Clause, i: int) -> list[Column]:
    """Bounds over the clause's terms: of a phrase the rarest word decides, beginnings add up."""
    mine = _is_term(clause)
    held, most = F.when(mine, F.col("held")), F.when(mine, F.col("most"))
    if clause.prefix:
        return [F.sum(held).alias(f"held{i}"), F.sum(most).alias(f"most{i}")]
    whole = F.count_if(mine) == len(set(clause.words))
    return [F.when(whole, F.min(held)).otherwise(0).alias(f"held{i}"), F.when(whole, F.min(most)).otherwise(0).alias(f"most{i}")]


def snippets(hits: DataFrame, sources: list[tuple[str, DataFrame, str, str]], word: str, size: int = 120) -> DataFrame:
    """``hits`` with the text around the first place of a word; texts are read for the hits alone."""
    texts = None
    for name, rows, key, text in sources:
        part = rows.select(F.lit(name).alias("match_source"), F.col(key).cast("string").alias("id"), F.col(text).alias("__text"))
        texts = part if texts is None else texts.unionByName(part)
    at = F.greatest(F.instr(F.lower("__text"), F.lit(word.lower())) - size // 3, F.lit(1))
    return hits.join(texts, DOC).withColumn("snippet", F.substring("__text", at, F.lit(size))).drop("__text")
