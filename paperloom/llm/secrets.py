"""Secret scans over a trigram inverted index.

Each rule's regex is reduced to a Boolean query over lower-cased trigrams that every
match must contain. The index posts (trigram, document) for the trigrams that some
query asks for; intersecting the postings of a query gives the rule's candidates, and
only those are verified by the regex. A rule without mandatory trigrams scans all
documents. Everything is DataFrame expressions: the Python below runs on the driver,
over the handful of rules.
"""

from __future__ import annotations

import re._parser as regex_parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, local_table, stored


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched leftmost and non-overlapping; matches whose ``group`` is shorter than ``least`` are dropped.

    A rule that drops matches has a ``bounded`` pattern besides, which short values don't
    match in the first place; redaction goes by that.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    bounded: str = ""

    def redacted(self) -> str:
        if self.least and not self.bounded:
            raise ValueError(f"the rule {self.kind} drops short values and needs a bounded pattern for redaction")
        return self.bounded or self.pattern


# The base rules. Runs of one class are maximal, so a repeat of {24,} or {16,} finds the
# same spans as an open repeat from which short matches are dropped; the first rule must drop afterwards.
_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]"""
BASE_RULES = (
    Rule("assign", _ASSIGN + "+)", 2, 6, _ASSIGN + "{6,})"),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
# Further well-known token formats.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("repo_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("signed_token", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
RULES = BASE_RULES + MORE_RULES

MOST_BRANCHES = 64
SMALL_CLASS = 8


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """The regex as an OR of ANDs of lower-cased trigrams; None if a match may have none of them."""
    # A branch is (trigrams so far, the literal text that the next item would extend).
    end = _extend([(frozenset(), "")], regex_parser.parse(pattern))
    clauses = None if end is None else {done | _grams(tail) for done, tail in end}
    if not clauses or any(not c for c in clauses):
        return None
    return sorted((c for c in clauses if not any(other < c for other in clauses)), key=sorted)


def _grams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _broken(branches):
    return list({(done | _grams(tail), "") for done, tail in branches})


def _extend(branches, items):
    for op, arg in items:
        op = str(op)
        if op == "LITERAL":
            branches = [(done, tail + chr(arg).lower()) for done, tail in branches]
        elif op == "IN" and (letters := _letters(arg)):
            branches = [(done, tail + x) for done, tail in branches for x in letters]
        elif op == "SUBPATTERN":
            branches = _extend(branches, arg[3])
        elif op == "BRANCH":
            parts = [_extend(branches, alternative) for alternative in arg[1]]
            branches = None if None in parts else [b for part in parts for b in part]
        elif op == "MAX_REPEAT" and arg[:2] == (0, 1):
            taken = _extend(branches, arg[2])
            branches = None if taken is None else [*branches, *taken]
        elif op == "MAX_REPEAT" and arg[0] >= 1:
            once = _extend(branches, arg[2])
            branches = None if once is None else once if arg[:2] == (1, 1) else _broken(once)
        elif op == "AT":
            continue
        else:
            branches = _broken(branches)
        if branches is None or len(branches) > MOST_BRANCHES:
            return None
        branches = list(dict.fromkeys(branches))
    return branches


def _letters(items) -> list[str]:
    """The members of a small character class, lower-cased; none if it is large or negated."""
    found = set()
    for op, arg in items:
        if str(op) == "LITERAL":
            found.add(chr(arg).lower())
        elif str(op) == "RANGE" and arg[1] - arg[0] < SMALL_CLASS:
            found |= {chr(x).lower() for x in range(arg[0], arg[1] + 1)}
        else:
            return []
    return sorted(found) if len(found) <= SMALL_CLASS else []


def trigram_postings(keyed: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(key, trigram): which trigrams of the vocabulary each document holds, in any case."""
    lowered = keyed.select("key", F.lower("text").alias("text"))
    present = F.array_compact(F.array(*[F.when(F.contains("text", F.lit(t)), F.lit(t)) for t in vocabulary]))
    return lowered.select("key", F.explode(present).alias("trigram"))


def candidates(keyed: DataFrame, rules=RULES) -> DataFrame:
    """(key, rules): the rules whose trigram query a document meets, by intersecting postings."""
    spark = keyed.sparkSession
    plan = []
    for rule in rules:
        for i, clause in enumerate(trigram_query(rule.pattern) or ()):
            plan += [(rule.kind, i, t, 1 << n, (1 << len(clause)) - 1) for n, t in enumerate(sorted(clause))]
    if not plan:
        return local_table(spark, [], "key long, rules array<string>")
    asked = local_table(spark, plan, "rule string, clause int, trigram string, bit long, full long")
    posted = trigram_postings(keyed, sorted({t for _, _, t, _, _ in plan}))
    met = (
        posted.join(F.broadcast(asked), "trigram")  # bounded: a row per trigram of the rules
        .groupBy("key", "rule", "clause", "full")
        .agg(F.bit_or("bit").alias("seen"))
        .filter("seen = full")
    )
    return met.groupBy("key").agg(F.collect_set("rule").alias("rules"))


def _with_candidates(docs: DataFrame, rules) -> DataFrame:
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.xxhash64("doc_id", "text").alias("key"),
    )
    # A row for each candidate, without its text: while they are few, no text moves to meet them.
    found = broadcast_if_small(stored(candidates(keyed.select("key", "text"), rules), "candidates"))
    return keyed.join(found, "key", "left")


def _asked(rule: Rule) -> Column:
    """Whether the rule must be run on the row."""
    if trigram_query(rule.pattern) is None:
        return F.rlike("text", F.lit(rule.pattern))
    return F.coalesce(F.array_contains("rules", rule.kind), F.lit(False))


def _spans(rule: Rule, place: int) -> Column:
    """Array of (start, place, kind, end) of the rule's matches in ``text``, in code points.

    The pieces between matches and the matches give the offsets by running sums, taken
    in two levels (blocks of about the square root) so that many matches stay cheap.
    """
    pieces, found = F.split("text", rule.pattern, -1), F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0))
    value = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    sizes = F.transform(
        F.arrays_zip(pieces.alias("p"), found.alias("m"), value.alias("v")),
        lambda x: F.struct(F.length(x["p"]).alias("gap"), F.length(x["m"]).alias("n"), F.length(x["v"]).alias("v")),
    )
    sizes = F.filter(sizes, lambda x: x["n"].isNotNull())

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda acc, x: acc + x["gap"] + x["n"])

    def placed(all_sizes: Column) -> Column:
        step = F.ceil(F.sqrt(F.size(all_sizes))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), step), lambda b: total(F.slice(all_sizes, b * step + 1, step)))
        starts = F.transform(
            F.sequence(F.lit(0), step), lambda b: F.aggregate(F.slice(blocks, F.lit(1), b), F.lit(0), lambda acc, x: acc + x)
        )

        def one(x: Column, i: Column) -> Column:
            block = F.floor(i / step).cast("int")
            start = F.get(starts, block) + total(F.slice(all_sizes, block * step + 1, i - block * step)) + x["gap"]
            return F.struct(start.alias("start"), F.lit(place).alias("place"), F.lit(rule.kind).alias("kind"), (start + x["n"]).alias("end"), x["v"].alias("v"))

        return F.filter(F.transform(all_sizes, one), lambda x: x["v"] >= rule.least)

    # the array is bound once, by a transform over a single element
    return F.get(F.transform(F.array(sizes), placed), F.lit(0))


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, spans): per input row, the spans (start, place, kind, end) of all rules, by start and then rule.

    Null or empty texts have no spans; null ids and repeated rows are kept as they are;
    an empty table gives no rows; other columns are not read.
    """
    rows = _with_candidates(docs.select("doc_id", "text"), rules)
    none = F.expr("CAST(array() AS array<struct<start:int,place:int,kind:string,end:int,v:int>>)")
    each = [F.when(_asked(rule), _spans(rule, i)).otherwise(none) for i, rule in enumerate(rules)]
    return rows.select("row.doc_id", F.array_sort(F.concat(*each)).alias("spans"))


def redact_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """The rows of ``docs`` with every secret replaced; rows without secrets are unchanged.

    Here short values of a rule are ruled out inside its pattern, so that what a dropped
    match hides is replaced too. ``n_chars``, where there is one, follows the new text.
    """
    rows = _with_candidates(docs, rules)
    text = F.col("text")
    for rule in rules:
        text = F.when(_asked(rule), F.regexp_replace(text, rule.redacted(), mark)).otherwise(text)
    rows = rows.select("row", F.when(F.col("row.text").isNotNull(), text).alias("clean"))
    changed = {"text": F.col("clean"), "n_chars": F.length("clean").cast("long")}
    return rows.select(
        *[F.coalesce(changed[c], F.col(f"row.`{c}`")).alias(c) if c in changed else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    )


def span_list(spans: str, most: int) -> Column:
    """kind:start:end of the first ``most`` rules, comma-joined."""
    kept = F.filter(F.col(spans), lambda x: x["place"] < most)
    return F.array_join(F.transform(kept, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
