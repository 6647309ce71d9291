"""One query per operator, over its whole table with production parameters, and its SQL where there is one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .audio import decode_media, encode_texts, with_pcm_features
from .chat import format_chats, loss_text, read_chats
from .classifier import score_quality
from .common import stored, table
from .decontaminate import find_overlaps
from .jaccard import near_duplicates
from .licenses import scan_licenses
from .lines import remove_units
from .mixing import mix
from .repair import damage, repair_conversations
from .secrets import BASE_RULES, RULES, find_secrets, span_list
from .spelling import group_variants
from .substrings import remove_repeats
from .tokens import count_tokens

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql
        return run

    return register


@query("op1_mixing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, cap=2.0, budgets=(0.25, 1.0))
    return mixed.selectExpr("doc_id", "size", "source_size", "target", "taken", "size * copies[0] AS taken_quarter")


_CHAT_SQL = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), sized AS (
  SELECT *, replace(replace(text, '\\', '\\\\'), '<|', '<\\|') AS escaped,
    coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text), 'start') || '>' || role AS step,
    lead(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS later
  FROM turns
)
SELECT conv_id, bool_and(step IN ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user')) AND bool_or(later IS NULL AND role = 'assistant') AS valid,
  count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(12 + length(role) + 1 + length(escaped) + 11) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


@query("op3_chat", _CHAT_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return (
        read_chats(format_chats(turns))
        .withColumn("loss", loss_text())
        .select(
            "conv_id",
            "valid",
            F.size("turns").cast("long").alias("n_turns"),
            F.sha2(said, 256).alias("turns_sha256"),
            F.length("loss").cast("long").alias("loss_chars"),
            F.sha2("loss", 256).alias("loss_sha256"),
            F.length("text").cast("long").alias("formatted_chars"),
        )
    )


def _secret_sql() -> str:
    def spans(i: int) -> str:
        rule = RULES[i]
        return f"""
  list_filter(list_transform(range(1, len(m{i}) + 1), lambda i: struct_pack(
    s := CAST(coalesce(list_sum(list_transform(p{i}[1:i], lambda x: length(x))), 0)
         + coalesce(list_sum(list_transform(m{i}[1:i - 1], lambda x: length(x))), 0) AS BIGINT),
    r := {i}, k := '{rule.kind}', n := length(m{i}[i]), v := length(v{i}[i]))), lambda x: x.v >= {rule.least})"""

    def parts(i: int) -> str:
        rule = RULES[i]
        pattern = "'" + rule.pattern.replace("'", "''") + "'"
        return f"regexp_split_to_array(text, {pattern}) AS p{i}, regexp_extract_all(text, {pattern}) AS m{i}, regexp_extract_all(text, {pattern}, {rule.group}) AS v{i}"

    every = range(len(RULES))
    joined = "array_to_string(list_transform({0}, lambda x: x.k || ':' || x.s || ':' || (x.s + x.n)), ',')"
    base = f"list_filter(spans, lambda x: x.r < {len(BASE_RULES)})"
    counts = ", ".join(f"CAST(len(list_filter(spans, lambda x: x.r = {i})) AS BIGINT) AS n_{BASE_RULES[i].kind}" for i in range(len(BASE_RULES)))
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
parts AS (SELECT doc_id, {", ".join(parts(i) for i in every)} FROM texts),
found AS (SELECT doc_id, list_sort(list_concat({", ".join(spans(i) for i in every)})) AS spans FROM parts)
SELECT doc_id, {counts}, sha256({joined.format(base)}) AS base_sha256, {joined.format("spans")} AS spans FROM found
"""


@query("op4_secrets", _secret_sql())
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    count = lambda i: F.size(F.filter("spans", lambda x: x["place"] == i)).cast("long").alias(f"n_{BASE_RULES[i].kind}")
    return found.select(
        "doc_id",
        *[count(i) for i in range(len(BASE_RULES))],
        F.sha2(span_list("spans", len(BASE_RULES)), 256).alias("base_sha256"),
        span_list("spans", len(RULES)).alias("spans"),
    )


@query("op8_decontamination")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "seeds", "first_word", "equal")


@query("op10_jaccard")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=75, width=5)


@query("op9_quality")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "quality")


@query("op5_substrings")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), length=400, gap=128).select(
        "doc_id",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        "n_bytes",
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query("op2_telephony")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text as a mu-law, A-law or ADPCM file; the files and then their resampled PCM are stored, and each read back."""
    media = stored(encode_texts(table(spark, sf_dir, "documents")), "media", compression="zstd")
    # 8 kHz become 1 kHz: the files and the PCM together have to stay within 1.5 times the input.
    found = with_pcm_features(stored(decode_media(media, octaves=-3), "pcm", compression="zstd"))
    feature = F.format_string("coding:%d,rate:%d,pcm:%d/%d/%d/%08x", "coding", "rate", "level", "peak", "turns", "pcm_crc32")
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


_LINES_SQL = r"""
WITH units AS (
  SELECT doc_id, unnest(str_split(coalesce(text, ''), chr(10))) AS unit, generate_subscripts(str_split(coalesce(text, ''), chr(10)), 1) AS place FROM documents
), clean AS (
  SELECT *, trim(regexp_replace(lower(unit), '[ 	-
]+', ' ', 'g')) AS norm FROM units
), ranked AS (
  SELECT *, norm <> '' AND row_number() OVER (PARTITION BY norm ORDER BY doc_id NULLS LAST, place) > 1 AS gone,
    coalesce(sum(length(unit) + 1) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM clean
)
SELECT doc_id, CAST(count(*) FILTER (gone) AS BIGINT) AS n_removed,
  coalesce(string_agg(CAST(CAST(pos AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(pos + length(unit) AS BIGINT) AS VARCHAR), ',' ORDER BY place) FILTER (gone), '') AS removed,
  coalesce(string_agg(unit, chr(10) ORDER BY place) FILTER (NOT gone), '') AS text
FROM ranked GROUP BY doc_id
"""


@query("op6_lines", _LINES_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_units(table(spark, sf_dir, "documents"), "line")
    spans = F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return found.select("doc_id", F.size("removed").cast("long").alias("n_removed"), spans.alias("removed"), "text")


@query("op7_licenses")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no paths: they are laid out as source/lang/part/name, each tenth one as a licence file."""
    docs = table(spark, sf_dir, "documents")
    name = F.when(F.col("doc_id") % 10 == 0, F.lit("LICENSE")).otherwise(F.concat("doc_id", F.lit(".txt")))
    part = F.pmod(F.floor(F.col("doc_id") / 10), F.lit(1000)).cast("string")
    return scan_licenses(docs.select("doc_id", F.concat_ws("/", "source", "lang", part, name).alias("path"), "text"))


@query("op11_repair")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(damage(table(spark, sf_dir, "conversations")), missing="dropped")


@query("op12_spelling")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(table(spark, sf_dir, "documents"))


@query("op13_tokens")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
