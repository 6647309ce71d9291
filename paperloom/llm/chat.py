"""Chat formatting from a declarative template, with a state machine over roles and loss flags."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks, the roles that carry loss, and the role order as a state machine.

    ``moves`` maps a state to the roles it takes; the state after a turn is its role.
    A conversation is valid if every turn is a move and it ends in ``final``.
    """

    open: str = "<|im_start|>"
    after_role: str = "\n"
    close: str = "<|im_end|>\n"
    newline_in_role: str = "<|nl|>"
    loss_roles: tuple[str, ...] = ("assistant",)
    moves: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "start": ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user",),
        }
    )
    final: tuple[str, ...] = ("assistant",)


def escaped(text: Column) -> Column:
    r"""Text that holds no ``<|``: ``\`` is doubled, then ``<|`` becomes ``<\|``."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(.)", "$1")


def format_chats(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per conversation: (conv_id, valid, text, segments).

    ``segments`` is an array of (text, loss) whose texts joined are ``text``. Turns go by
    turn number (null first), ties by role and then text. Null roles and texts are empty;
    a null conv_id is a conversation of its own. Repeated rows are repeated turns. Turns
    out of the template's order are formatted all the same, with valid = false. An empty
    table gives no rows; other columns are not read. A conversation becomes one output
    row, so its length is bounded by what a row can hold.
    """
    t = template
    blank = F.lit("")
    turn = F.struct("turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
    talks = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    steps = F.create_map(*[F.lit(x) for state, roles in t.moves.items() for role in roles for x in (f"{state}>{role}", role)])
    state = F.aggregate(
        "turns", F.lit("start"), lambda s, x: F.coalesce(F.try_element_at(steps, F.concat(s, F.lit(">"), x["role"])), F.lit("invalid"))
    )

    def segments(x: Column) -> Column:
        role = F.replace(escaped(x["role"]), F.lit("\n"), F.lit(t.newline_in_role))
        return F.array(
            F.struct(F.concat(F.lit(t.open), role, F.lit(t.after_role)).alias("text"), F.lit(False).alias("loss")),
            F.struct(escaped(x["text"]).alias("text"), x["role"].isin(*t.loss_roles).alias("loss")),
            F.struct(F.lit(t.close).alias("text"), F.lit(False).alias("loss")),
        )

    return talks.select(
        "conv_id", state.isin(*t.final).alias("valid"), F.flatten(F.transform("turns", segments)).alias("segments")
    ).select("conv_id", "valid", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("text"), "segments")


def read_chats(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """The turns back from the formatted text: (conv_id, valid, text, segments, turns of (role, text))."""
    t = template
    blocks = F.filter(F.split("text", f"\\Q{t.close}\\E", -1), lambda b: b != "")

    def turn(block: Column) -> Column:
        body = F.substring(block, F.lit(len(t.open) + 1), F.length(block))
        cut = F.instr(body, t.after_role)
        role = F.replace(F.substring(body, F.lit(1), cut - 1), F.lit(t.newline_in_role), F.lit("\n"))
        text = F.substring(body, cut + len(t.after_role), F.length(body))
        return F.struct(unescaped(role).alias("role"), unescaped(text).alias("text"))

    return formatted.withColumn("turns", F.transform(blocks, turn))


def loss_text(segments: str = "segments") -> Column:
    """All text under the loss mask, unescaped."""
    kept = F.filter(F.col(segments), lambda s: s["loss"])
    return F.array_join(F.transform(kept, lambda s: unescaped(s["text"])), "")
