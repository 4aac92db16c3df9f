"""Chat formatting: a finite-state machine over roles and a declarative template.

Built-in column expressions only.  A template names the turn marks, the roles
whose text is trained on, and the allowed role after each role.  Each
conversation becomes a list of text segments with a loss flag; the formatted
string is their concatenation.  Texts are escaped, so no text can hold a mark,
and ``read_back`` recovers turns and trained text from the string alone.

Escape: the escape character is doubled into ``\\s``, and a mark's opening
``<|`` becomes ``<\\p``; a role also has its line ends written ``\\n``.

Defined cases: null text counts as empty, a null role as the role "" (never
valid); rows are ordered by (turn, role, text), nulls first, so repeated turns
have a fixed order; a null conv_id is a conversation of its own; conversations
whose roles break the machine are formatted all the same, with ``valid`` false
and ``bad_turn`` the position (from 0) of the first turn refused.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Turn marks, trained roles and the role machine (state = last role, "" at the start)."""

    opening: str = "<|turn|>"
    after_role: str = "\n"
    closing: str = "<|end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        "": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final: tuple[str, ...] = ("user", "assistant")


CHATML = Template()


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\s")), F.lit("<|"), F.lit("<\\p"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\p"), F.lit("<|")), F.lit("\\s"), F.lit("\\"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))


def _next_ok(template: Template, state: Column, role: Column) -> Column:
    """Whether the machine moves from ``state`` on ``role``."""
    ok = F.lit(False)
    for source, targets in template.follows.items():
        ok = ok | ((state == source) & role.isin(list(targets)))
    return ok


def format_conversations(turns: DataFrame, template: Template = CHATML) -> DataFrame:
    """(conv_id, segments array<struct<text, loss>>, formatted, valid, bad_turn) of rows (conv_id, turn, role, text)."""
    rows = turns.select(
        "conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("row"))
    ordered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("turns"))

    def segments(row: Column) -> Column:
        mark = lambda text: F.struct(text.alias("text"), F.lit(False).alias("loss"))
        return F.array(
            mark(F.concat(F.lit(template.opening), _escape_role(row["role"]), F.lit(template.after_role))),
            F.struct(escape(row["text"]).alias("text"), row["role"].isin(list(template.loss_roles)).alias("loss")),
            mark(F.lit(template.closing)),
        )

    def step(state: Column, row: Column) -> Column:
        ok = (state["bad"] < 0) & ~_next_ok(template, state["role"], row["role"])
        return F.struct((state["at"] + 1).alias("at"), row["role"].alias("role"), F.when(ok, state["at"]).otherwise(state["bad"]).alias("bad"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("role"), F.lit(-1).alias("bad"))
    machine = F.aggregate("turns", start, step)
    return (
        ordered.select("conv_id", F.flatten(F.transform("turns", segments)).alias("segments"), machine.alias("machine"))
        .select(
            "conv_id", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
            ((F.col("machine.bad") < 0) & F.col("machine.role").isin(list(template.final))).alias("valid"),
            F.when(F.col("machine.bad") >= 0, F.col("machine.bad")).alias("bad_turn"),
        )
    )


def read_back(formatted: DataFrame, template: Template = CHATML, column: str = "formatted") -> DataFrame:
    """Add ``turns`` array<struct<role, text>> and ``loss_texts``, parsed from the formatted string alone."""
    split = F.slice(F.split(F.col(column), _literal(template.opening), -1), 2, 2**30)

    def turn(part: Column) -> Column:
        at = F.instr(part, template.after_role)
        role = F.substring(part, F.lit(1), at - 1)
        text = F.substring(part, at + len(template.after_role), F.char_length(part) - at - (len(template.after_role) + len(template.closing) - 1))
        return F.struct(_unescape_role(role).alias("role"), unescape(text).alias("text"))

    return formatted.withColumn("turns", F.transform(split, turn)).withColumn(
        "loss_texts", F.transform(F.filter("turns", lambda t: t["role"].isin(list(template.loss_roles))), lambda t: t["text"]))


def _literal(text: str) -> str:
    return "\\Q" + text + "\\E"


def digests(turns: DataFrame, template: Template = CHATML) -> DataFrame:
    """Digest columns of every conversation, read back from the formatted string; text under loss comes from the segments."""
    back = read_back(format_conversations(turns, template), template)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    trained = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.char_length(trained).cast("long").alias("loss_chars"), F.sha2(trained, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"), "valid", "bad_turn",
    )


def with_probe(conversations: DataFrame) -> DataFrame:
    """``conversations`` plus conversation -7, whose two texts are control strings of a well-known template."""
    probe = conversations.sparkSession.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)
