"""Chat formatting with a grammar round trip.

A conversation is rendered turn by turn as

    ### Role: text</turn>\\n

and read by one deterministic parser: cut at every ``</turn>``; each part, after the newline that
follows a cut, begins with ``### ``; the role ends at the first ``: ``; what follows is the text; a
backslash stands for the character after it. A text or role that holds ``###`` is no sentence of
the grammar.

Each turn is first rendered as it is, parsed, and compared with its source. Turns that come back
different are rendered again with the control strings broken by backslashes, and those that still
differ also with their backslashes doubled, which always comes back. The whole conversation is
then parsed, and what is returned is read from that parse.

All of it is DataFrame expressions: one shuffle by conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import once

START, END = "### ", "</turn>"
#: Roles with a name of their own in the template; any other is written after "=".
ROLES = {"user": "User", "assistant": "Assistant", "system": "System"}
LEVELS = 3


def escape(text: Column, level: int) -> Column:
    """0: as it is; 1: control strings are broken; 2: backslashes are doubled first."""
    if level >= 2:
        text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    if level >= 1:
        # after the first no three of them stand together, however many there were
        for control, broken in (("##", "#\\#"), (END, "<\\/turn>")):
            text = F.replace(text, F.lit(control), F.lit(broken))
    return text


def unescape(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\\")), F.regexp_replace(text, r"(?s)\\(.)", "$1")).otherwise(text)


def _role_out(role: Column, level: int) -> Column:
    other = F.concat(F.lit("="), F.replace(escape(role, level), F.lit(": "), F.lit(": " if level == 0 else ":\\ ")))
    for plain, shown in ROLES.items():
        other = F.when(role == plain, F.lit(shown)).otherwise(other)
    return other


def _role_in(shown: Column) -> Column:
    role = unescape(F.substring(shown, F.lit(2), F.length(shown)))
    for plain, name in ROLES.items():
        role = F.when(shown == name, F.lit(plain)).otherwise(role)
    return role


def _render(role: Column, text: Column, level: int) -> Column:
    return F.concat(F.lit(START), _role_out(role, level), F.lit(": "), escape(text, level), F.lit(END + "\n"))


def _parse_turn(part: Column) -> Column:
    """struct(ok, role, text, raw) of what stands between the cuts, its newline removed."""
    rest = F.substring(part, F.lit(len(START) + 1), F.length(part))

    def of(rest: Column) -> Column:
        cut = F.instr(rest, F.lit(": "))
        shown, raw = F.substring(rest, F.lit(1), cut - 1), F.substring(rest, cut + 2, F.length(rest))
        ok = part.startswith(START) & (cut > 1) & ~F.contains(rest, F.lit("###"))
        return F.struct(ok.alias("ok"), _role_in(shown).alias("role"), unescape(raw).alias("text"), raw.alias("raw"))

    return once(rest, of)


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation, or null if it is no sentence of the grammar."""

    def of(parts: Column) -> Column:
        turns = F.transform(
            F.slice(parts, F.lit(1), F.size(parts) - 1),
            lambda p, k: _parse_turn(F.when(k > 0, F.substring(p, F.lit(2), F.length(p))).otherwise(p)),
        )
        closed = F.forall(F.slice(parts, F.lit(2), F.size(parts)), lambda p: p.startswith("\n")) & (F.element_at(parts, -1) == "\n")
        return once(turns, lambda t: F.when(closed & F.forall(t, lambda x: x["ok"]), t))

    return once(F.split(formatted, END, -1), of)


def _identical(rendered: Column, role: Column, text: Column) -> Column:
    def of(turns: Column) -> Column:
        return F.coalesce((F.size(turns) == 1) & (turns[0]["role"] == role) & (turns[0]["text"] == text), F.lit(False))

    return once(parse(rendered), of)


def format_turn(role: Column, text: Column) -> Column:
    """The first rendering, from least to most escaped, that parses to exactly this turn."""

    def of(level: int) -> Column:
        rendered = _render(role, text, level)
        if level == LEVELS - 1:
            return rendered
        return once(rendered, lambda r: F.when(_identical(r, role, text), r).otherwise(of(level + 1)))

    return of(0)


def format_chat(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    learn: str = "assistant",
) -> DataFrame:
    """Per conversation: ``conv_col``, formatted, turns (array of role, text), loss_spans.

    ``turns`` are those read back from ``formatted``. ``loss_spans`` is the loss mask: (start, end)
    of each text of the ``learn`` role in ``formatted``, in code points, end exclusive. A
    conversation that would not come back fails the job.

    Null roles and texts count as empty; rows with equal turns follow in order of role and text, a
    null turn first; repeated rows are turns of their own; a null conversation is one; other
    columns play no part; an empty table gives an empty one. A conversation becomes one row, so
    its rows meet in one task, however many it has.
    """
    rows = turns.select(
        F.col(conv_col).alias("c"), F.col(turn_col).alias("k"),
        F.coalesce(F.col(role_col), F.lit("")).alias("r"), F.coalesce(F.col(text_col), F.lit("")).alias("t"),
    ).withColumn("f", format_turn(F.col("r"), F.col("t")))
    order = Window.partitionBy("c").orderBy("k", "r", "t")
    before = F.coalesce(F.sum(F.length("f")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # the text stands between the first ": " and the end mark
    span = F.struct(
        (before + F.instr("f", F.lit(": ")) + 1).alias("start"), (before + F.length("f") - len(END) - 1).alias("end")
    )
    rows = rows.select("c", "r", "t", "f", F.row_number().over(order).alias("n"), span.alias("s"))
    formatted = (
        rows.groupBy("c")
        .agg(F.sort_array(F.collect_list(F.struct("n", "r", "t", "f", "s"))).alias("x"))
        .select(
            "c", F.concat_ws("", F.transform("x", lambda x: x["f"])).alias("formatted"),
            F.transform("x", lambda x: F.struct(x["r"].alias("role"), x["t"].alias("text"))).alias("source"),
            F.transform(F.filter("x", lambda x: x["r"] == learn), lambda x: x["s"]).alias("loss_spans"),
        )
    )
    read = formatted.withColumn(
        "turns", F.transform(parse(F.col("formatted")), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    )
    lost = F.raise_error(F.concat(F.lit("this conversation does not come back: "), F.coalesce(F.col("c").cast("string"), F.lit("null"))))
    return read.select(
        F.col("c").alias(conv_col), "formatted",
        F.when(F.col("turns") == F.col("source"), F.col("turns")).otherwise(lost).alias("turns"), "loss_spans",
    )
