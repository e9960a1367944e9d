"""Chat formatting with a grammar round trip, in DataFrame expressions only.

Grammar::

    conversation := turn*
    turn         := "<turn>" role "\\n" text "</turn>\\n"

where neither role nor text holds ``<turn>`` or ``</turn>`` and a role holds no line end. In a text
one backslash is taken out of ``<\\turn>``, ``<\\\\/turn>`` and so on when it is read; in a role
``\\\\`` and ``\\n`` stand for a backslash and a line end. Every turn is first written as it is and
parsed again; if what comes back differs from the source, its role and text are escaped (a
backslash goes into each control string and into what looks like an escaped one). The whole
conversation is then parsed and compared once more, and must be identical.

Cases: a null role or text is an empty one; turns are ordered by turn number, then role, then
text, null numbers first; repeated rows are turns of their own; rows without a conversation id
are one conversation; other columns are not read. A conversation is one value, so its turns meet
in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOSS_ROLE = "assistant"
_CONTROL = r"<(\\*)(/?turn>)"
_ESCAPED = r"<\\(\\*)(/?turn>)"


def escape_text(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"<\\$1$2")


def unescape_text(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "<$1$2")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape_text(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    pieces = F.transform(F.split(role, r"\\\\", -1), lambda p: F.replace(p, F.lit("\\n"), F.lit("\n")))
    return unescape_text(F.array_join(pieces, "\\"))


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<turn>"), role, F.lit("\n"), text, F.lit("</turn>\n"))


def parse(rendered: Column) -> Column:
    """array<struct<role, text, raw>> of a rendered conversation; ``raw`` is the text as written.
    A part that is not a turn of the grammar has nulls."""
    def turn(part):
        body = F.substr(part, F.lit(len("<turn>") + 1))
        cut = F.instr(body, "\n")
        good = part.startswith("<turn>") & ~body.contains("<turn>") & ~body.contains("</turn>") & (cut > 0)
        raw = F.when(good, F.substr(body, cut + 1))
        return F.struct(F.when(good, unescape_role(F.substr(body, F.lit(1), cut - 1))).alias("role"), unescape_text(raw).alias("text"), raw.alias("raw"))

    parts = F.split(rendered, "</turn>\n", -1)
    return F.transform(F.slice(parts, 1, F.size(parts) - 1), turn)


def _same(parsed: Column, turns: Column) -> Column:
    keep = lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))
    return F.transform(parsed, keep).eqNullSafe(F.transform(turns, keep))


def format_turns(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with ``rendered``, the turn as the grammar writes it, and
    ``escaped``, whether that needed escapes."""
    d = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("plain", render_turn(F.col("role"), F.col("text")))
    back = F.get(parse(F.col("plain")), F.lit(0))
    d = d.withColumn("back", F.when(F.size(parse(F.col("plain"))) == 1, back))
    d = d.withColumn("escaped", ~(F.col("back.role").eqNullSafe(F.col("role")) & F.col("back.text").eqNullSafe(F.col("text"))))
    rendered = F.when(F.col("escaped"), render_turn(escape_role(F.col("role")), escape_text(F.col("text")))).otherwise(F.col("plain"))
    return d.select("conv_id", "turn", "role", "text", "escaped", rendered.alias("rendered"))


def format_conversations(rows: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """Per conversation: ``conv_id``, ``formatted``, ``n_escaped`` turns and ``loss_runs``: lengths of
    consecutive stretches of ``formatted`` in code points, with whether they bear loss (a head, a
    text and an end for each turn; only texts of ``loss_role`` do)."""
    turns = format_turns(rows)
    all_turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text", "rendered", "escaped")))
    d = turns.groupBy("conv_id").agg(all_turns.alias("turns"))
    d = d.withColumn("formatted", F.array_join(F.transform("turns", lambda t: t["rendered"]), ""))
    d = d.withColumn("back", parse(F.col("formatted")))
    wrong = ~_same(F.col("back"), F.col("turns"))
    d = d.withColumn("formatted", F.when(wrong, F.raise_error(F.lit("a formatted conversation does not parse back to its turns"))
                                         .cast("string")).otherwise(F.col("formatted")))
    runs = F.flatten(F.transform("turns", lambda t, i: F.array(
        F.struct((F.length(t["rendered"]) - F.length(F.get(F.col("back"), i)["raw"]) - len("</turn>\n")).alias("length"), F.lit(False).alias("loss")),
        F.struct(F.length(F.get(F.col("back"), i)["raw"]).alias("length"), (t["role"] == loss_role).alias("loss")),
        F.struct(F.lit(len("</turn>\n")).alias("length"), F.lit(False).alias("loss")))))
    return d.select("conv_id", "formatted", F.size(F.filter("turns", lambda t: t["escaped"])).alias("n_escaped"), runs.alias("loss_runs"))


def read_back(formatted: DataFrame) -> DataFrame:
    """From ``format_conversations``: ``conv_id``, ``turns`` (role, text) and ``loss_text``, all text
    under the mask, unescaped, in order. A run that does not fit its turn is an error."""
    d = formatted.select("conv_id", "formatted", "loss_runs", parse(F.col("formatted")).alias("turns"))
    fits = (F.size("loss_runs") == 3 * F.size("turns")) & F.forall(
        F.transform("turns", lambda t, i: F.get(F.col("loss_runs"), 3 * i + 1)["length"] == F.length(t["raw"])), lambda x: x)
    under = F.filter("turns", lambda t, i: F.get(F.col("loss_runs"), 3 * i + 1)["loss"])
    text = F.array_join(F.transform(under, lambda t: t["text"]), "")
    return d.select("conv_id", "formatted", "turns", F.when(fits, text).otherwise(
        F.raise_error(F.lit("the loss mask does not fit the text")).cast("string")).alias("loss_text"))
