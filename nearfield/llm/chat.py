"""Chat formatting with a grammar round trip.

``format_conversations`` renders each conversation to one string, reparses it with a deterministic parser
made of SQL functions, compares the recovered turns with the source and escapes conflicting content until
both are identical.  All steps are DataFrame functions.

Grammar (fixed control strings)::

    conversation := "<s>" turn*
    turn         := "[INST] " text " [/INST]"                     role user
                  | "[ANS] " text " </s>"                         role assistant (its text is the loss mask)
                  | "[SYS] " text " [/SYS]"                       role system
                  | "[TURN] " role " [TEXT] " text " [/TURN]"     any other role

A control string inside a text or role gets one backslash after its first character; one that already has
backslashes there gets one more.  The parser drops one again, so the escape is a bijection and is the
identity on texts without control strings.

Defined results: a null text is empty; a null role is the empty role; turns go by (turn, role, text), null
turns first, and repeated rows are repeated turns; rows with a null conv_id form one conversation; an empty
table gives no conversation; other columns of the input, whatever their names, are ignored.  A conversation
is one output string, so it is the unit of memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Role, opening and closing control string.
TEMPLATE = (("user", "[INST]", "[/INST]"), ("assistant", "[ANS]", "</s>"), ("system", "[SYS]", "[/SYS]"))
START, OTHER_OPEN, OTHER_TEXT, OTHER_CLOSE = "<s>", "[TURN]", "[TEXT]", "[/TURN]"
CONTROL = r"</?s>|\[/?(?:INST|ANS|SYS|TURN|TEXT)\]"
#: First character, backslashes, rest of a control string.
CONFLICT = r"([<\[])(\\*)(/?s>|/?(?:INST|ANS|SYS|TURN|TEXT)\])"
ESCAPED = r"([<\[])\\(\\*)(/?s>|/?(?:INST|ANS|SYS|TURN|TEXT)\])"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, CONFLICT, r"$1\\$2$3")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, ESCAPED, "$1$2$3")


def render(turns: Column, escaped: bool) -> Column:
    """The formatted string of an array of structs (role, text)."""
    safe = escape if escaped else (lambda c: c)

    def one(t: Column) -> Column:
        text = safe(t["text"])
        out = F.concat(F.lit(f"{OTHER_OPEN} "), safe(t["role"]), F.lit(f" {OTHER_TEXT} "), text, F.lit(f" {OTHER_CLOSE}"))
        for role, opening, closing in TEMPLATE:
            out = F.when(t["role"] == role, F.concat(F.lit(f"{opening} "), text, F.lit(f" {closing}"))).otherwise(out)
        return out

    return F.concat(F.lit(START), F.array_join(F.transform(turns, one), ""))


def parse(formatted: Column) -> Column:
    """The turns (role, text) that the deterministic parser recovers from a formatted string."""
    marks = F.regexp_extract_all(formatted, F.lit(CONTROL), F.lit(0))
    pieces = F.split(formatted, CONTROL, -1)
    openings = [o for _, o, _ in TEMPLATE] + [OTHER_TEXT]
    inner = lambda p: unescape(p.substr(F.lit(2), F.length(p) - 2))  # noqa: E731  without the space on each side

    # mark i stands between pieces i and i+1; zipped, each array is made once and not again for each element
    cells = F.arrays_zip(marks, pieces, F.slice(pieces, 2, F.size(pieces)))
    opened = F.filter(cells, lambda c: c["0"].isin(openings))

    def one(c: Column) -> Column:
        role = inner(c["1"])
        for name, opening, _ in TEMPLATE:
            role = F.when(c["0"] == opening, F.lit(name)).otherwise(role)
        return F.struct(role.alias("role"), inner(c["2"]).alias("text"))

    return F.transform(opened, one)


def format_conversations(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, turns (as read back from it), escaped, identical."""
    rows = conversations.select(
        F.col("conv_id"),
        F.struct(F.col("turn").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"),
    )
    source = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts")).select("conv_id", F.transform("ts", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"))
    raw = source.withColumn("raw", render(F.col("source"), False))
    tried = raw.withColumn("escaped", ~parse(F.col("raw")).eqNullSafe(F.col("source")))
    made = tried.select("conv_id", "source", "escaped", F.when(F.col("escaped"), render(F.col("source"), True)).otherwise(F.col("raw")).alias("formatted"))
    back = made.withColumn("turns", parse(F.col("formatted")))
    return back.select("conv_id", "formatted", "turns", "escaped", F.col("turns").eqNullSafe(F.col("source")).alias("identical"))


def digest(formatted: DataFrame) -> DataFrame:
    """Figures of each conversation, from what the parser read back."""
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    return formatted.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "escaped",
        "identical",
    )
