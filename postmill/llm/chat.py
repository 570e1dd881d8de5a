"""Chat formatting in DataFrame expressions only.

Turns are collected per conversation as structs, sorted, and adjacent turns of one role become one block with array
functions; every step is linear in the turns. Template of a block::

    ### <role>: <text></part><text>...</turn>\\n

Inside texts and roles the characters of the control strings are written as escapes (backslash e, h, l and c), so
neither ``###`` nor ``</`` can appear there and reading back is exact. ``segments`` holds the output in pieces with
their loss flag; only the texts of ``loss_role`` carry loss.

Defined cases: null text or role is empty; a null conv_id is one conversation; equal turn numbers go by role, then
text; repeated rows are repeated turns; an empty table gives no rows; other columns are ignored. A conversation is one
value and so one task's work: its bound is what one text column holds (2 GB), null conv_ids together included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Escapes in the order of writing; reading goes the other way round.
ESCAPES = (("\\", "\\e"), ("#", "\\h"), ("<", "\\l"))
HEAD, COLON, PART, END = "### ", ": ", "</part>", "</turn>\n"


def escape(text: Column) -> Column:
    for plain, written in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column) -> Column:
    for plain, written in reversed(ESCAPES):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def format_chats(rows: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, segments array<struct<text, loss>>."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    last = F.size("turns") - 1
    starts = F.filter(F.sequence(F.lit(0), last), lambda i: ~F.get("turns", i)["role"].eqNullSafe(F.get("turns", i - 1)["role"]))
    chats = chats.withColumn("starts", starts)
    after = lambda k: F.coalesce(F.get("starts", k + 1), F.size("turns"))
    blocks = F.transform("starts", lambda s, k: F.slice("turns", s + 1, after(k) - s))
    chats = chats.withColumn("blocks", blocks)

    def pieces(block: Column) -> Column:
        role = block[0]["role"]
        head = F.struct(F.concat(F.lit(HEAD), F.replace(escape(role), F.lit(":"), F.lit("\\c")), F.lit(COLON)).alias("text"), F.lit(False).alias("loss"))
        end = F.size(block) - 1
        body = F.transform(
            block,
            lambda t, i: F.array(
                F.struct(escape(t["text"]).alias("text"), (role == loss_role).alias("loss")),
                F.struct(F.when(i == end, F.lit(END)).otherwise(F.lit(PART)).alias("text"), F.lit(False).alias("loss")),
            ),
        )
        return F.concat(F.array(head), F.flatten(body))

    out = chats.select("conv_id", F.flatten(F.transform("blocks", pieces)).alias("segments"))
    return out.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_chats(formatted: DataFrame) -> DataFrame:
    """conv_id, turns array<struct<role, text>>, loss_text, formatted: read from what format_chats wrote."""
    blocks = F.filter(F.split("formatted", END, -1), lambda b: b != "")

    def turns(block: Column) -> Column:
        at = F.locate(COLON, block)
        role = unescape(F.replace(F.substring(block, F.lit(len(HEAD) + 1), at - len(HEAD) - 1), F.lit("\\c"), F.lit(":")))
        body = F.substring(block, at + len(COLON), F.length(block))
        return F.transform(F.split(body, PART, -1), lambda p: F.struct(role.alias("role"), unescape(p).alias("text")))

    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    return formatted.select("conv_id", F.flatten(F.transform(blocks, turns)).alias("turns"), loss.alias("loss_text"), "formatted")
