"""Chat formatting with a grammar round trip, in DataFrame functions alone.

Grammar of a formatted conversation (blocks follow each other without anything between):

    conversation := block*
    block        := "### " name ":" " "  plain   "</turn>\\n"      text as it is
                  | "### " name ":" "\\ " escaped "</turn>\\n"      text with escapes

`name` is always escaped. An escape is a backslash before one character: every backslash, the slash of `</turn>` and
the last `#` of `### ` get one, so no control string survives inside escaped content, and dropping the backslash before each
escaped character restores it. Parsing cuts at the terminator and reads the header: no search, no choice.

A block is first rendered plain. The parser reads it back; where the turn is not the one that was put in, the text is
escaped. The whole conversation is then parsed and compared with its source; where it differs all its blocks are escaped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

END = "</turn>\n"
_HEAD = r"(?s)^### ([^\\:]*+(?:\\.[^\\:]*+)*+):(\\?) (.*)$"  # possessive: no way back, so no stack however long the name


def escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit("</turn>"), F.lit("<\\/turn>"))
    return F.replace(out, F.lit("### "), F.lit("##\\# "))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _name(role: Column) -> Column:
    return F.replace(escaped(role), F.lit(":"), F.lit("\\:"))


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: array<struct<role, text>>; a block that is none becomes a null role."""
    blocks = F.filter(F.split(formatted, END, -1), lambda b: b != "")
    return F.transform(blocks, lambda b: F.struct(
        F.when(b.rlike(_HEAD), unescaped(F.regexp_extract(b, _HEAD, 1))).alias("role"),
        F.when(F.regexp_extract(b, _HEAD, 2) == "", F.regexp_extract(b, _HEAD, 3))
        .otherwise(unescaped(F.regexp_extract(b, _HEAD, 3))).alias("text")))


def format_chats(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                 learn: str = "assistant") -> DataFrame:
    """One row per conversation: conv, formatted, mask (array<struct<start, length>> over code points of `formatted`, the
    texts of role `learn`), turns (as parsed back), identical.

    Turns go by (turn, role, text), nulls first; equal rows stay, each as a block. Null role or text: empty. A null
    conversation id is a conversation. No rows: no conversations. Other columns, whatever their names, are not read.
    A conversation is one row by definition, so its turns meet in one task; they arrive rendered and are only joined.
    """
    source = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("at"),
                          F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    head = F.concat(F.lit("### "), _name(F.col("role")), F.lit(":"))
    source = source.withColumns({
        "plain": F.concat(head, F.lit(" "), F.col("text"), F.lit(END)),
        "safe": F.concat(head, F.lit("\\ "), escaped(F.col("text")), F.lit(END)),
    })
    same = F.size(parse(F.col("plain"))) == 1
    back = parse(F.col("plain"))[0]
    same = same & (back["role"] == F.col("role")) & (back["text"] == F.col("text"))
    blocks = source.select("conv", "at", "role", "text", "safe", F.when(same, F.col("plain")).otherwise(F.col("safe")).alias("block"))

    order = Window.partitionBy("conv").orderBy("at", "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    numbered = blocks.withColumns({
        "n": F.row_number().over(order),
        "from": F.coalesce(F.sum(F.length("block")).over(before), F.lit(0)),
        "safe_from": F.coalesce(F.sum(F.length("safe")).over(before), F.lit(0)),
    })
    mine = F.col("role") == learn
    # "### " + name + ":" + " " or "\ "; the content lies between that and the terminator
    width = F.length(_name(F.col("role"))) + 6

    def mask(start: str, block: str) -> Column:
        shift = width + F.when(F.substr(F.col(block), width, F.lit(1)) == "\\", 1).otherwise(0)
        return F.when(mine, F.struct(
            (F.col(start) + shift).cast("long").alias("start"),
            (F.length(block) - shift - len(END)).cast("long").alias("length"),
            (F.substr(F.col(block), width, F.lit(1)) == "\\").alias("escaped")))

    gathered = numbered.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct(
        "n", "role", "text", "block", "safe", mask("from", "block").alias("mask"), mask("safe_from", "safe").alias("safe_mask")))).alias("t"))
    first = gathered.select("conv", "t", F.array_join(F.transform("t", lambda t: t["block"]), "").alias("formatted"))
    wanted = F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    good = parse(F.col("formatted")) == wanted
    chosen = first.select("conv", "t", good.alias("good"), F.when(good, F.col("formatted")).otherwise(
        F.array_join(F.transform("t", lambda t: t["safe"]), "")).alias("formatted"))
    masks = F.when(F.col("good"), F.transform("t", lambda t: t["mask"])).otherwise(F.transform("t", lambda t: t["safe_mask"]))
    return chosen.select(
        F.col("conv").alias(conv), "formatted", F.filter(masks, lambda m: m.isNotNull()).alias("mask"),
        parse(F.col("formatted")).alias("turns"), (parse(F.col("formatted")) == wanted).alias("identical"))


def learned_text(chats: DataFrame) -> Column:
    """All text under the mask, read back from the formatted string, unescaped, in order, nothing between."""
    return F.array_join(F.transform("mask", lambda m: F.when(
        m["escaped"], unescaped(F.substr(F.col("formatted"), (m["start"] + 1).cast("int"), m["length"].cast("int")))
    ).otherwise(F.substr(F.col("formatted"), (m["start"] + 1).cast("int"), m["length"].cast("int")))), "")
