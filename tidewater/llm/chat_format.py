"""Chat formatting with Spark expressions only: sort turn structs, merge adjacent turns of a role, concatenate.

One group-by gathers the turns of a conversation; everything else is array expressions.  A merged turn is
one block ``<|role:NAME|>text<|end|>``; the rows it was merged from stay apart by ``<|also|>``, so the
output can be read back row by row.  Control strings inside texts and role names get a backslash after
their first character, and backslashes are doubled, so no text can forge a mark and ``unescape`` restores it.

Defined results: null text is the empty text, null role the empty role; rows sort by (turn, role, text),
null turns first; repeated rows stay repeated turns; rows with a null conv_id form one conversation of
their own; an empty table gives an empty table.  A conversation is one output record, so its rows meet in
one task by definition; conversations of any number spread by conv_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROLE, MID, ALSO, END = "<|role:", "|>", "<|also|>", "<|end|>\n"
# Strings that must not appear unescaped inside a text: this template's marks and common chat marks.
CONTROL = ["<|", "|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]


def escape(c: Column) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for s in CONTROL:
        c = F.replace(c, F.lit(s), F.lit(s[0] + "\\" + s[1:]))
    return c


def unescape(c: Column) -> Column:
    for s in reversed(CONTROL):
        c = F.replace(c, F.lit(s[0] + "\\" + s[1:]), F.lit(s))
    return F.replace(c, F.lit("\\\\"), F.lit("\\"))


def format_chats(rows: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, n_turns, formatted, loss_spans (start, length in code points of ``formatted``).

    A loss span covers exactly the escaped text of one row of ``loss_role``.
    """
    turns = rows.select(
        F.col("conv_id").alias("__c"),
        F.struct(F.col("turn").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"),
                 F.coalesce(F.col("text"), F.lit("")).alias("text")).alias("__t"))
    got = turns.groupBy("__c").agg(F.sort_array(F.collect_list("__t")).alias("__t"))
    t = F.col("__t")
    # Role of the row before and after each row; the lists are shifted, so no lookups by place.
    n = F.size(t)
    roles = t["role"]
    before = F.concat(F.array(F.lit(None).cast("string")), F.slice(roles, F.lit(1), n - 1))
    after = F.concat(F.slice(roles, F.lit(2), F.greatest(n - 1, F.lit(0))), F.array(F.lit(None).cast("string")))
    shifted = got.select("__c", "__t", before.alias("__b"), after.alias("__a"))
    parts = shifted.select("__c", F.transform(
        F.arrays_zip(F.col("__t").alias("t"), F.col("__b").alias("b"), F.col("__a").alias("a")),
        lambda x: F.struct(
            F.when(x["b"] == x["t"]["role"], F.lit(ALSO))
            .otherwise(F.concat(F.lit(ROLE), escape(x["t"]["role"]), F.lit(MID))).alias("head"),
            escape(x["t"]["text"]).alias("body"),
            F.when(x["a"] == x["t"]["role"], F.lit("")).otherwise(F.lit(END)).alias("tail"),
            (x["t"]["role"] == loss_role).alias("loss"))).alias("__p"))
    p = F.col("__p")
    text = F.array_join(F.transform(p, lambda x: F.concat(x["head"], x["body"], x["tail"])), "")
    # Running place of each body: an array aggregation over the lengths.
    spans = F.aggregate(
        p, F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["head"]) + F.length(x["body"]) + F.length(x["tail"])).alias("at"),
            F.when(x["loss"], F.concat(acc["spans"], F.array(F.struct(
                (acc["at"] + F.length(x["head"])).alias("start"), F.length(x["body"]).alias("length")))))
            .otherwise(acc["spans"]).alias("spans")),
        lambda acc: acc["spans"])
    return parts.select(F.col("__c").alias("conv_id"), F.size(p).cast("long").alias("n_turns"),
                        text.alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text), loss_text: parsed from ``formatted`` and ``loss_spans`` alone."""
    blocks = F.filter(F.split(F.col("formatted"), r"<\|end\|>\n"), lambda b: b.startswith(ROLE))
    rows = F.flatten(F.transform(blocks, lambda b: F.transform(
        F.split(F.substr(b, F.instr(b, MID) + len(MID)), r"<\|also\|>"),
        lambda x: F.struct(unescape(F.substr(b, F.lit(len(ROLE) + 1), F.instr(b, MID) - 1 - len(ROLE))).alias("role"),
                           unescape(x).alias("text")))))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(
        F.substr(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    return formatted.select("conv_id", "formatted", rows.alias("turns"), loss.alias("loss_text"))
