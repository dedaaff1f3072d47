"""Chat formatting: turns to one marked string per conversation, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The template.  A block opens with its role's mark, holds the texts of one or more turns
# parted by TURN, and ends with its role's closing mark.  Roles without marks of their own
# are named: [ROLE]name[TEXT]...[/ROLE].
MARKS = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER, NAMED, OTHER_END = "[ROLE]", "[TEXT]", "[/ROLE]"
TURN = "[TURN]"
# No control string holds "[" or "<" but at its start, so none can overlap another.
CONTROL = r"(/?(?:SYS|INST|ROLE)\]|TEXT\]|TURN\]|/?s>)"
OPENS = r"\[SYS\]|\[INST\]|<s>|\[ROLE\]"
CLOSES = r"\[/SYS\]|\[/INST\]|</s>|\[/ROLE\]"


def escape(text: Column) -> Column:
    """Put a backslash after the first character of every control string, and of every string
    that has some backslashes there already; ``unescape`` takes one away again."""
    return F.regexp_replace(text, r"([\[<])(\\*)" + CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\[<])\\(\\*)" + CONTROL, "$1$2$3")


def _mark(role: Column, closing: bool) -> Column:
    mark = F.lit(OTHER_END) if closing else F.concat(F.lit(OTHER), escape(role), F.lit(NAMED))
    for name, pair in MARKS.items():
        mark = F.when(role == name, F.lit(pair[closing])).otherwise(mark)
    return mark


def format_chat(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn",
                role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: (conv_id, n_turns, formatted, loss_spans).

    Turn structs are collected and sorted by (turn, role, text), nulls first; turns of one
    role in a row are merged into one block by an array aggregation.  ``loss_spans`` are the
    (start, length) in code points of every assistant text inside ``formatted``.

    A null text or role reads as empty; repeated rows are kept; other columns are ignored.
    Rows without a conv_id belong to no conversation: each is formatted alone, with a null
    conv_id.  An empty table gives none.  A conversation is one output value, so it must fit
    into a task; the copies of one text in many conversations do not meet.
    """
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
                   F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = turns.select(F.col(conv_id).alias("conv_id"), one.alias("one"))
    whole = (rows.filter("conv_id IS NOT NULL").groupBy("conv_id")
             .agg(F.sort_array(F.collect_list("one")).alias("turns"))
             .unionByName(rows.filter("conv_id IS NULL").select("conv_id", F.array("one").alias("turns"))))
    # escaped texts; a turn starts a block unless the one before has its role
    whole = whole.withColumn("t", F.transform("turns", lambda x: F.struct(
        x.role.alias("role"), escape(x.text).alias("text"))))
    t = F.col("t")
    whole = whole.withColumn("starts", F.filter(
        F.sequence(F.lit(0), F.size(t) - 1),
        lambda i: (i == 0) | (t[i].role != t[F.greatest(i - 1, F.lit(0))].role)))
    starts = F.col("starts")

    def block(first: Column, k: Column) -> Column:
        until = F.when(k + 1 < F.size(starts), starts[F.least(k + 1, F.size(starts) - 1)]).otherwise(F.size(t))
        return F.struct(t[first].role.alias("role"), F.slice(t, first + 1, until - first).alias("turns"))

    whole = whole.withColumn("blocks", F.transform("starts", block))

    def merged(b: Column) -> Column:
        body = F.aggregate(b.turns, F.lit(None).cast("string"), lambda acc, x: F.when(
            acc.isNull(), x.text).otherwise(F.concat(acc, F.lit(TURN), x.text)))
        return F.concat(_mark(b.role, False), body, _mark(b.role, True))

    def span_ends(pos: Column, b: Column) -> Column:
        """Walk one block: the position after it, and the spans of its texts if they are learned."""
        inside = F.aggregate(
            b.turns, F.struct((pos.pos + F.length(_mark(b.role, False))).alias("pos"), pos.spans.alias("spans")),
            lambda acc, x: F.struct(
                (acc.pos + F.length(x.text) + len(TURN)).alias("pos"),
                F.when(b.role == "assistant", F.concat(acc.spans, F.array(F.struct(
                    acc.pos.alias("start"), F.length(x.text).alias("length"))))).otherwise(acc.spans).alias("spans")))
        return F.struct((inside.pos - len(TURN) + F.length(_mark(b.role, True))).alias("pos"),
                        inside.spans.alias("spans"))

    none = F.array().cast("array<struct<start:int,length:int>>")
    return whole.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("blocks", merged), "").alias("formatted"),
        F.aggregate("blocks", F.struct(F.lit(0).alias("pos"), none.alias("spans")), span_ends,
                    lambda acc: acc.spans).alias("loss_spans"))


def parse_chat(formatted: Column) -> Column:
    """The turns of a formatted string, array<struct<role, text>>: the inverse of ``format_chat``."""
    blocks = F.regexp_extract_all(formatted, F.lit(f"(?s)(?:{OPENS}).*?(?:{CLOSES})"), F.lit(0))

    def read(b: Column) -> Column:
        name = F.lit(None).cast("string")
        for role, pair in MARKS.items():
            name = F.when(F.startswith(b, F.lit(pair[0])), F.lit(role)).otherwise(name)
        named = F.substring_index(F.substr(b, F.lit(len(OTHER) + 1)), NAMED, 1)
        body = F.regexp_replace(F.regexp_replace(b, rf"(?:{CLOSES})\z", ""), rf"(?s)^(?:\[ROLE\].*?\[TEXT\]|{OPENS})", "")
        return F.transform(F.split(body, r"\[TURN\]", -1), lambda x: F.struct(
            F.coalesce(name, unescape(named)).alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, read))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(
        F.substr(formatted, s.start + 1, s.length))), "")
