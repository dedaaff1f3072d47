"""Conversation structure repair: the cheapest edits that make roles alternate.

A repaired conversation is empty, or an optional system turn and then user and assistant turns in
pairs.  The edits are searched depth first with an explicit stack; see ``cheapest_edits``.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: What may follow what has been put out so far: nothing, a system, a user, an assistant turn.
FOLLOWS = {"": "su", "s": "u", "u": "a", "a": "u"}
ENDS = ("", "a")
FAR = 1 << 60


def suffix_bounds(codes: str) -> list[dict[str, int]]:
    """For every row and every last role put out: no way to the end costs less than this.

    The order of equally cheap edits is left aside, so one pass from the end is enough.
    """
    def with_inserts(bound: dict[str, int]) -> dict[str, int]:
        # two inserts lead back to a role that expects the same; more never help
        for _ in range(2):
            bound = {last: min(bound[last], INSERT + bound["a" if last == "u" else "u"]) for last in FOLLOWS}
        return bound

    found = [with_inserts({last: 0 if last in ENDS else FAR for last in FOLLOWS})]
    for code in reversed(codes):
        after, here = found[-1], {}
        for last in FOLLOWS:
            ways = [DELETE + after[last]]
            if code != "d":
                more, role = TRUNCATED * code.isupper(), code.lower()
                ways.append(REROLE + more + after["a" if last == "u" else "u"])
                if role in FOLLOWS[last]:
                    ways.append(KEEP + more + after[role])
            here[last] = min(ways)
        found.append(with_inserts(here))
    return found[::-1]


def cheapest_edits(codes: str) -> tuple[int, str, str]:
    """(cost, audit, roles) of the cheapest edits, the ASCII-least audit among equals.

    ``codes`` has a letter for each row: its role's initial, upper case if the row is truncated,
    ``x`` for another role and ``d`` for a row that must go.  The audit has a letter for each edit
    (Delete, Insert, Keep, Rerole), ``roles`` the initial that each edit puts out, ``-`` for none.

    Depth-first branch and bound.  A node is (rows used, last role put out).  Of a node's edits the
    one with the lowest bound, then the least letter, is tried first.  A prefix is dropped when its
    cost and the rest's bound exceed the incumbent's cost, when they equal it and its audit is not
    less, or when the node was reached before at no more cost by no greater audit (of two prefixes
    that lead to one node at one cost, neither begins with the other, so the lesser one wins whatever
    follows).  The search ends when the stack is empty: what is left is proved best.
    """
    n, bounds = len(codes), suffix_bounds(codes)

    def letters(link: tuple | None) -> str:
        out = []
        while link:
            out.append(link[1])
            link = link[0]
        return "".join(reversed(out))

    best, best_links, best_audit = FAR, [], ""
    reached: dict[tuple[int, str], tuple[int, tuple | None]] = {}
    # rows used, last role, cost, (link before, letter, role, depth)
    stack = [(0, "", 0, None)]
    while stack:
        i, last, cost, link = stack.pop()
        depth = link[3] if link else 0
        bound = cost + bounds[i][last]
        if bound > best:
            continue
        if bound == best and link:
            if depth <= len(best_links) and link[0] is (best_links[depth - 2] if depth > 1 else None):
                if link[1] >= best_audit[depth - 1]:
                    continue
            elif letters(link) >= best_audit[:depth]:
                continue
        before = reached.get((i, last))
        if before is not None and (before[0] < cost or
                                   before[0] == cost and letters(before[1]) <= letters(link)):
            continue
        reached[i, last] = cost, link
        if i == n and last in ENDS:
            best, best_audit, best_links = cost, letters(link), []
            while link:
                best_links.append(link)
                link = link[0]
            best_links.reverse()
            continue
        turn = "a" if last == "u" else "u"
        edits = [(cost + INSERT, "I", i, turn, turn)]
        if i < n:
            code = codes[i]
            edits.append((cost + DELETE, "D", i + 1, last, "-"))
            if code != "d":
                more, role = TRUNCATED * code.isupper(), code.lower()
                edits.append((cost + REROLE + more, "R", i + 1, turn, turn))
                if role in FOLLOWS[last]:
                    edits.append((cost + KEEP + more, "K", i + 1, role, role))
        edits.sort(key=lambda e: (e[0] + bounds[e[2]][e[3]], e[1]), reverse=True)
        for spent, letter, used, now, role in edits:
            if spent + bounds[used][now] <= best:
                stack.append((used, now, spent, (link, letter, role, depth + 1)))
    return best, best_audit, "".join(x[2] for x in best_links)


@functools.lru_cache(1 << 16)
def known_edits(codes: str) -> tuple[int, str, str]:
    return cheapest_edits(codes)


def _edits(codes: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for part in codes:
        rows = [(known_edits if len(x) <= 64 else cheapest_edits)(x) for x in part]
        out = pd.DataFrame(rows, columns=["cost", "audit", "roles"])
        # the row that an edit is about (for an Insert, the next one)
        out["places"] = [list(accumulate((e != "I" for e in audit[:-1]), initial=0)) if audit else []
                         for audit in out["audit"]]
        yield out


SPACE = " \t\n\x0b\x0c\r"


def repair(turns: DataFrame, present: Column | bool = True) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired), a row a conversation.

    Rows go by turn, nulls first; rows of one turn by role and text.  A row for which ``present``
    does not hold only says that its conversation exists; a conversation without other rows has
    zeros, an empty audit and an empty ``repaired`` (an array of role and text).  A null role or text
    counts as a space; rows without conv_id are one conversation; repeated rows are duplicates;
    further columns, whatever their names, are ignored; an empty table gives no rows.

    One shuffle, on conv_id.  A conversation is one value of one task, as its audit and its
    repaired turns are; the search holds a few numbers for each of its rows.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"),
                        F.coalesce("text", F.lit(" ")).alias("text"),
                        F.coalesce(F.lit(present) if isinstance(present, bool) else present, F.lit(False))
                        .alias("present"))
    seen = Window.partitionBy("conv_id").orderBy("present", "role", "text", "turn")
    last = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    fault = (F.when(last == "", "blank")
             .when((F.lag("present").over(seen) == F.col("present")) & (F.lag("role").over(seen) == F.col("role"))
                   & (F.lag("text").over(seen) == F.col("text")), "duplicate")
             .when(~last.isin(".", "!", "?"), "truncated").otherwise("none"))
    rows = rows.withColumn("fault", fault)
    row = F.struct("turn", "role", "text", (F.col("fault") == "duplicate").alias("again"), "fault")
    whole = rows.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("present"), row))).alias("rows"),
        F.coalesce(F.max(F.when(F.col("present"), F.col("turn"))) - F.min(F.when(F.col("present"), F.col("turn")))
                   + 1, F.lit(0)).alias("span"),
        *(F.count_if(F.col("present") & (F.col("fault") == x)).alias(x) for x in ("blank", "duplicate", "truncated")))
    initial = lambda x: F.substring(x.role, 1, 1)
    role = lambda x: F.when(initial(x).isin("s", "u", "a"), initial(x)).otherwise("x")
    code = lambda x: (F.when(x.fault.isin("blank", "duplicate"), "d")
                      .when(x.fault == "truncated", F.upper(role(x))).otherwise(role(x)))
    numbers = F.array_distinct(F.filter(F.transform("rows", lambda x: x.turn), lambda x: x.isNotNull()))
    pairs = F.zip_with(F.transform("rows", initial),
                       F.slice(F.transform("rows", initial), F.lit(2), F.greatest(F.size("rows") - 1, F.lit(0))),
                       lambda a, b: F.when(b.isNotNull(), ~F.concat(a, b).isin("su", "ua", "au")))
    whole = whole.select(
        "conv_id", "rows", (F.col("span") - F.size(numbers)).cast("long").alias("gaps"), "blank", "duplicate",
        "truncated", F.size(F.filter(pairs, lambda x: x)).cast("long").alias("illegal"),
        F.array_join(F.transform("rows", code), "").alias("codes"))
    solve = F.pandas_udf(_edits, "cost long, audit string, roles string, places array<int>")
    found = whole.withColumn("found", solve("codes"))
    letters = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    edits = F.arrays_zip(letters(F.col("found.audit")).alias("edit"), letters(F.col("found.roles")).alias("role"),
                         F.col("found.places").alias("at"))
    found = found.withColumn("placed", F.filter(edits, lambda x: x.edit != "D"))
    full = lambda x: F.when(x.role == "u", "user").otherwise("assistant")
    repaired = F.transform("placed", lambda x: F.struct(
        F.when(x.edit == "K", F.get("rows", x.at).role).otherwise(full(x)).alias("role"),
        F.when(x.edit == "I", "").otherwise(F.get("rows", x.at).text).alias("text")))
    return found.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", F.col("found.cost").alias("cost"),
                        F.col("found.audit").alias("audit"), repaired.alias("repaired"))


def damage(turns: DataFrame) -> DataFrame:
    """Rows broken in a known way, to repair: by crc32(``conv_id:turn``) % 20 a row is dropped (0: it
    stays with ``present`` false), emptied (1), robbed of its stops (2), repeated (3) or given to the
    user (4).  Nulls count as a space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text")).alias("text"), (F.col("kind") != 0).alias("present"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    ).drop("copy")
