"""Chat formatting: cumulative-snapshot collapse.

Chat systems log a conversation again after every turn, so one log holds a conversation many
times, each a prefix of the next. Rolling hashes over the turns name every prefix; a snapshot
whose whole hash is a proper prefix of a longer one is dropped by an anti-join, equal
snapshots fold into the least conv_id, and what is left is rendered.

Defined results: rows without conv_id belong to no conversation and are left out. Turns are
read in order of turn (null last), then of their digest; a repeated row is a turn of its own.
A null role or text differs from an empty one when compared and is rendered as empty; a turn's own
``<|`` is rendered as ``< |``, so no text forges a turn. A
conversation of very many turns is one window partition, sorted on disk where it must be;
only its rendering is one value. An empty table gives an empty result. Columns other than
conv_id, turn, role and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OPEN, MID, CLOSE = "<|", "|>\n", "\n"
#: What a turn's own OPEN becomes, so that no text can pass for the start of a turn.
ESCAPED = "< |"


def _digest(salt: int):
    """A turn's digest; nulls and empty strings differ."""
    parts = [F.lit(salt)]
    for c in ("role", "text"):
        parts += [F.col(c).isNull(), F.coalesce(F.col(c), F.lit(""))]
    return F.xxhash64(*parts)


def turn_prefixes(conversations: DataFrame) -> DataFrame:
    """(conv_id, n, p1..p4, last): the rolling hash of the first n turns of each conversation.

    A prefix hash is a running sum of two 64-bit digests of (position, turn), kept as 32-bit
    halves, so a window of any length needs constant memory.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "d1", "d2")
    rows = conversations.where("conv_id is not null").select("conv_id", "turn", _digest(1).alias("d1"), _digest(2).alias("d2"))
    rows = rows.withColumn("n", F.row_number().over(order))
    rows = rows.withColumns({"h1": F.xxhash64("n", "d1", "d2"), "h2": F.xxhash64("d2", "n", "d1")})
    low = F.lit(0xFFFFFFFF)
    halves = {
        "p1": F.col("h1").bitwiseAND(low),
        "p2": F.shiftrightunsigned("h1", 32),
        "p3": F.col("h2").bitwiseAND(low),
        "p4": F.shiftrightunsigned("h2", 32),
    }
    run = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = [F.sum(v).over(run).alias(k) for k, v in halves.items()]
    return rows.select("conv_id", "n", *sums, F.lead("n").over(order).isNull().alias("last"))


def collapse_snapshots(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies): the maximal conversations, one for each set of equal ones."""
    key = ["n", "p1", "p2", "p3", "p4"]
    prefixes = turn_prefixes(conversations)
    # equal snapshots meet in a grouped minimum, shared prefixes in a distinct: both combine map-side
    whole = prefixes.where("last").groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    inner = prefixes.where("not last").select(*key).distinct()
    return whole.join(inner, key, "left_anti").select("conv_id", F.col("n").alias("n_turns"), "n_copies")


def render(conversations: DataFrame) -> DataFrame:
    """(conv_id, rendered): each conversation's turns as one chat-markup text."""
    turn = F.struct(F.coalesce(F.col("turn").isNull(), F.lit(True)).alias("late"), "turn", _digest(1).alias("d1"), _digest(2).alias("d2"), "role", "text")
    turns = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    part = lambda x: F.replace(F.coalesce(x, F.lit("")), F.lit(OPEN), F.lit(ESCAPED))
    line = lambda t: F.concat(F.lit(OPEN), part(t["role"]), F.lit(MID), part(t["text"]), F.lit(CLOSE))
    return turns.select("conv_id", F.array_join(F.transform("turns", line), "").alias("rendered"))


def format_chats(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies, rendered) of every maximal conversation."""
    kept = collapse_snapshots(conversations)
    turns = conversations.select("conv_id", "turn", "role", "text")
    # the semi-join and the grouping use one exchange on conv_id
    return render(turns.join(kept.select("conv_id"), "conv_id", "left_semi")).join(kept, "conv_id").select("conv_id", "n_turns", "n_copies", "rendered")


ORACLE = r"""
WITH t AS (
  SELECT conv_id, row_number() OVER w AS n,
         md5(string_agg(coalesce('r' || role, 'null') || chr(1) || coalesce('t' || text, 'null'), chr(2)) OVER w) AS h,
         lead(conv_id) OVER w IS NULL AS last
  FROM conversations WHERE conv_id IS NOT NULL
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS LAST)
), whole AS (
  SELECT n, h, min(conv_id) AS conv_id, count(*) AS n_copies FROM t WHERE last GROUP BY n, h
), kept AS (
  SELECT * FROM whole w WHERE NOT EXISTS (SELECT 1 FROM t WHERE NOT t.last AND t.n = w.n AND t.h = w.h)
)
SELECT k.conv_id, k.n AS n_turns, k.n_copies,
       string_agg('<|' || replace(coalesce(role, ''), '<|', '< |') || '|>' || chr(10) || replace(coalesce(text, ''), '<|', '< |') || chr(10), '' ORDER BY turn NULLS LAST) AS rendered
FROM kept k JOIN conversations c ON c.conv_id = k.conv_id
GROUP BY k.conv_id, k.n, k.n_copies
"""
