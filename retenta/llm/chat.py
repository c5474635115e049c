"""Chat formatting with collapse of cumulative snapshots.

Logs often hold a conversation several times, each time some turns longer. Every turn gets the hash of all turns up to
it (an exclusive-or of hashes of position, role and text, so it is a running aggregate). A conversation whose last
hash is the hash of an inner turn of another one is a prefix of it; an anti-join keeps those that are not. Of equal
conversations the lowest id stays. The rest is rendered.

A conversation may hold any share of the rows: turns are dealt by ranges of (conversation, turn), numbered and hashed
within a range, and what the conversation's earlier ranges hold is added. It is rendered by blocks of turns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .places import earlier, numbered, with_earlier
from .workspace import Workspace

#: Turns in a block, the most that is rendered in one row.
BLOCK = 1000


def placed_turns(turns: DataFrame, space: Workspace) -> DataFrame:
    """conv_id, k (place in the conversation, from 1), role, text, digest and part (the range) of each turn, written.

    Turns go by turn number (null first), then role, then digest; rows equal in these and conv_id count once. The digest
    hashes role and text apart, so that no other pair of them has it.
    """
    role, text = F.coalesce("role", F.lit("unknown")), F.coalesce("text", F.lit(""))
    plain = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    plain = plain.withColumn("digest", F.md5(F.concat(F.md5("role"), F.md5("text"))))
    once = plain.groupBy("conv_id", "turn", "role", "digest").agg(F.first("text").alias("text"))
    return space.stage(numbered(once, ["conv_id"], ["turn", "role", "digest"], space, "turns", "k").drop("turn", "salt"), "placed")


def prefix_hashes(placed: DataFrame) -> DataFrame:
    """One row per turn: conv_id, k, p and q (hash of turns 1 to k)."""
    hashes = placed.select("conv_id", "part", "k", F.xxhash64("k", "digest").alias("x"), F.xxhash64("digest", "k", F.lit("second")).alias("y"))
    per_part = hashes.groupBy("conv_id", "part").agg(F.bit_xor("x").alias("sx"), F.bit_xor("y").alias("sy"))
    before = earlier(per_part, ["conv_id"], {"ex": F.bit_xor("sx"), "ey": F.bit_xor("sy")})
    run = Window.partitionBy("part", "conv_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    running = with_earlier(hashes.withColumns({"rx": F.bit_xor("x").over(run), "ry": F.bit_xor("y").over(run)}), before, ["conv_id"])
    p, q = (F.col(f"r{c}").bitwiseXOR(F.coalesce(f"e{c}", F.lit(0).cast("long"))) for c in "xy")
    return running.select("conv_id", "k", p.alias("p"), q.alias("q"))


def maximal_conversations(placed: DataFrame, space: Workspace) -> DataFrame:
    """conv_id and n_turns of the conversations that are no prefix of a longer one, one of each set of equal ones."""
    hashes = space.stage(prefix_hashes(placed), "hashes")
    last = hashes.groupBy("conv_id").agg(F.max(F.struct("k", "p", "q")).alias("end"))
    ends = space.stage(last.groupBy("end.k", "end.p", "end.q").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("ending")), "ends")
    # More conversations pass a turn than end at it: an inner turn of one of them.
    passed = hashes.groupBy("k", "p", "q").agg(F.count("*").alias("passing"))
    inner = space.stage(passed.join(ends.select("k", "p", "q", "ending"), ["k", "p", "q"]).where("passing > ending").select("k", "p", "q"), "inner")
    return ends.join(inner, ["k", "p", "q"], "left_anti").select("conv_id", F.col("k").alias("n_turns"))


def rendered(turns: DataFrame, space: Workspace, before: str = "<|", after: str = "|>\n", end: str = "<|end|>\n") -> DataFrame:
    """The maximal conversations of ``turns`` (conv_id, turn, role, text) as text, in turn order.

    Columns: conv_id, part, n_turns, text. A turn is rendered as before + role + after + text + end. A conversation of up
    to a thousand turns is one row (part 0), whatever their numbers; each further thousand is a further part. Turns
    without a number come first. A null role is "unknown", a null text is empty, a null conv_id is an id like any other;
    equal rows count once. An empty table gives an empty one; other columns are not looked at.
    """
    placed = placed_turns(turns, space)
    kept = space.stage(maximal_conversations(placed, space).withColumnRenamed("conv_id", "kept"), "kept")
    piece = F.struct("k", F.concat(F.lit(before), "role", F.lit(after), "text", F.lit(end)).alias("piece"))
    pieces = placed.join(kept, F.col("conv_id").eqNullSafe(F.col("kept"))).select("conv_id", F.floor((F.col("k") - 1) / BLOCK).alias("part"), "n_turns", piece.alias("piece"))
    return (
        pieces.groupBy("conv_id", "part", "n_turns").agg(F.array_sort(F.collect_list("piece")).alias("pieces"))
        .select("conv_id", "part", "n_turns", F.concat_ws("", F.col("pieces.piece")).alias("text"))
    )
