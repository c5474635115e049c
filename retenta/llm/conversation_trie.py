"""A prefix trie of conversations, built as burst tries.

Every turn of a conversation gets the hash of all turns up to it, so a node of the trie is a depth and a hash. Below the
root each first turn is a trie head with a container of the suffixes that follow it. A container of too many turns is
burst: the next turns of its suffixes become heads, and the suffixes go on to the containers below those, by the id of
the turn they go on with. Each round bursts twice as many turns deep as the one before, so rounds grow with the
logarithm of the depth, and all rounds together move each turn a few times. The containers that are left are small by
construction. They are dealt to shards, where each is sorted and swept into nodes with all their sums.

Heads are counted by aggregates that add up before the shuffle, as a head may have any share of the conversations as
members. What lies below a head needs no walk over the trie: of the members of a node the one with the lowest id
owns it, and owns all nodes further down its way too. So each conversation owns the end of its way; the turns before it
are saved, and a leaf counts for its owner. A head sums that over its members.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .places import dealt, earlier, numbered, with_earlier
from .trie_sweep import Node, digest, sweep
from .workspace import Workspace

#: Turns in a container that is not burst.
MOST = 20_000

NODE = ["d", "p1", "p2"]
ROW = ["conv_id", *NODE, "q1", "q2", "chars", "total", "last"]


def shared_turns(conv_id: Column, shared: int) -> Column:
    """How many turns a conversation takes from the first one of its block of ids."""
    return (F.crc32(conv_id.cast("string")) % shared).cast("int")


def _turn_hashes(place: Column, a: Column, b: Column) -> tuple[Column, Column]:
    return F.xxhash64(place, a, b), F.xxhash64(b, place, a)


def prefix_rows(turns: DataFrame, space: Workspace, block: int = 1, shared: int = 1) -> DataFrame:
    """A row for each turn of every rebuilt conversation, and one of depth 0 for each conversation.

    Columns: conv_id, d (depth), p1 and p2 (hash of turns 1 to d), q1 and q2 (of turns 1 to d-1), chars (code points of
    the turn's text), total (of all turns up to it), last (whether it is the last one). A conversation is rebuilt
    from the first ``crc32(conv_id) % shared`` turns of conversation ``conv_id - conv_id % block`` and its own turns
    after as many; with ``shared`` 1 it stays as it is. The remainder has the sign of the id, as in SQL.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    plain = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.md5(text).alias("text_md5"), F.length(text).cast("long").alias("chars"))
    placed = numbered(plain.where("conv_id is not null"), ["conv_id"], ["turn", "role", "text_md5"], space, "turns", "k")
    a, b = F.xxhash64("role", "text_md5"), F.xxhash64("text_md5", F.lit(1), "role")
    placed = space.stage(placed.select("conv_id", "k", a.alias("a"), b.alias("b"), "chars", "part", "salt"), "placed")
    h, base = shared_turns(F.col("conv_id"), shared), F.col("conv_id") - F.col("conv_id") % block
    starts = placed.where((F.col("conv_id") % block == 0) & (F.col("k") < shared)).groupBy(F.col("conv_id").alias("base"))
    starts = space.stage(starts.agg(F.array_sort(F.collect_list(F.struct("k", "a", "b", "chars"))).alias("start")), "starts")  # shared - 1 turns at most

    def hashed(x: Column, i: Column) -> Column:
        x1, x2 = _turn_hashes(i.cast("long") + 1, x["a"], x["b"])
        return F.struct(x1.alias("x1"), x2.alias("x2"), x["chars"].alias("chars"))

    def folded(turns: Column, name: str) -> Column:
        add = (lambda s, x: s + x[name]) if name == "chars" else (lambda s, x: s.bitwiseXOR(x[name]))
        return F.aggregate(turns, F.lit(0).cast("long"), add)

    convs = placed.groupBy("conv_id").agg(F.count("*").alias("c")).withColumns({"h": h, "of": base}).join(starts, F.col("of") == F.col("base"), "left")
    convs = convs.withColumn("start", F.when((F.col("h") > 0) & F.col("start").isNotNull(), F.slice("start", 1, F.greatest("h", F.lit(1)))).otherwise(F.array().cast(starts.schema["start"].dataType)))
    convs = convs.select("conv_id", "h", F.size("start").alias("n_start"), (F.size("start") + F.greatest(F.col("c") - F.col("h"), F.lit(0))).alias("n"), F.transform("start", hashed).alias("start"))
    convs = space.stage(convs.withColumns({"s1": folded(F.col("start"), "x1"), "s2": folded(F.col("start"), "x2"), "s_chars": folded(F.col("start"), "chars")}), "convs")

    own = placed.where(F.col("k") > h).join(convs.drop("start"), "conv_id").withColumn("d", F.col("n_start") + F.col("k") - F.col("h"))
    x1, x2 = _turn_hashes(F.col("d"), F.col("a"), F.col("b"))
    own = space.stage(own.select("conv_id", "d", "n", "s1", "s2", "s_chars", x1.alias("x1"), x2.alias("x2"), "chars", "part"), "own")
    space.drop("turns", "placed")
    per_part = own.groupBy("conv_id", "part").agg(F.bit_xor("x1").alias("y1"), F.bit_xor("x2").alias("y2"), F.sum("chars").alias("y_chars"))
    before = earlier(per_part, ["conv_id"], {"e1": F.bit_xor("y1"), "e2": F.bit_xor("y2"), "e_chars": F.sum("y_chars")})
    run = Window.partitionBy("part", "conv_id").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    running = own.withColumns({"r1": F.bit_xor("x1").over(run), "r2": F.bit_xor("x2").over(run), "r_chars": F.sum("chars").over(run)})
    zero = F.lit(0).cast("long")
    running = with_earlier(running, before, ["conv_id"])
    running = running.withColumns({f"p{i}": F.col(f"s{i}").bitwiseXOR(F.coalesce(f"e{i}", zero)).bitwiseXOR(F.col(f"r{i}")) for i in (1, 2)})
    running = running.withColumn("total", F.col("s_chars") + F.coalesce("e_chars", zero) + F.col("r_chars"))
    begun = convs.select("conv_id", "n", "start", F.posexplode("start").alias("i", "x")).withColumn("d", F.col("i").cast("long") + 1)
    begun = begun.withColumn("start", F.slice("start", F.lit(1), F.col("d").cast("int"))).withColumns(
        {"p1": folded(F.col("start"), "x1"), "p2": folded(F.col("start"), "x2"), "total": folded(F.col("start"), "chars")})
    begun = begun.withColumns({"x1": F.col("x.x1"), "x2": F.col("x.x2"), "chars": F.col("x.chars")})
    above = [F.col(f"p{i}").bitwiseXOR(F.col(f"x{i}")).alias(f"q{i}") for i in (1, 2)]
    columns = ["conv_id", "d", "p1", "p2", *above, "chars", "total", (F.col("d") == F.col("n")).alias("last")]
    roots = convs.select("conv_id", *[zero.alias(c) for c in ("d", "p1", "p2", "q1", "q2", "chars", "total")], (F.col("n") == 0).alias("last"))
    rows = space.stage(roots.unionByName(begun.select(columns)).unionByName(running.select(columns)), "rows")
    space.drop("own", "convs", "starts")
    return rows


def burst(rows: DataFrame, space: Workspace, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """Rows that belong to heads, and rows of containers of at most ``most`` turns with their container (c1, c2, cd).

    Joins by conversation or container are between stored tables, so that Spark can split a crowded one.
    """
    heads, closed = [rows.where("d <= 1")], []

    def into(rest: DataFrame, at: DataFrame, depth: int) -> DataFrame:
        """``rest`` in the containers below the nodes of depth ``depth`` that their conversations pass."""
        pass_by = at.where(F.col("d") == depth).select("conv_id", F.col("p1").alias("c1"), F.col("p2").alias("c2"))
        return rest.where(F.col("d") > depth).join(pass_by, "conv_id").select(*ROW, "c1", "c2").withColumn("cd", F.lit(depth))

    depth, steps = 1, 2
    held = space.stage(into(rows, rows, depth), f"held-{depth}")
    while True:
        crowded = space.stage(held.groupBy("c1", "c2").agg(F.count("*").alias("c")).where(F.col("c") > most).select("c1", "c2"), f"crowded-{depth}")
        if crowded.isEmpty():
            return _all(heads), _all([*closed, held])
        crowd = [F.col("c1").eqNullSafe(F.col("b1")), F.col("c2").eqNullSafe(F.col("b2"))]
        marked = held.join(crowded.select(F.col("c1").alias("b1"), F.col("c2").alias("b2"), F.lit(True).alias("full")), crowd, "left").drop("b1", "b2")
        marked = space.stage(marked, f"marked-{depth}")
        space.drop(f"held-{depth}")
        closed.append(marked.where("full is null").drop("full"))
        full = marked.where("full").select(ROW)
        heads.append(full.where(F.col("d") <= depth + steps))
        depth, steps = depth + steps, steps * 2
        held = space.stage(into(full, full, depth), f"held-{depth}")


def _all(frames: list[DataFrame]) -> DataFrame:
    first, *rest = frames
    for f in rest:
        first = first.unionByName(f)
    return first


SWEPT = ("kind int, conv_id long, depth long, parent_conv_id long, q1 long, q2 long, n_convs long, n_children long, n_leaves long, "
         "saved_tokens long, ends_sha256 string, before long")


def _swept(nodes: Iterator[Node]) -> list[tuple]:
    """Rows of kind 0 for the nodes, and of kind 1 for what each owner saves: turns before its first own node, and its leaf."""
    rows, owned = [], {}
    for x in nodes:
        top = x.parent is None
        rows.append((x, top))
        leaf, before = owned.get(x.conv_id, (0, x.before))
        owned[x.conv_id] = (leaf or int(x.n_children == 0), min(before, x.before))
    out = [(0, x.conv_id, x.depth, None if top else x.parent.conv_id, x.of[0] if top else None, x.of[1] if top else None, x.n_convs, x.n_children,
            x.n_leaves, x.saved, digest(x.ends), None) for x, top in rows]
    return out + [(1, c, None, None, None, None, None, None, leaf, None, None, before) for c, (leaf, before) in owned.items()]


def swept(containers: DataFrame) -> DataFrame:
    """The nodes of all containers, each swept whole in a task of some containers."""
    schema = pa.schema([(n, {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}[t]) for n, t in (c.split() for c in SWEPT.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None

        def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
            names = ("conv_id", "d", "p1", "p2", "q1", "q2", "chars", "total")
            conv, d, p1, p2, q1, q2, chars, total = (table.column(n).to_pylist() for n in names)
            prefix, above = list(zip(p1, p2, strict=True)), list(zip(q1, q2, strict=True))
            for a, b in zip(*_bounds(table), strict=True):
                found = _swept(sweep(conv[a:b], d[a:b], prefix[a:b], above[a:b], chars[a:b], total[a:b]))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            kept = pa.concat_tables([kept, pa.Table.from_batches([batch])]) if kept is not None else pa.Table.from_batches([batch])
            start = int(_bounds(kept)[0][-1]) if kept.num_rows else 0  # the last container may go on
            yield from done(kept.slice(0, start))
            kept = kept.slice(start)
        if kept is not None:
            yield from done(kept)

    key = ["cd", "c1", "c2"]
    return containers.repartition(*key).sortWithinPartitions(*key, "conv_id", "d").mapInArrow(run, SWEPT)


def _bounds(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Where each container starts and ends in a table sorted by container."""
    if not table.num_rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys = [table.column(c).to_numpy() for c in ("cd", "c1", "c2")]
    new = np.ones(table.num_rows, bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    start = np.flatnonzero(new)
    return start, np.append(start[1:], table.num_rows)


def ends_of_heads(ends: DataFrame, space: Workspace) -> DataFrame:
    """NODE and ends_sha256 of the nodes of ``ends`` (NODE, conv_id).

    Any share of the conversations may end at one node. They are dealt by ranges of (node, id), each range joins its
    ids of a node to one text, and the texts of a node are hashed one after the other, without being joined.
    """
    ranges = dealt(ends, NODE, ["conv_id"], space, "ends")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    texts = ranges.groupBy(*NODE, "part").agg(ids.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, hashed = None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in node), pa.array([hashed.hexdigest()])], names=[*NODE, "ends_sha256"])

        for batch in batches:
            for *key, text in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids")), strict=True):
                if key == node:
                    hashed.update(b",")
                else:
                    if node:
                        yield row()
                    node, hashed = key, hashlib.sha256()
                hashed.update(text.encode())
        if node:
            yield row()

    return texts.repartition(*NODE).sortWithinPartitions(*NODE, "part").select(*NODE, "ids").mapInArrow(run, "d long, p1 long, p2 long, ends_sha256 string")


def prefix_trie(turns: DataFrame, space: Workspace, block: int = 1, shared: int = 1, most: int = MOST) -> DataFrame:
    """The nodes of the trie of all conversations of ``turns`` (conv_id, turn, role, text); ``block``, ``shared``: ``prefix_rows``.

    Columns: conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves,
    saved_tokens (code points that the subtree's nodes hold once instead of once a member), ends_sha256 (of the ids of
    the conversations that end there). Turns go by turn number (null first), then role, then md5 of the text; a repeated row
    is a turn of its own; a null role or text is empty. Rows without conv_id belong to no conversation and are left out. An
    empty table has no nodes, not even a root. Other columns are not looked at. Of a text only hash and length are kept.
    """
    rows = prefix_rows(turns, space, block, shared)
    head_rows, containers = burst(rows, space, most)
    head_rows = space.stage(head_rows, "head-rows")
    found = space.stage(swept(containers), "swept")
    inner, owners = found.where("kind = 0"), found.where("kind = 1")
    heads = head_rows.groupBy(*NODE).agg(
        F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("q1").alias("q1"), F.max("q2").alias("q2"),
        F.max(F.col("total") - F.col("chars")).alias("before"))
    heads = space.stage(heads, "heads")
    tops = inner.where("q1 is not null")
    below = _all([heads.where("d > 0").select("d", "q1", "q2"), tops.select(F.col("depth").alias("d"), "q1", "q2")])
    below = below.groupBy((F.col("d") - 1).alias("d"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count("*").alias("n_children"))
    heads = space.stage(heads.join(below, NODE, "left").fillna(0, ["n_children"]), "heads-below")
    owned = _all([
        heads.select("conv_id", "before", (F.col("n_children") == 0).cast("long").alias("leaf")), owners.select("conv_id", "before", F.col("n_leaves").alias("leaf")),
        rows.where("last").select("conv_id", F.col("total").alias("before"), F.lit(0).cast("long").alias("leaf"))])
    owned = space.stage(owned.groupBy("conv_id").agg(F.min("before").alias("first"), F.max("leaf").alias("leaf")), "owned")
    spared = F.greatest(F.col("first") - (F.col("total") - F.col("chars")), F.lit(0).cast("long"))
    sums = head_rows.join(owned, "conv_id").groupBy(*NODE).agg(F.sum("leaf").alias("n_leaves"), F.sum(spared).alias("saved_tokens"))
    ends = ends_of_heads(head_rows.where("last").select(*NODE, "conv_id"), space)
    empty = hashlib.sha256(b"").hexdigest()
    whole = heads.join(sums, NODE).join(ends, NODE, "left").fillna(empty, ["ends_sha256"])
    counts = ["n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    loose = _all([whole.select("conv_id", F.col("d").alias("depth"), "q1", "q2", *counts), tops.select("conv_id", "depth", "q1", "q2", *counts)])
    parents = heads.select((F.col("d") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    tied = loose.join(parents, ["depth", "q1", "q2"], "left")
    columns = ["conv_id", "depth", "parent_conv_id", *counts]
    return tied.select(columns).unionByName(inner.where("q1 is null").select(columns))
