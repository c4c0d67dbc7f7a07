"""Prefix trie of conversations by digests of fixed-length blocks of turns.

Turns are cut into blocks of ``BLOCK``.  A block's digest and its number give two 60-bit values whose
running sums along a conversation are the key of its prefix up to that block, so conversations are
grouped by whole blocks without a pass per level.  Only where one prefix is followed by several
different blocks are turn boundaries looked at: the digests of the first 1, 2, ... turns of those
blocks part the siblings.  Elsewhere a block is a chain of nodes with the members of the block.

A node is named by its least member and its depth.  The nodes of one least member are a chain; sums
over subtrees are sums over the tree of chains (by pointer doubling, a logarithm of its height in
rounds) and then running sums along each chain.  Long conversations are split by ranges of turns, so
none has to fit into a task; lists of members are hashed as a stream of sorted pieces.

Null roles and texts are empty; a null turn comes first; turns of one number are ordered by the
digest of role and text, and repeated rows are turns of their own.  Rows without a conversation id
belong to none and are left out.  An empty table gives no nodes.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import with_row_number, with_running_sums
from ..sources import storage

BLOCK = 4
PIECE_BYTES = 64 << 10
NO_MEMBERS = hashlib.sha256(b"").hexdigest()


def ordered_turns(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, pos from 1, digest, size): the digest of role and text, and the text's code points."""
    said, by = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(role), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.length(by).cast("string"), F.lit(":"), by, said), 256))
    turns = rows.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv"), F.struct(F.col(turn), digest.alias("digest")).alias("at"), F.length(said).cast("long").alias("size"))
    numbered = with_row_number(storage.stored(turns, "turns"), "at", "pos", ["conv"])
    return numbered.select("conv", "pos", F.col("at.digest").alias("digest"), "size")


def _blocks(turns: DataFrame) -> DataFrame:
    """(conv, k, turns, a, b): the turns of each block in order and the two values of its digest."""
    placed = turns.withColumn("k", F.floor((F.col("pos") - 1) / BLOCK))
    folded = placed.groupBy("conv", "k").agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "size"))).alias("turns"))
    digest = F.sha2(F.concat(F.col("k").cast("string"), F.lit(":"), _joined(F.col("turns"))), 256)
    value = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(20,0)")
    return folded.select("conv", "k", "turns", value(1).alias("a"), value(16).alias("b"))


def _joined(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.hex(t["digest"])), "")


def _prefix_key(k: Column, a: Column, b: Column) -> Column:
    return F.unhex(F.md5(F.concat_ws(":", k.cast("string"), a.cast("decimal(38,0)").cast("string"), b.cast("decimal(38,0)").cast("string"))))


def _keyed(blocks: DataFrame) -> DataFrame:
    """(conv, k, key, prev, m): keys of the prefix with and without the block, and the block's turns."""
    narrow = blocks.select("conv", "k", "a", "b", F.size("turns").alias("m"))
    summed = with_running_sums(narrow, "k", {"sa": "a", "sb": "b"}, ["conv"])
    return summed.select(
        "conv", "k", "m", _prefix_key(F.col("k"), F.col("sa"), F.col("sb")).alias("key"),
        _prefix_key(F.col("k") - 1, F.col("sa") - F.col("a"), F.col("sb") - F.col("b")).alias("prev"),
    )


def _nodes(blocks: DataFrame, classes: DataFrame, root: int) -> tuple[DataFrame, DataFrame]:
    """All nodes but the root as (conv, depth, up, n, size), and (key, end): the node at each block's end.

    ``classes`` holds one row per distinct prefix of whole blocks: (prev, key, k, m, rep, n).
    """
    kids = classes.groupBy("prev").agg(F.count(F.lit(1)).alias("kids"))
    reps = classes.select(F.col("key").alias("prev"), F.col("rep").alias("up"))
    above = kids.join(reps, "prev", "left").select("prev", "kids", F.coalesce("up", F.lit(root)).alias("up"))
    above = storage.stored(above, "parents")  # on its own, so that the join below can split a prefix that very many follow
    turns = blocks.select(F.col("conv").alias("rep"), "k", "turns")
    known = storage.stored(classes.join(above, "prev").join(turns, ["rep", "k"]), "block-classes")
    first = F.col("k") * BLOCK

    alone = known.where("kids = 1").select("rep", "n", "up", first.alias("first"), F.posexplode("turns").alias("j", "t"))
    chained = alone.select(
        F.col("rep").alias("conv"), (F.col("first") + F.col("j") + 1).alias("depth"),
        F.when(F.col("j") == 0, F.col("up")).otherwise(F.col("rep")).alias("up"), "n", F.col("t.size").alias("size"),
    )

    def boundary(turns: Column, j: Column) -> Column:
        return F.unhex(F.sha2(_joined(F.slice(turns, F.lit(1), j)), 256))

    def step(t: Column, i: Column) -> Column:
        before = F.when(i > 0, boundary(F.col("turns"), i))
        return F.struct(boundary(F.col("turns"), i + 1).alias("q"), before.alias("before"), t["size"].alias("size"))

    parted = known.where("kids > 1").select("prev", "key", "rep", "n", "up", "m", first.alias("first"), F.posexplode(F.transform("turns", step)).alias("j", "s"))
    parted = parted.select("prev", "key", "rep", "n", "up", "m", (F.col("first") + F.col("j") + 1).alias("depth"), (F.col("j") + 1 == F.col("m")).alias("last"), "s.*")
    parted = storage.stored(parted, "boundaries")
    grouped = parted.groupBy("prev", "q").agg(
        F.min("rep").alias("conv"), F.sum("n").alias("n"), F.min("before").alias("before"), F.min("size").alias("size"), F.min("up").alias("up"), F.min("depth").alias("depth")
    )
    grouped = storage.stored(grouped, "boundary-nodes")
    named = grouped.select("prev", F.col("q").alias("before"), F.col("conv").alias("inner"))
    refined = grouped.join(named, ["prev", "before"], "left").select("conv", "depth", F.coalesce("inner", "up").alias("up"), "n", "size")

    last = parted.where("last").select("prev", "q", "key").join(grouped.select("prev", "q", "conv"), ["prev", "q"])
    ends = known.where("kids = 1").select("key", F.col("rep").alias("end")).unionByName(last.select("key", F.col("conv").alias("end")))
    return chained.unionByName(refined), ends


def _member_digests(ends: DataFrame) -> DataFrame:
    """(end, depth, ends_sha256) from one row per conversation: (end, depth, conv).

    Members are sorted by ranges over all tasks and written as pieces of text, so the task that
    hashes a node with very many members reads few rows and keeps none.
    """
    order = ["end", "depth", "conv"]
    spread = ends.repartitionByRange(*order).sortWithinPartitions(*order)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            end, depth, conv = (batch.column(c).to_pylist() for c in order)
            rows, at = [], 0
            while at < len(end):
                stop, size = at, 0
                while stop < len(end) and size < PIECE_BYTES and end[stop] == end[at] and depth[stop] == depth[at]:
                    size += len(str(conv[stop])) + 1
                    stop += 1
                rows.append((end[at], depth[at], conv[at], ",".join(map(str, conv[at:stop]))))
                at = stop
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in zip(*rows)], names=["end", "depth", "first", "piece"])

    made = spread.mapInArrow(pieces, "end long, depth long, first long, piece string")
    streams = made.repartition("end", "depth").sortWithinPartitions("end", "depth", "first")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            done = []
            for end, depth, piece in zip(*(batch.column(c).to_pylist() for c in ("end", "depth", "piece"))):
                if (end, depth) == now:
                    state.update(b",")
                else:
                    if now is not None:
                        done.append((*now, state.hexdigest()))
                    now, state = (end, depth), hashlib.sha256()
                state.update(piece.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in zip(*done)], names=["end", "depth", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*now, state.hexdigest())], names=["end", "depth", "ends_sha256"])

    return streams.mapInArrow(digests, "end long, depth long, ends_sha256 string")


def _chain_totals(chains: DataFrame) -> DataFrame:
    """(conv, leaves, saved) summed over each chain and all below it; ``chains`` has the chain above as ``par``.

    In each round a chain adds its sums to the one that ``par`` names and looks twice as far up.
    """
    state = storage.stored(chains.select("conv", "par", "leaves", "saved"), "chains")
    while not state.where("par IS NOT NULL").isEmpty():
        given = state.where("par IS NOT NULL").groupBy(F.col("par").alias("conv")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        above = state.select(F.col("conv").alias("par"), F.col("par").alias("further"))
        moved = state.join(given, "conv", "left").join(above, "par", "left")
        state = storage.stored(
            moved.select(
                "conv", F.col("further").alias("par"), (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"),
                (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"),
            ),
            "chains",
        )
    return state.drop("par")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Nodes of the prefix trie with sums over their subtrees.

    ``turns``: (conv, pos, digest, size) with positions from 1 without gaps; ``convs``: (conv), one
    row for each conversation, also those without turns.  Returns conv_id, depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens and ends_sha256.
    """
    convs = storage.stored(convs.select("conv"), "conversations")
    blocks = storage.stored(_blocks(turns), "blocks")
    keyed = storage.stored(_keyed(blocks), "prefixes")
    whole = convs.agg(F.min("conv").alias("root"), F.count(F.lit(1)).alias("n")).first()
    root = -1 if whole["root"] is None else whole["root"]
    classes = keyed.groupBy("prev", "key", "k", "m").agg(F.min("conv").alias("rep"), F.count(F.lit(1)).alias("n"))
    inner, block_ends = _nodes(blocks, storage.stored(classes, "classes"), root)
    top = convs.agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n")).where("n > 0")
    top = top.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("up"), "n", F.lit(0).cast("long").alias("size"))
    nodes = storage.stored(inner.unionByName(top), "nodes")

    below = nodes.where("depth > 0").groupBy(F.col("up").alias("conv"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("kids"))
    leaf = F.when(F.col("kids").isNull(), 1).otherwise(0).cast("long")
    own = nodes.join(below, ["conv", "depth"], "left").select("*", leaf.alias("leaf"), ((F.col("n") - 1) * F.col("size")).alias("saving"))
    own = storage.stored(own, "weighted")
    chains = own.groupBy("conv").agg(F.min("depth").alias("top"), F.min_by("up", "depth").alias("par"), F.sum("leaf").alias("leaves"), F.sum("saving").alias("saved"))
    chains = storage.stored(chains, "chain-tops")
    hung = _chain_totals(chains).join(chains.select("conv", "par", "top"), "conv").where("par IS NOT NULL")
    hung = hung.groupBy(F.col("par").alias("conv"), (F.col("top") - 1).alias("depth")).agg(F.sum("leaves").alias("hung_leaves"), F.sum("saved").alias("hung_saved"))
    here = own.join(hung, ["conv", "depth"], "left").select(
        "conv", "depth", "up", "n", "kids", (F.col("leaf") + F.coalesce("hung_leaves", F.lit(0))).alias("leaf"), (F.col("saving") + F.coalesce("hung_saved", F.lit(0))).alias("saving")
    )
    summed = with_running_sums(storage.stored(here, "hung"), "depth", {"n_leaves": "leaf", "saved_tokens": "saving"}, ["conv"], descending=True)

    final = keyed.groupBy("conv").agg(F.max(F.struct("k", "m", "key")).alias("last"))
    final = final.select("conv", F.col("last.key").alias("key"), (F.col("last.k") * BLOCK + F.col("last.m")).cast("long").alias("depth"))
    placed = final.join(block_ends, "key").select("end", "depth", "conv")
    bare = convs.join(keyed.select("conv").distinct(), "conv", "left_anti")
    bare = bare.select(F.lit(root).cast("long").alias("end"), F.lit(0).cast("long").alias("depth"), "conv")
    digests = _member_digests(storage.stored(placed.unionByName(bare), "ends")).withColumnRenamed("end", "conv")
    return summed.join(digests, ["conv", "depth"], "left").select(
        F.col("conv").alias("conv_id"),
        "depth",
        F.col("up").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.coalesce("kids", F.lit(0)).cast("long").alias("n_children"),
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(NO_MEMBERS)).alias("ends_sha256"),
    )


def grafted(turns: DataFrame, convs: DataFrame, *, every: int = 100, below: int = 6) -> DataFrame:
    """Conversations that open with turns of another one, as forked chats do.

    The first h turns of conversation c are replaced by those of c - c % ``every``, h being the CRC-32
    of the decimal c modulo ``below``.
    """
    conv = F.col("conv")
    heads = turns.where((conv % every == 0) & (F.col("pos") < below)).groupBy(conv.alias("base")).agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "size"))).alias("head"))
    h = (F.crc32(conv.cast("string").cast("binary")) % below).cast("int")
    wanted = convs.select("conv", h.alias("h"), (conv - conv % every).alias("base")).join(heads, "base", "left")
    wanted = wanted.select("conv", "h", F.slice(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), F.lit(1), F.col("h")).alias("head"))
    wanted = storage.stored(wanted, "grafts")
    opened = wanted.select("conv", F.explode("head").alias("t")).select("conv", "t.pos", "t.digest", "t.size")
    rest = turns.join(wanted.select("conv", "h", F.size("head").alias("n")), "conv").where("pos > h")
    return opened.unionByName(rest.select("conv", (F.col("pos") - F.col("h") + F.col("n")).alias("pos"), "digest", "size"))
