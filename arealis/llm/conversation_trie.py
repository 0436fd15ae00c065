"""A trie of conversation prefixes from digests of blocks of turns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arealis.llm.common import table, written

#: Turns of a block.
BLOCK = 4


def _sha(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def turn_digests(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, digest, words)`` of each row; texts go no further. Rows without a ``conv_id`` go.

    The digest is SHA-256 over the role's length, role and text, null being empty.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))  # noqa: E731
    whole = F.concat(F.char_length(text("role")).cast("string"), F.lit(":"), text("role"), text("text"))
    return conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        _sha(whole.cast("binary")).alias("digest"),
        F.regexp_count(text("text"), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )


def numbered_turns(turns: DataFrame) -> DataFrame:
    """``(conv_id, pos, digest, words)``: turns from 1, ordered by turn (null first), then digest.

    Rows are dealt by ranges of conversation and turn, so a conversation with most of
    all rows is spread out; what each range holds of a conversation before another is
    added to the places within ranges (a row for each range at most).
    """
    order = [F.asc_nulls_first("turn"), F.asc("digest")]
    ranged = written(turns.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()), "turns")
    counts = ranged.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.withColumn("before", before).where("before is not null").select("conv_id", "part", "before")
    place = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order))
    return ranged.withColumn("i", place).join(F.broadcast(offsets), ["conv_id", "part"], "left").select("conv_id", (F.col("i") + F.coalesce("before", F.lit(0))).cast("long").alias("pos"), "digest", "words")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(conv_id, len)`` of all conversations and ``(conv_id, pos, digest, words, len)`` of their rebuilt turns.

    Conversation ``c`` takes the first ``h`` turns of ``c - c % 20``, all if it has
    fewer, then its own after its first ``h``; ``h`` is the CRC-32 of ``c`` in decimal,
    modulo 4. Signs of remainders are those of SQL.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("own")).withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % 20})
    bases = convs.select(F.col("conv_id").alias("base"), F.col("own").alias("base_own"))
    convs = convs.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_own", F.lit(0))))
    convs = written(convs.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("len")), "convs")
    lead = turns.where("pos <= 3").withColumnRenamed("conv_id", "base").join(convs, "base").where("pos <= taken").select("conv_id", "pos", "digest", "words", "len")
    own = turns.join(convs, "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "digest", "words", "len")
    return convs.select("conv_id", "len"), lead.unionByName(own)


def blocks(turns: DataFrame, size: int = BLOCK) -> DataFrame:
    """``(conv_id, blk, len, d, w, before, after, parent, chain)``: blocks of ``size`` turns and what precedes them.

    ``d`` and ``w`` are the turns' digests and words. ``chain`` stands for all turns up
    to a full block's end and ``parent`` for those before the block (empty for the first
    one); ``before`` and ``after`` count words up to there. They come from a scan by
    doubling: in round k a block takes in what the block 2^k before it stands for, so
    rounds grow with the logarithm of the longest conversation and none is in one task.
    """
    one = F.sort_array(F.collect_list(F.struct("pos", "digest", "words")))
    b = turns.groupBy("conv_id", F.floor((F.col("pos") - 1) / size).cast("long").alias("blk"), "len").agg(one.alias("t"))
    b = b.select("conv_id", "blk", "len", F.transform("t", lambda x: x.digest).alias("d"), F.transform("t", lambda x: x.words).alias("w"))
    b = written(b.withColumn("sum", F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + x)), "blocks")
    state, step = written(b.select("conv_id", "blk", _sha(_hexed(F.col("d"))).alias("chain"), F.col("sum").alias("after")), "scan"), 1
    done = state.where(F.col("blk") < step)
    while not (active := state.where(F.col("blk") >= step)).isEmpty():
        earlier = active.unionByName(done).select("conv_id", (F.col("blk") + step).alias("blk"), F.col("chain").alias("chain0"), F.col("after").alias("after0"))
        grown = active.join(earlier, ["conv_id", "blk"]).select("conv_id", "blk", _sha(F.col("chain0"), F.col("chain")).alias("chain"), (F.col("after0") + F.col("after")).alias("after"))
        state, low, step = written(grown, "scan"), step, 2 * step
        done = done.unionByName(state.where((F.col("blk") >= low) & (F.col("blk") < step)))
    up = done.select("conv_id", (F.col("blk") + 1).alias("blk"), F.col("chain").alias("parent"))
    full = F.when(F.size("d") == size, F.col("chain"))
    out = b.join(done, ["conv_id", "blk"]).join(up, ["conv_id", "blk"], "left")
    return written(out.select("conv_id", "blk", "len", "d", "w", (F.col("after") - F.col("sum")).alias("before"), "after", F.coalesce("parent", F.lit(b"")).alias("parent"), full.alias("chain")), "blocks")


def _hexed(d: Column) -> Column:
    return F.array_join(F.transform(d, F.hex), "").cast("binary")


#: What says which block it is: all else of it follows from these.
_SAME = ["parent", "blk", "chain", "d", "w"]


def _turns_of(groups: DataFrame, size: int) -> DataFrame:
    """A row for each turn ``j`` (from 1) of each block, with its ``node``, the node above it (``up``) and its depth."""
    at = lambda j: F.when(j == 0, F.col("parent")).when((j == size) & F.col("chain").isNotNull(), F.col("chain")).otherwise(_sha(F.col("parent"), _hexed(F.slice("d", 1, j))))  # noqa: E731
    each = groups.withColumn("j", F.explode(F.sequence(F.lit(1), F.size("d"))))
    return each.withColumns({"node": at(F.col("j")), "up": at(F.col("j") - 1), "depth": F.col("blk") * size + F.col("j")})


def nodes_of(blocks: DataFrame, size: int = BLOCK) -> DataFrame:
    """``(node, up, depth, conv_id, n_convs)`` of all prefixes of a turn or more.

    Conversations are grouped by whole blocks first. Where all that share a parent also
    share the block, its turns have the same members and need no grouping; the turn
    boundaries of the other blocks are grouped, one row for each different block.
    """
    g = written(blocks.groupBy(*_SAME).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")), "groups")
    g = g.join(g.groupBy("parent", "blk").agg(F.count("*").alias("siblings")), ["parent", "blk"])
    cols = ("node", "up", "depth", "conv_id", "n_convs")
    alone = _turns_of(g.where("siblings = 1"), size).select(*cols)
    split = _turns_of(g.where("siblings > 1"), size).groupBy("node", "up", "depth").agg(F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"))
    return written(alone.unionByName(split), "nodes")


def ends_digests(ends: DataFrame, chunk: int = 50_000) -> DataFrame:
    """``(node, ends_sha256)`` of ``ends(node, conv_id)``: SHA-256 over the ids, ascending and comma-joined.

    Ranges of ids become strings of at most ``chunk`` ids; these are then streamed into
    the digest of their node in order, so no group is held in memory and what one task
    reads of a large group is its joined ids.
    """
    ranged = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[bytes, int, list[str]]] = []
            for node, conv in zip(b.column("node").to_pylist(), b.column("conv_id").to_pylist()):
                if not out or out[-1][0] != node or len(out[-1][2]) >= chunk:
                    out.append((node, conv, []))
                out[-1][2].append(str(conv))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.int64()), pa.array([",".join(x[2]) for x in out])], names=["node", "low", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, out = None, hashlib.sha256(), []
        batch = lambda: pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out])], names=["node", "ends_sha256"])  # noqa: E731
        for b in batches:
            for n, ids in zip(b.column("node").to_pylist(), b.column("ids").to_pylist()):
                if n == node:
                    state.update(b",")
                else:
                    if node is not None:
                        out.append((node, state.hexdigest()))
                    node, state = n, hashlib.sha256()
                state.update(ids.encode())
            if len(out) >= 10_000:
                yield batch()
                out = []
        if node is not None:
            out.append((node, state.hexdigest()))
        if out:
            yield batch()

    parts = ranged.mapInArrow(joined, "node binary, low long, ids string")
    return parts.repartition("node").sortWithinPartitions("node", "low").mapInArrow(digests, "node binary, ends_sha256 string")


def prefix_trie(convs: DataFrame, turns: DataFrame, size: int = BLOCK) -> DataFrame:
    """The nodes of the trie of ``turns(conv_id, pos, digest, words, len)``, positions from 1 without gaps.

    ``convs(conv_id, len)`` also has conversations without turns. A node is a distinct
    sequence of first turns; its columns are ``conv_id`` (its smallest member), ``depth``,
    ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves`` (childless nodes in its
    subtree), ``saved_tokens`` (over its subtree, words of the last turn times members
    but one) and ``ends_sha256`` (of the ids that end there).

    A conversation owns the nodes of which it is the smallest member: the last ones on
    its way. ``saved_tokens`` then is, summed over a node's members, the words from the
    node's turn on to the first turn the member owns; ``n_leaves`` counts members that
    own a childless node. So both are sums over blocks, without a walk up the tree. An
    empty table has no nodes, not even the root.
    """
    b = blocks(turns, size)
    n = nodes_of(b, size)
    all_ = convs.agg(F.count("*").alias("n"), F.min("conv_id").alias("low")).first()
    children = n.where("depth > 1").groupBy(F.col("up").alias("node")).agg(F.count("*").alias("n_children"))
    above = n.select(F.col("node").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    first = n.where("depth = 1").withColumn("parent_conv_id", F.lit(all_.low).cast("long"))
    n = first.unionByName(n.where("depth > 1").join(above, "up"), allowMissingColumns=True)
    n = written(n.join(children, "node", "left").fillna(0, ["n_children"]), "nodes")

    owned = n.groupBy("conv_id").agg(F.min("depth").alias("o"), F.max(F.col("n_children") == 0).alias("leaf"))
    mine = b.join(owned, "conv_id", "left").select("conv_id", "blk", "w", "before", F.coalesce("o", F.col("len") + 1).alias("o"), F.coalesce("leaf", F.lit(False)).cast("long").alias("leaf"))
    inside = F.aggregate(F.slice("w", 1, (F.col("o") - 1 - F.col("blk") * size).cast("int")), F.lit(0).cast("long"), lambda a, x: a + x)
    shared = F.when(F.col("blk") == F.floor((F.col("o") - 2) / size), F.col("before") + inside)
    mine = written(mine.groupBy("conv_id", "o", "leaf").agg(F.coalesce(F.max(shared), F.lit(0)).alias("shared")), "owned")

    k = F.col("o") - 1 - F.col("blk") * size
    g = b.join(mine, "conv_id").groupBy(*_SAME).agg(F.sum(F.greatest(F.col("shared") - F.col("after"), F.lit(0))).alias("later"), F.sum("leaf").alias("n_leaves"), *(F.sum((k >= i).cast("long")).alias(f"m{i}") for i in range(1, size + 1)))
    here = F.zip_with("w", F.array(*(f"m{i}" for i in range(1, size + 1))), lambda w, m: F.coalesce(w, F.lit(0)) * m)
    value = F.col("later") + F.aggregate(F.slice("here", F.col("j"), size), F.lit(0).cast("long"), lambda a, x: a + x)
    sums = _turns_of(g.withColumn("here", here), size).groupBy("node").agg(F.sum(value).alias("saved_tokens"), F.sum("n_leaves").alias("n_leaves"))

    last = _turns_of(b.where(F.col("blk") == F.floor((F.col("len") - 1) / size)), size).where(F.col("depth") == F.col("len")).select("node", "conv_id")
    ends = ends_digests(written(last.unionByName(convs.where("len = 0").select(F.lit(b"").alias("node"), "conv_id")), "ends"))
    ends = written(ends, "ends")
    total = mine.agg(F.sum("shared").alias("s"), F.sum("leaf").alias("l")).first()
    root = convs.sparkSession.range(1).select(F.lit(b"").alias("node"), F.lit(all_.low).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(all_.n).cast("long").alias("n_convs"), F.lit(n.where("depth = 1").count()).cast("long").alias("n_children"), F.lit(total.l or 1).cast("long").alias("n_leaves"), F.lit(total.s or 0).cast("long").alias("saved_tokens")).where("n_convs > 0")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    found = n.join(sums, "node").select("node", *columns).unionByName(root.select("node", *columns)).join(ends, "node", "left")
    return found.select(*(F.col(c).cast("long").alias(c) for c in columns), F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"))


def op11(spark, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations; see ``rebuilt`` and ``prefix_trie``.

    Nulls and edges: null roles and texts are empty; a null turn comes first and equal
    turns are ordered by digest; rows that repeat are turns of their own; rows without a
    ``conv_id`` are left out; other columns are ignored; an empty table gives no rows.
    """
    turns = written(numbered_turns(written(turn_digests(table(spark, sf_dir, "conversations")), "digests")), "turns")
    convs, again = rebuilt(turns)
    return prefix_trie(convs, again)


#: The table of CRC-32 (polynomial 0xEDB88320, reflected) as a common table ``crc(t)``.
CRC_TABLE_SQL = """
crc AS (SELECT list(list_reduce([n, 0, 1, 2, 3, 4, 5, 6, 7], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t
        FROM (SELECT unnest(range(256)) AS n))"""
_BYTES_SQL = "list_transform(range(1, length(hex(encode({0}))), 2), lambda i: ('0x' || substr(hex(encode({0})), i, 2))::BIGINT)"


def crc_sql(text: str, table_: str = "t") -> str:
    """Unsigned CRC-32 of the UTF-8 bytes of ``text`` where the table ``crc`` is joined as ``table_``."""
    return f"xor(4294967295, list_reduce(list_concat([4294967295], {_BYTES_SQL.format(text)}), lambda c, b: xor(c >> 8, {table_}[(xor(c, b) & 255) + 1])))"


OP11_SQL = rf"""
WITH RECURSIVE {CRC_TABLE_SQL.strip()},
t AS (SELECT conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
        len(regexp_extract_all(coalesce(text, ''), '[^ 	-]+')) AS words
      FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS pos FROM t),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {crc_sql("conv_id::VARCHAR", "crc.t")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t), crc),
r AS (SELECT c.conv_id, 0 AS part, n.pos, digest, words FROM c JOIN n ON n.conv_id = c.base AND n.pos <= h
      UNION ALL SELECT c.conv_id, 1, n.pos, digest, words FROM c JOIN n ON n.conv_id = c.conv_id AND n.pos > h),
p AS (SELECT conv_id, row_number() OVER w AS depth, words, sha256(string_agg(digest, ',') OVER w) AS node
      FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos)),
m AS (SELECT conv_id, depth, words, node FROM p UNION ALL SELECT conv_id, 0, 0, '' FROM c),
e AS (SELECT conv_id, max(depth) AS depth FROM m GROUP BY conv_id),
nodes AS (SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words FROM m GROUP BY node, depth),
linked AS (SELECT x.node, m.node AS up FROM nodes x JOIN m ON m.conv_id = x.conv_id AND m.depth = x.depth - 1),
kids AS (SELECT up AS node, count(*) AS n_children FROM linked GROUP BY up),
way AS (SELECT m.node AS top, x.node, (x.n_convs - 1) * x.words AS saved, kids.node IS NULL AS leaf
        FROM nodes x JOIN m ON m.conv_id = x.conv_id AND m.depth <= x.depth LEFT JOIN kids ON kids.node = x.node),
sums AS (SELECT top AS node, sum(saved) AS saved_tokens, count(*) FILTER (WHERE leaf) AS n_leaves FROM way GROUP BY top),
ends AS (SELECT node, string_agg(m.conv_id::VARCHAR, ',' ORDER BY m.conv_id) AS ids FROM m JOIN e ON e.conv_id = m.conv_id AND e.depth = m.depth GROUP BY node)
SELECT x.conv_id, x.depth, u.conv_id AS parent_conv_id, x.n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
  CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM nodes x JOIN sums USING (node) LEFT JOIN kids USING (node) LEFT JOIN ends USING (node)
LEFT JOIN linked ON linked.node = x.node LEFT JOIN nodes u ON u.node = linked.up
"""
