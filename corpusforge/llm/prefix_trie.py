"""The prefix trie of conversations by truncation peeling.

A conversation is a path: one cell of CELL bytes per turn, a 128-bit digest of role and text and the number of the text's code
points.  Peeling starts at the greatest depth: the nodes there are the distinct paths of conversations that end there.  Their
last cells are stripped, and what is left is grouped anew together with the conversations that end one turn earlier, and so
on up to the root.  Every grouping finds the nodes of one depth and adds up what their subtrees hold, so one pass over the
depths discovers the trie and aggregates it.

Subtrees of up to SUBTREE_BYTES of paths are peeled whole inside a task, all of their depths after one shuffle; what lies above
them, few depths as a rule, is peeled depth by depth over the cluster.  So a single very long conversation costs no job per turn.
Each depth of the upper part is written once, so that a lost executor repeats one depth only.
"""

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from corpusforge.functions.scale import lookup, sliced
from corpusforge.session import new_folder, stored

#: Bytes of a cell: 16 of the digest, 4 of the text's length.
CELL = 20
#: Turns that a rebuilt conversation takes from the first one of its hundred, at most.
HEAD = 5
#: Conversation ids of one node that are joined into one string.
FRAGMENT = 512
#: Bytes of distinct whole paths under a node that are peeled in one task; a single path may be longer.
SUBTREE_BYTES = 1 << 20
_NOTHING = hashlib.sha256(b"").hexdigest()


def _cell() -> Column:
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    return F.unhex(F.concat(F.substring(digest, 1, 32), F.lpad(F.hex(F.length(text)), 8, "0")))


def paths(turns: DataFrame) -> DataFrame:
    """(conv_id, path) of every conversation of ``turns(conv_id, turn, role, text)``.

    Turns are ordered by ``turn``, null first; turns of equal number stand in the order of their digests, repeated rows stay
    apart.  Null role or text is empty.  Rows without conv_id belong to no conversation and are left out.  Other columns are
    ignored.  Only cells are shuffled, no text; a path is one value, CELL bytes a turn.
    """
    cells = turns.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").alias("turn"), _cell().alias("cell")).alias("at"))
    return cells.groupBy("conv_id").agg(F.sort_array(F.collect_list("at")).alias("ats")).select(
        "conv_id", F.unhex(F.array_join(F.transform("ats", lambda x: F.hex(x["cell"])), "")).alias("path"))


def rebuilt(own: DataFrame) -> DataFrame:
    """Every path with its first h cells taken from conversation ``conv_id - conv_id % 100`` (all if that has fewer, none if
    it is absent) and the rest from its own cells after the first h; h = crc32(decimal conv_id) % 6."""
    heads = own.filter(F.col("conv_id") % 100 == 0).select(
        F.col("conv_id").alias("_base"), F.substring("path", 1, CELL * HEAD).alias("_head"))
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (HEAD + 1)).cast("int") * CELL
    keyed = own.select("conv_id", "path", taken.alias("_h"), (F.col("conv_id") - F.col("conv_id") % 100).alias("_base"))
    empty = F.lit(b"")
    return keyed.join(heads, "_base", "left").select(
        "conv_id", F.concat(F.coalesce(F.expr("substring(_head, 1, _h)"), empty),
                            F.expr("substring(path, _h + 1)")).alias("path"))


def _ends(members: DataFrame) -> DataFrame:
    """(path, conv_id, n_convs, ends_sha256): distinct whole paths, their smallest and number of conversations, and the digest
    of all their ids.

    Ids are joined in range slices first, FRAGMENT at a time.  A digest is sequential, so one task hashes the fragments of a
    node, one after the other, with no more than a batch of them in memory, however many conversations are equal.
    """
    narrow = members.select(F.sha2("path", 256).alias("node"), "conv_id")
    cut = sliced(narrow, ["node"], [F.asc("conv_id")])
    numbered = cut.withColumn("block", F.floor((F.row_number().over(
        Window.partitionBy("node", "_slice").orderBy("conv_id")) - 1) / FRAGMENT))
    fragments = numbered.groupBy("node", "_slice", "block").agg(
        F.min("conv_id").alias("low"), F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    ordered = fragments.repartition("node").sortWithinPartitions("node", "low", "_slice", "block").select("node", "ids")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            done = []
            for key, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if key != node:
                    if node is not None:
                        done.append((node, state.hexdigest()))
                    node, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.string()) for i in (0, 1)],
                                             names=["node", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (node, state.hexdigest())], names=["node", "ends_sha256"])

    whole = members.groupBy("path").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    return whole.withColumn("node", F.sha2("path", 256)).join(
        ordered.mapInArrow(digest, "node string, ends_sha256 string"), "node").drop("node")


def _stripped(nodes: DataFrame) -> DataFrame:
    """Nodes as what they add to their parents: the last cell goes."""
    return nodes.select(F.expr(f"substring(path, 1, length(path) - {CELL})").alias("path"), "conv_id", "n_convs",
                        F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved_tokens",
                        F.lit(None).cast("string").alias("ends_sha256"))


_NODE = "conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def _peeled(rows: list[tuple], cut: int) -> Iterator[tuple]:
    """Nodes of one subtree, deepest first, from its ended (path, conv_id, n_convs, ends_sha256); its top node is at depth
    ``cut``.  All nodes but the top come with their parent's conv_id, the top comes with its path."""
    ended: dict[int, list] = {}
    for row in rows:
        ended.setdefault(len(row[0]) // CELL, []).append(row)
    below: dict[bytes, list] = {}
    for depth in range(max(ended), cut - 1, -1):
        level = {path: [conv, n, 0, 0, 0, ends] for path, conv, n, ends in ended.get(depth, ())}
        for path, (conv, n, _, leaves, saved, _) in below.items():
            node = level.setdefault(path[:-CELL], [conv, 0, 0, 0, 0, _NOTHING])
            node[0] = min(node[0], conv)
            node[1] += n
            node[2] += 1
            node[3] += leaves
            node[4] += saved
        for path, node in level.items():
            node[3] = max(node[3], 1)
            node[4] += (node[1] - 1) * int.from_bytes(path[-4:], "big")
        for path, node in below.items():
            yield (None, level[path[:-CELL]][0], node[0], depth + 1, *node[1:])
        below = level
    for path, node in below.items():
        yield (path, None, node[0], cut, *node[1:])


def _subtrees(assigned: DataFrame) -> DataFrame:
    """All nodes under and at the tops: path (of tops), parent_conv_id (of others), and the columns of a node.

    ``assigned`` has ended paths with ``key``, the path of their subtree's top.
    """
    kinds = [pa.binary(), *[pa.int64()] * 7, pa.string()]
    names = ["path", "parent_conv_id", *[c.split()[0] for c in _NODE.split(", ")]]

    def batch(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def peel_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out = None, [], []
        for whole in batches:
            for own, *row in zip(*(whole.column(c).to_pylist() for c in ("key", "path", "conv_id", "n_convs", "ends_sha256")), strict=True):
                if own != key:
                    if rows:
                        for node in _peeled(rows, len(key) // CELL):
                            out.append(node)
                            if len(out) == 10_000:
                                yield batch(out)
                                out = []
                    key, rows = own, []
                rows.append(row)
        if rows:
            out.extend(_peeled(rows, len(key) // CELL))
        for k in range(0, len(out), 10_000):
            yield batch(out[k:k + 10_000])

    dealt = assigned.select("key", "path", "conv_id", "n_convs", "ends_sha256").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(peel_groups, f"path binary, parent_conv_id long, {_NODE}")


def _assign(ended: DataFrame) -> tuple[list[DataFrame], list[DataFrame], int]:
    """Ended paths in subtrees small enough for a task, with ``key``; those that end above such subtrees; the deepest top.

    Tops are sought ever deeper, and only under nodes that still hold too much.
    """
    assigned, short, pending, cut = [], [ended.filter("depth = 0")], ended.filter("depth > 0"), 1
    while True:
        keyed = pending.withColumn("key", F.substring("path", 1, CELL * cut))
        # At most one of these nodes per SUBTREE_BYTES of all paths.
        large = stored(keyed.groupBy("key").agg(F.sum(F.length("path") + 64).alias("size"), F.count("*").alias("n"))
                       .filter((F.col("size") > SUBTREE_BYTES) & (F.col("n") > 1)).select("key"), "trie-large")
        assigned.append(keyed.join(large, "key", "left_anti"))
        if large.isEmpty():
            return assigned, short, cut
        rest = stored(keyed.join(large, "key", "left_semi").drop("key"), "trie-pending")
        following = cut + max(1, cut // 2)
        short.append(rest.filter(F.col("depth") < following))
        pending, cut = rest.filter(F.col("depth") >= following), following


def _union(tables: list[DataFrame]) -> DataFrame:
    whole = tables[0]
    for table in tables[1:]:
        whole = whole.unionByName(table)
    return whole


def peel(members: DataFrame) -> DataFrame:
    """All nodes of the trie of ``members(conv_id, path)``: conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.  An empty table has no nodes."""
    spark = members.sparkSession
    ended = stored(_ends(members).withColumn("depth", F.expr(f"length(path) div {CELL}")), "trie-ends")
    assigned, short, top = _assign(ended)
    subtrees = stored(_subtrees(_union(assigned)), "trie-subtrees")
    tops = subtrees.filter("path is not null")
    above = stored(_union(short).select(
        "path", "conv_id", "depth", "n_convs", *[F.lit(0).cast("long").alias(c) for c in ("n_children", "n_leaves", "saved_tokens")],
        "ends_sha256"), "trie-above")
    size = F.when(F.length("path") > 0, F.conv(F.hex(F.expr("substring(path, -4)")), 16, 10).cast("long")).otherwise(0)
    folder, below = new_folder(spark, "trie"), None
    for depth in range(top, -1, -1):
        # Tops of this depth are nodes already; one depth up they are stripped with the others.
        meeting = above.filter(F.col("depth") == depth).drop("depth").unionByName(
            _stripped(tops.filter(F.col("depth") == depth + 1)))
        if below is not None:
            meeting = meeting.unionByName(_stripped(below))
        sums = meeting.groupBy("path").agg(
            F.min("conv_id").alias("conv_id"), F.max("ends_sha256").alias("ends_sha256"),
            *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])
        nodes = sums.select(
            "path", "conv_id", "n_convs", "n_children", F.greatest("n_leaves", F.lit(1).cast("long")).alias("n_leaves"),
            (F.col("saved_tokens") + (F.col("n_convs") - 1) * size).alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(_NOTHING)).alias("ends_sha256"))
        nodes.write.parquet(f"{folder}/depth={depth}")
        below = spark.read.schema(nodes.schema).parquet(f"{folder}/depth={depth}")
    # All depths of the upper part are one table by now.
    upper = spark.read.schema(StructType([*nodes.schema.fields, StructField("depth", LongType())])).parquet(folder)
    meeting = upper.unionByName(tops.drop("parent_conv_id"))
    keyed = meeting.withColumn("_parent", F.expr(f"substring(path, 1, length(path) - {CELL})")).drop("path")
    parents = upper.select(F.col("path").alias("_parent"), F.col("conv_id").alias("parent_conv_id"))
    # A node may have a child for every conversation (different first turns): such parents are split.
    joined = lookup(keyed.filter("depth > 0"), parents, ["_parent"], ["conv_id"])
    root = keyed.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return _union([t.select(*columns) for t in (subtrees.filter("path is null"), joined, root)])


def prefix_trie(turns: DataFrame, rebuild: bool = True) -> DataFrame:
    """One row per node of the trie of all conversations (of rebuilt ones, see ``rebuilt``, unless told otherwise).

    Columns: conv_id, depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    Nulls, ties, repeated rows and extra columns as in ``paths``; turns of any length count by their code points.
    """
    own = stored(paths(turns), "trie-paths")
    return peel(stored(rebuilt(own), "trie-rebuilt") if rebuild else own)


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """Every node of the trie of all rebuilt conversations."""
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE = """
with turns as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
         row_number() over (partition by conv_id order by turn nulls first) as i
  from conversations where conv_id is not null),
own as (select conv_id, list({'role': role, 'text': text} order by i) as turns from turns group by conv_id),
h0 as (
  select conv_id, turns, conv_id::varchar as s from own),
crc as (
  -- crc32 by its bitwise rule over the decimal digits
  select conv_id, turns, list_reduce(
      list_prepend(4294967295::ubigint, list_transform(string_split(s, ''), lambda d: ascii(d)::ubigint)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda k: k::ubigint)),
        lambda x, k: xor(x >> 1, (x & 1::ubigint) * 3988292384::ubigint))) as c
  from h0),
hs as (select conv_id, turns, (xor(c, 4294967295::ubigint) % 6)::bigint as h from crc),
rebuilt as (
  select a.conv_id, list_concat(coalesce(b.turns[1:a.h], []), a.turns[a.h + 1:]) as turns
  from hs a left join own b on b.conv_id = a.conv_id - a.conv_id % 100),
prefixes as (
  select conv_id, unnest(range(len(turns) + 1)) as depth, turns from rebuilt),
placed as (select conv_id, depth, turns[1:depth] as path, len(turns) = depth as ends from prefixes),
nodes as (
  select depth, path, min(conv_id) as conv_id, count(*) as n_convs,
         coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where ends), '') as ids
  from placed group by depth, path),
kids as (select depth - 1 as depth, path[1:depth - 1] as path, count(*) as n_children from nodes where depth > 0 group by all),
full_nodes as (
  select n.*, coalesce(k.n_children, 0) as n_children, (n.n_convs - 1) * coalesce(length(n.path[n.depth].text), 0) as saved
  from nodes n left join kids k on k.depth = n.depth and k.path = n.path),
under as (
  select d as depth, path[1:d] as path, count(*) filter (where n_children = 0) as n_leaves, sum(saved)::bigint as saved_tokens
  from (select path, n_children, saved, unnest(range(depth + 1)) as d from full_nodes) group by all)
select n.conv_id, n.depth, p.conv_id as parent_conv_id, n.n_convs, n.n_children, u.n_leaves, u.saved_tokens,
       sha256(n.ids) as ends_sha256
from full_nodes n join under u on u.depth = n.depth and u.path = n.path
left join nodes p on p.depth = n.depth - 1 and p.path = n.path[1:n.depth - 1]
"""
