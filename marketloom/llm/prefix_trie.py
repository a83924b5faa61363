"""Prefix trie of conversations from vertical bitmaps: bitsets of conversations per (position, turn), intersected depth first."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm.common import read_table, written

#: Conversations and turns of one shard at most; a longer conversation is a shard of its own.
SHARD_CONVERSATIONS = 4096
SHARD_TURNS = 200_000
_BATCH = 1 << 14

# A conversation takes its first crc32(id) modulo LONGEST_HEAD + 1 turns from the first conversation of its family.
FAMILY = 5
LONGEST_HEAD = 8


def head_length(conv_id: Column) -> Column:
    return F.pmod(F.crc32(conv_id.cast("string").cast("binary")), F.lit(LONGEST_HEAD + 1)).cast("int")


def rebuilt_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, turn binary, size): the rebuilt conversations, a row of depth 0 for each of them and one per turn.

    Turns are in order of turn (null first), then role and text. A conversation c takes the first h turns of c - c % FAMILY (all
    if it has fewer, none if there is none), then its own turns after the first h. ``turn`` is 128 bits of hash of role and text, ``size`` the
    UTF-8 bytes of the text. Null roles and texts are empty; rows without conv_id belong to none.
    """
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    both = F.concat(*[F.unhex(F.lpad(F.hex(F.xxhash64(F.lit(seed), "role", "text")), 16, "0")) for seed in (1, 2)])
    turns = written(rows.withColumn("place", F.row_number().over(order)).select(
        "conv_id", "place", both.alias("turn"), F.octet_length("text").cast("long").alias("size")), "turns")
    head = head_length(F.col("conv_id"))
    families = turns.groupBy("conv_id").agg(F.count("*").alias("turns")).select(
        "conv_id", "turns", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("family"), head.alias("head"))
    families = written(families, "families")
    lengths = families.select(F.col("conv_id").alias("family"), F.col("turns").alias("family_turns"))
    known = families.join(lengths, "family", "left").select(
        "conv_id", "family", "head", F.least("head", F.coalesce("family_turns", F.lit(0))).cast("int").alias("taken"))
    first = turns.where(F.col("place") <= LONGEST_HEAD).select(F.col("conv_id").alias("family"), "place", "turn", "size")
    taken = known.join(first, "family").where("place <= head").select("conv_id", F.col("place").alias("depth"), "turn", "size")
    own = turns.join(known, "conv_id").where("place > head").select("conv_id", (F.col("place") - F.col("head") + F.col("taken")).alias("depth"), "turn", "size")
    root = families.select("conv_id", F.lit(0).alias("depth"), F.lit(None).cast("binary").alias("turn"), F.lit(0).cast("long").alias("size"))
    return root.unionByName(taken).unionByName(own)


_NODES = pa.schema([("path", pa.binary()), ("above", pa.binary()), ("depth", pa.int64()), ("conv_id", pa.int64()), ("n", pa.int64()), ("size", pa.int64()),
                    ("ends", pa.binary()), ("chain", pa.bool_())])
_NODES_SQL = "path binary, above binary, depth long, conv_id long, n long, size long, ends binary, chain boolean"
ROOT = bytes(16)


def _below(path: bytes, turn: bytes) -> bytes:
    return hashlib.blake2b(path + turn, digest_size=16).digest()


class Shard:
    """Conversations with ascending ids, and for each (position, turn) the bitset of those that have the turn there."""

    def __init__(self):
        self.ids: list[int] = []
        self.turns: list[list[tuple[bytes, int]]] = []
        self.held = 0

    def add(self, conv_id: int, turns: list[tuple[bytes, int]]) -> None:
        self.ids.append(conv_id)
        self.turns.append(turns)
        self.held += len(turns)

    def full(self) -> bool:
        return len(self.ids) >= SHARD_CONVERSATIONS or self.held >= SHARD_TURNS

    def postings(self) -> tuple[dict[tuple[int, bytes], int], dict[int, int]]:
        """Bitsets by (position, turn), and of the conversations that end at a position."""
        members: dict[tuple[int, bytes], list[int]] = {}
        ended: dict[int, list[int]] = {}
        for i, turns in enumerate(self.turns):
            for d, (turn, _) in enumerate(turns):
                members.setdefault((d, turn), []).append(i)
            ended.setdefault(len(turns), []).append(i)
        return {k: _bitset(v) for k, v in members.items()}, {k: _bitset(v) for k, v in ended.items()}

    def nodes(self) -> Iterator[tuple]:
        """(path, above, depth, conv_id, n, size, ends, chain) per node of this shard, depth first; and, with ``chain``, the path of the smallest conversation of each leaf,
        node by node."""
        postings, ended = self.postings()
        stack = [((1 << len(self.ids)) - 1, ROOT, None, 0, 0)]
        trail: list[bytes] = []
        while stack:
            members, path, above, depth, size = stack.pop()
            del trail[depth:]
            trail.append(path)
            first = (members & -members).bit_length() - 1
            here = members & ended.get(depth, 0)
            yield path, above, depth, self.ids[first], members.bit_count(), size, ",".join(str(self.ids[i]) for i in _positions(here)).encode() if here else None, False
            rest = members & ~here
            if not rest:
                for d, p in enumerate(trail):
                    yield p, None, d, self.ids[first], 0, 0, None, True
            while rest:
                lowest = (rest & -rest).bit_length() - 1
                turn, bytes_ = self.turns[lowest][depth]
                child = rest & postings[depth, turn]
                stack.append((child, _below(path, turn), path, depth + 1, bytes_))
                rest &= ~child


def _bitset(members: list[int]) -> int:
    out = bytearray((members[-1] >> 3) + 1)
    for i in members:
        out[i >> 3] |= 1 << (i & 7)
    return int.from_bytes(out, "little")


def _positions(bits: int) -> Iterator[int]:
    data = bits.to_bytes((bits.bit_length() + 7) // 8, "little")
    return (8 * k + j for k, byte in enumerate(data) if byte for j in range(8) if byte >> j & 1)


def _shard_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of rebuilt conversations, in order of conv_id and depth, to the nodes of shards."""
    def packed(shard):
        rows = []
        for row in shard.nodes():
            rows.append(row)
            if len(rows) >= _BATCH:
                yield rows
                rows = []
        if rows:
            yield rows

    def tables(shard):
        for rows in packed(shard):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _NODES)], schema=_NODES)
    shard, current, turns = Shard(), None, []
    for batch in batches:
        for conv_id, turn, size in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if turn is not None:
                turns.append((turn, size))
                continue
            if current is not None:
                shard.add(current, turns)
                if shard.full():
                    yield from tables(shard)
                    shard = Shard()
            current, turns = conv_id, []
    if current is not None:
        shard.add(current, turns)
        yield from tables(shard)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of path and conversation: one digest of all ends of a path."""
    path, digest = None, None
    for batch in batches:
        out = []
        for key, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if key != path:
                if path is not None:
                    out.append((path, digest.hexdigest()))
                path, digest = key, hashlib.sha256(ends)
            else:
                digest.update(b"," + ends)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["path", "digest"])
    if path is not None:
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([digest.hexdigest()])], ["path", "digest"])


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    Conversations are dealt into shards of ascending ids. A shard finds its nodes by intersecting bitsets and returns, per node, its members' number
    and smallest id and the list of those that end there; Spark adds the shards' nodes by a 128-bit hash of the path. A common
    first turn thus has one row per shard. Sums over subtrees take one pass, whatever the depth: the conversations of the leaves are chains through the
    trie that hold all its nodes; each node is counted on the chain with the smallest id among those through it, suffix sums run along chains, and
    the sums of the chains through a node are its subtree's.

    Null roles and texts are empty texts; rows without conv_id are left out; equal turns at one place count as one turn each, in order; a conversation
    without turns ends at the root; repeated conversations are members of the same nodes. An empty table gives no rows. Other columns are not read.
    The end list of a node is hashed in order by one task, as the digest asks for, from one row per shard.
    """
    rebuilt = rebuilt_turns(conversations)
    ordered = rebuilt.repartitionByRange("conv_id").sortWithinPartitions("conv_id", "depth").select("conv_id", "turn", "size")
    found = written(ordered.mapInArrow(_shard_nodes, _NODES_SQL), "shards")
    parts, chains = found.where("not chain"), found.where("chain").select("path", "depth", F.col("conv_id").alias("chain"))
    nodes = written(parts.groupBy("path").agg(F.any_value("above").alias("above"), F.any_value("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
                                              F.sum("n").alias("n_convs"), F.any_value("size").alias("size")), "nodes")
    children = nodes.where("above is not null").groupBy("above").agg(F.count("*").alias("n_children")).select(F.col("above").alias("path"), "n_children")
    counted = written(nodes.join(children, "path", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "counted")
    leaves = counted.where("n_children = 0").select(F.col("conv_id").alias("chain"))
    through = written(chains.join(leaves, "chain", "left_semi"), "through")
    owners = through.groupBy("path").agg(F.min("chain").alias("owner"), F.count("*").alias("n_leaves"))
    worth = written(counted.join(owners, "path").select("path", "owner", "n_leaves", ((F.col("n_convs") - 1) * F.col("size")).alias("saved")), "worth")
    deeper = Window.partitionBy("chain").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    own = F.when(F.col("owner") == F.col("chain"), F.col("saved")).otherwise(F.lit(0))
    sums = through.join(worth, "path").select("path", F.sum(own).over(deeper).alias("below")).groupBy("path").agg(F.sum("below").alias("saved_tokens"))
    ends = parts.where("ends is not null").select("path", "ends", "conv_id", F.regexp_extract(F.col("ends").cast("string"), r"^-?\d+", 0).cast("long").alias("first"))
    digests = ends.repartition("path").sortWithinPartitions("path", "first").select("path", "ends").mapInArrow(_hashed, "path binary, digest string")
    parents = counted.select(F.col("path").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    whole = counted.join(sums, "path").join(worth.select("path", "n_leaves"), "path").join(digests, "path", "left").join(parents, "above", "left")
    return whole.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                        F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """``prefix_trie`` of all conversations; rows and defined cases are its own."""
    return prefix_trie(read_table(spark, sf_dir, "conversations"))


#: crc32 bit by bit: a list of a byte's eight steps for each byte of the decimal id.
OP12_SQL = """
with recursive bits as (
  select conv_id, 4294967295::bigint as c, 0 as k, cast(conv_id as varchar) as s from (select distinct conv_id from conversations where conv_id is not null)
  union all
  select conv_id, case when x % 2 = 1 then xor(x // 2, 3988292384::bigint) else x // 2 end, k + 1, s
  from (select conv_id, k, s, case when k % 8 = 0 then xor(c, ascii(s[k // 8 + 1])::bigint) else c end as x from bits where k < 8 * length(s))),
heads as (select conv_id, conv_id - conv_id % 5 as family, xor(c, 4294967295::bigint) % 9 as h from bits where k = 8 * length(s)),
turns as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as place from conversations where conv_id is not null),
built as (select h.conv_id, place, role, text from heads h join turns t on t.conv_id = h.family and t.place <= h.h
  union all select h.conv_id, 100 + place, role, text from heads h join turns t on t.conv_id = h.conv_id and t.place > h.h),
placed as (select conv_id, row_number() over (partition by conv_id order by place) as d,
    sha256(role || chr(31) || text) as turn, octet_length(encode(text)) as size from built),
prefixes as (select conv_id, 0 as d, '' as path, 0 as size from heads
  union all select conv_id, d, string_agg(turn, '') over (partition by conv_id order by d), size from placed),
lengths as (select conv_id, max(d) as len from prefixes group by 1),
nodes as (select path, any_value(d) as d, min(conv_id) as conv_id, count(*) as n, any_value(size) as size,
    coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (d = len), '') as ends
  from prefixes join lengths using (conv_id) group by path),
counted as (select v.*, (select count(*) from nodes c where c.d = v.d + 1 and starts_with(c.path, v.path)) as n_children from nodes v)
select v.conv_id::bigint as conv_id, v.d::bigint as depth, p.conv_id::bigint as parent_conv_id, v.n::bigint as n_convs, v.n_children::bigint as n_children,
  count(*) filter (u.n_children = 0)::bigint as n_leaves, sum((u.n - 1) * u.size)::bigint as saved_tokens, sha256(v.ends) as ends_sha256
from counted v join counted u on u.d >= v.d and starts_with(u.path, v.path)
left join counted p on v.d > 0 and p.d = v.d - 1 and starts_with(v.path, p.path)
group by v.conv_id, v.d, p.conv_id, v.n, v.n_children, v.ends
"""
