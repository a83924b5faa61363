"""Prefix trie of rebuilt conversations, against sets of prefixes, at many sizes of shards."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from marketloom.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    own = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            own[conv_id].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        family = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = own.get(family, [])[:h] + turns[h:]
    return out


def brute(rows):
    built, members, below = rebuilt(rows), defaultdict(list), defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    for p in members:
        if p:
            below[p[:-1]].append(p)
    leaves, saved, out = {}, {}, set()
    for p in sorted(members, key=len, reverse=True):
        n = len(members[p])
        leaves[p] = sum(leaves[k] for k in below[p]) if below[p] else 1
        saved[p] = (n - 1) * (len(p[-1][1].encode()) if p else 0) + sum(saved[k] for k in below[p])
        ends = ",".join(str(c) for c in members[p] if len(built[c]) == len(p))
        out.add((members[p][0], len(p), members[p[:-1]][0] if p else None, n, len(below[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


@pytest.fixture(scope="module")
def rows():
    """Conversations of few different turns, so that prefixes meet; absent families, one very long conversation, ties, nulls, negative ids."""
    rng = random.Random(5)
    out = []
    for c in [*range(-12, 150), 1001, 1002, 1003, 10**12, 10**12 + 1]:
        if c % 7 == 3:
            continue
        for t in range(rng.randrange(1, 9)):
            out.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "user", "assistant", None]), rng.choice(["a", "b", "bé", "", None])))
    out += [(60, t, "user", "a" * (t % 3)) for t in range(700)] + [(61, t, "user", "a" * (t % 3)) for t in range(700)]
    out += [(None, 0, "user", "lost")]
    return out


@pytest.mark.parametrize("shard", [1, 3, 4096])
def test_equals_brute_force(spark, rows, monkeypatch, shard):
    monkeypatch.setattr(prefix_trie, "SHARD_CONVERSATIONS", shard)
    conversations = spark.createDataFrame(rows, SCHEMA).withColumn("depth", F.lit("x")).withColumn("path", F.lit(1)).repartition(5)
    got = [tuple(r) for r in prefix_trie.prefix_trie(conversations).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_many_equal_conversations(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SHARD_CONVERSATIONS", 64)
    rows = [(c, t, "user", "same" if t < 2 else f"{c % 2}") for c in range(0, 3000, 5) for t in range(3)]
    assert {tuple(r) for r in prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA)).collect()} == brute(rows)


def test_sql_and_empty_table(spark, rows):
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    small = [r for r in rows if r[0] not in (60, 61)]
    con.executemany("insert into conversations values (?, ?, ?, ?)", small)
    assert set(con.execute(prefix_trie.OP12_SQL).fetchall()) == brute(small)
    assert prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_on_the_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {tuple(r) for r in prefix_trie.op12_prefix_trie(spark, sf).collect()} == brute(rows)


def test_bitsets():
    members = [0, 3, 8, 4095]
    bits = prefix_trie._bitset(members)
    assert list(prefix_trie._positions(bits)) == members and bits.bit_count() == 4
