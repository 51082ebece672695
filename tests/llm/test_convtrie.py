"""The conversation trie against nodes made one by one."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from webquarry.llm import convtrie, registry

SF = "/root/testdata/sf0.001"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    """All nodes by prefixes as tuples."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
        ends[whole].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, own in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += (len(own) - 1) * len(node[-1][1]) if node else 0
    for node, own in members.items():
        done = ",".join(map(str, sorted(ends.get(node, []))))
        yield (min(own), len(node), min(members[node[:-1]]) if node else None, len(own), children.get(node, 0), leaves[node], saved[node],
               hashlib.sha256(done.encode()).hexdigest())


def key(row):
    return row[0], row[1]


def check(spark, rows, **sizes):
    """`rows` beside other columns with clashing names."""
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, key string, seg int")
    got = [tuple(r[c] for c in COLUMNS) for r in convtrie.trie(frame, **sizes).collect()]
    assert sorted(got, key=key) == sorted(plain(rows), key=key)


def test_query(spark):
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{SF}/conversations.parquet'").fetchall()
    got = [tuple(r[c] for c in COLUMNS) for r in registry.QUERIES["op12_conversation_trie"](spark, SF).collect()]
    assert sorted(got, key=key) == sorted(plain(rows), key=key)


def random_rows(seed, convs, most, words):
    rnd = random.Random(seed)
    return [(c, t, rnd.choice(["user", "assistant"]) if words > 2 else "user", "w" * rnd.randint(0, words))
            for c in rnd.sample(range(400), convs) for t in range(rnd.randint(1, most))]


def test_small_shards(spark):
    """Shared first turns and many equal prefixes over shards of four rows."""
    check(spark, random_rows(1, 150, 6, 2), shard=4)


def test_long_conversations(spark):
    """Conversations over several segments, some of them equal up to a segment's end."""
    rows = random_rows(2, 60, 14, 1) + [(c, t, "user", "w" * (t == 9 and c == 902)) for c in (900, 901, 902, 903) for t in range(14 if c != 903 else 9)]
    check(spark, rows, shard=5, length=3)


def test_one_very_long_conversation(spark):
    check(spark, [(7, t, "user", str(t % 5)) for t in range(300)] + [(100, 0, "user", "0"), (101, 0, "user", "0")], shard=8, length=4)


def test_edges(spark):
    """Nulls everywhere, ties, repeated rows, conversations without turns after their head, absent sources, large ids."""
    rows = [(1, None, None, "a"), (1, 0, "user", None), (1, 0, "user", None), (1, 0, "assistant", "b"), (None, 1, "user", "x"), (2, 1, "user", "é👍"),
            (300, 0, "user", "hello"), (300, 1, "user", ""), *[(300 + k, 0, "user", f"t{k % 3}") for k in range(1, 40)], (2**60 + 1, 5, "user", "big"), (-150, 1, "user", "n")]
    check(spark, rows)


def test_empty(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert convtrie.trie(empty).count() == 0
    assert convtrie.trie(spark.createDataFrame([(None, 1, "user", "x")], empty.schema)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_double_array(seed):
    rnd, array = random.Random(seed), convtrie.DoubleArray()
    made, open_states = {}, [0]
    for _ in range(400):
        state = open_states.pop(rnd.randrange(len(open_states)))
        turns = sorted(rnd.sample(range(200), rnd.choice([1, 1, 1, 2, 9])))
        made[state] = dict(zip(turns, array.pack(state, turns)))
        open_states += made[state].values()
    base, check_ = array.arrays()
    for state, children in made.items():
        for t in range(200):
            to = base[state] + t
            assert (0 < to < len(check_) and check_[to] == state) == (t in children)
