"""Conversation prefix trie: double-array tries of shards of conversations, their shared upper nodes merged over all shards.

Method. Turns are known by 16 bytes of a hash of role and text. A conversation is a row of turns, cut into segments of `SEGMENT` turns; a segment
knows its prefix, the turns before it, by a key. Equal segments of one prefix are made one row with counts before anything else. These rows
are sorted by prefix and turns and dealt out by ranges: a shard is an interval of prefixes in depth-first order, of bounded size. A task numbers the
turns of its shard densely and packs a double array: the child of state s by turn t is BASE[s] + t, and CHECK holds s there. Walking the rows
through it gives each state its members; from the leaves upwards come leaves and savings.

Two shards share no node but those on the path of a shard's first or last row, as all rows between are its own. These nodes, roots and the paths
to nodes at a segment's end are the upper ones: a shard gives them with the sums of what hangs below them in that shard alone, and they are merged
over all shards by key. Sums then go from each upper node to its ancestors, no more than `SEGMENT` of them, and from segment to
segment by doubling, in as many rounds as the logarithm of the longest conversation.

Scale. Shuffles carry hashes and numbers, no text. Turns are ranked by ranges, so one conversation may hold a third of all rows; a hot
first turn, or copies of a conversation, fill no shard beyond its size. The ids that end at a node are hashed in order as they stream by.

Defined results: null role or text is empty; rows without a conversation id take no part; turns of one number stand in the order of their roles, then
of a hash of their text, and rows that repeat are turns like others; empty texts are turns of no saving; an empty table has no nodes, not even
a root; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webquarry.llm import common
from webquarry.operators.batch import ranked

#: Turns of a segment, and distinct segments of a shard, about.
SEGMENT, SHARD = 32, 8192
#: Segments of a conversation that are summed up together.
RUN = 1024
#: Conversations of one hundred share the first turns of the first of them, up to five.
GROUP, MOST = 100, 6
_KEY = 16
_NONE = hashlib.sha256().hexdigest()


def rebuilt(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Turns (conv, place, key, size, total) of the conversations with shared first turns, and conversations (conv, total).

    Conversation c begins with the first h turns of c - c % 100, h = crc32(c) % 6, and goes on with its own after its first h."""
    role_, text_ = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    # the length of the role parts it from the text
    key = F.unhex(F.substring(F.sha2(F.concat(F.length(role_).cast("string"), F.lit(":"), role_, text_), 256), 1, 2 * _KEY))
    slim = conversations.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv"), F.col(turn).alias("turn"), role_.alias("role"), key.alias("key"), F.length(text_).cast("long").alias("size"))
    turns = common.cut(ranked(slim, "conv", ["turn", "role", "key"], "at").select("conv", F.col("at").cast("long").alias("at"), "key", "size"))
    sizes = turns.groupBy("conv").agg(F.count("*").alias("n"))
    sources = sizes.where(F.col("conv") % GROUP == 0).select(F.col("conv").alias("source"), F.col("n").alias("n_source"))
    h = F.crc32(F.col("conv").cast("string")) % MOST
    convs = sizes.withColumns({"h": h, "source": F.col("conv") - F.col("conv") % GROUP}).join(sources, "source", "left")
    head = F.least("h", F.coalesce("n_source", F.lit(0)))
    convs = common.cut(convs.select("conv", "source", "h", head.alias("head"), (head + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total")))
    own = turns.join(convs, "conv").where("at >= h").select("conv", (F.col("at") - F.col("h") + F.col("head")).alias("place"), "key", "size", "total")
    first = turns.where((F.col("conv") % GROUP == 0) & (F.col("at") < MOST)).withColumnRenamed("conv", "source")
    shared = convs.join(first, "source").where("at < h").select("conv", F.col("at").alias("place"), "key", "size", "total")
    return own.unionByName(shared), convs.select("conv", "total")


def segments(turns: DataFrame, convs: DataFrame, length: int = SEGMENT) -> DataFrame:
    """conv, seg, pre (key of the turns before), body (keys of the turns), sizes, next (key at the end of a full segment), ended."""
    parts = turns.groupBy("conv", F.floor(F.col("place") / length).cast("long").alias("seg")).agg(
        F.sort_array(F.collect_list(F.struct("place", "key", "size"))).alias("t"), F.max("total").alias("total"))
    body = F.aggregate("t", F.lit(b""), lambda done, t: F.concat(done, t["key"]))
    parts = parts.select("conv", "seg", body.alias("body"), F.transform("t", lambda t: t["size"]).alias("sizes"), "total",
                         (F.col("total") <= (F.col("seg") + 1) * length).alias("ended"))
    empty = convs.where("total = 0").select("conv", F.lit(0).cast("long").alias("seg"), F.lit(b"").alias("body"),
                                            F.array().cast("array<bigint>").alias("sizes"), "total", F.lit(True).alias("ended"))
    parts = common.cut(parts.unionByName(empty))
    # a prefix's key: two sums of hashes of its segments, each with its place; runs of segments are summed up first
    hashed = parts.where(F.col("total") >= length).select("conv", "seg", *[F.xxhash64("body", "seg", F.lit(k)).cast("decimal(38,0)").alias(f"x{k}") for k in (0, 1)])
    hashed = hashed.withColumn("run", F.floor(F.col("seg") / RUN))
    before = Window.partitionBy("conv").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = hashed.groupBy("conv", "run").agg(*[F.sum(x).alias(x) for x in ("x0", "x1")])
    none = F.lit(0).cast("decimal(38,0)")
    runs = runs.select("conv", "run", *[F.coalesce(F.sum(x).over(before), none).alias(f"b{x}") for x in ("x0", "x1")])
    inside = Window.partitionBy("conv", "run").orderBy("seg").rowsBetween(Window.unboundedPreceding, 0)
    upto = hashed.select("conv", "seg", "run", "x0", "x1", *[F.sum(x).over(inside).alias(f"s{x}") for x in ("x0", "x1")]).join(runs, ["conv", "run"])
    end = [F.col(f"b{x}") + F.col(f"s{x}") for x in ("x0", "x1")]
    name = lambda at, sums: F.concat_ws(":", at.cast("string"), *[s.cast("string") for s in sums])
    known = upto.select(
        "conv", "seg", F.when(F.col("seg") > 0, name(F.col("seg"), [e - F.col(x) for e, x in zip(end, ("x0", "x1"))])).otherwise("").alias("pre"),
        name(F.col("seg") + 1, end).alias("next"))
    short = parts.where(F.col("total") < length).withColumns({"pre": F.lit(""), "next": F.lit(None).cast("string")})
    full = F.when(F.length("body") == length * _KEY, F.col("next"))
    return short.unionByName(parts.where(F.col("total") >= length).join(known, ["conv", "seg"])).withColumn("next", full).drop("total")


def distinct_segments(parts: DataFrame) -> DataFrame:
    """seg, pre, body, sizes, next, n (conversations), first (the smallest), ends (hash of the ids that end there, null if none)."""

    def hashes(batches):
        import pyarrow as pa

        key, running = None, None
        for batch in batches:
            keys, ids, out = batch.column("k").to_pylist(), batch.column("conv").to_pylist(), []
            for k, conv in zip(keys, ids):
                if k != key:
                    if running:
                        out.append((key, running.hexdigest()))
                    key, running = k, hashlib.sha256(str(conv).encode())
                else:
                    running.update(f",{conv}".encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["k", "ends"])
        if running:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([running.hexdigest()])], names=["k", "ends"])

    parts = common.cut(parts.withColumn("k", F.unhex(F.substring(F.sha2(F.concat(F.col("pre").cast("binary"), F.lit(b"/"), "body"), 256), 1, 2 * _KEY))))
    ids = parts.where("ended").select("k", "conv").repartition("k").sortWithinPartitions("k", "conv")
    ends = ids.mapInArrow(hashes, "k binary, ends string")
    found = parts.groupBy("k", "seg").agg(
        F.count("*").alias("n"), F.min("conv").alias("first"), *[F.min(c).alias(c) for c in ("pre", "body", "sizes", "next")])
    return common.cut(found.join(ends, "k", "left").drop("k"))


class DoubleArray:
    """BASE and CHECK over dense turn ids: the child of state s by turn t is base[s] + t, if check holds s there. State 0 is the root."""

    def __init__(self):
        self.base, self.check = [0], [0]
        self.free = 1

    def pack(self, state: int, turns: list[int]) -> list[int]:
        """Give a state its children, by ascending turns; their states."""
        check = self.check
        while self.free < len(check) and check[self.free] >= 0:
            self.free += 1
        # the first place where all fit, among the next few; else behind the last state
        for at in range(self.free, min(self.free + 64, len(check))):
            shift = at - turns[0]
            if all(shift + t >= len(check) or check[shift + t] < 0 for t in turns):
                break
        else:
            shift = max(len(check), self.free) - turns[0]
        more = shift + turns[-1] + 1 - len(check)
        if more > 0:
            check += [-1] * more
            self.base += [0] * more
        self.base[state] = shift
        states = [shift + t for t in turns]
        for s in states:
            check[s] = state
        return states

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        return np.array(self.base, np.int64), np.array(self.check, np.int64)


class Shard:
    """The trie of a shard's sorted rows, as a double array, and what its walk gives by state."""

    def __init__(self, rows: list[dict]):
        self.rows = rows
        roots: dict[tuple, int] = {}
        number: dict[bytes, int] = {}
        paths = []
        for r in rows:
            root = roots.setdefault((r["seg"], r["pre"]), len(roots))
            paths.append([root, *(number.setdefault(r["body"][k : k + _KEY], len(number)) for k in range(0, len(r["body"]), _KEY))])
        # roots come before turns
        self.length = np.array([len(p) for p in paths])
        self.turns = np.full((len(rows), self.length.max()), -1)
        for k, p in enumerate(paths):
            self.turns[k, : len(p)] = p
        inner = self.turns[:, 1:]
        inner[inner >= 0] += len(roots)
        self._pack()
        self._walk()

    def _pack(self) -> None:
        """States level by level: rows of one prefix stand next to each other, so a node's children are the changes below it."""
        array, state, new = DoubleArray(), np.zeros(len(self.rows), np.int64), np.zeros(len(self.rows), bool)
        for d in range(self.turns.shape[1]):
            here = np.flatnonzero(self.length > d)
            turns, parents = self.turns[here, d], state[here]
            other = np.r_[True, (parents[1:] != parents[:-1]) | (turns[1:] != turns[:-1])]
            firsts = np.flatnonzero(other)
            starts = np.flatnonzero(np.r_[True, parents[firsts][1:] != parents[firsts][:-1]])
            made = np.zeros(len(firsts), np.int64)
            p, t = parents[firsts].tolist(), turns[firsts]
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(firsts)]):
                order = np.argsort(t[s:e], kind="stable")
                made[s + order] = array.pack(p[s], t[s:e][order].tolist())
            state[here] = made[np.cumsum(other) - 1]
        self.base, self.check = array.arrays()

    def _walk(self) -> None:
        """Members, smallest member, size of the last text, depth and place on an upper path, by state."""
        n = len(self.base)
        self.members, self.size, self.depth = (np.zeros(n, np.int64) for _ in range(3))
        self.first = np.full(n, np.iinfo(np.int64).max)
        self.row, self.upper = np.full(n, -1), np.zeros(n, bool)
        many, least = (np.array([r[c] for r in self.rows], np.int64) for c in ("n", "first"))
        full = np.array([r["next"] is not None for r in self.rows])
        full[[0, -1]] = True
        state = np.zeros(len(self.rows), np.int64)
        for d in range(self.turns.shape[1]):
            here = np.flatnonzero(self.length > d)
            to = self.base[state[here]] + self.turns[here, d]
            if (self.check[to] != state[here]).any():
                raise AssertionError("a row left the trie")
            state[here] = to
            np.add.at(self.members, to, many[here])
            np.minimum.at(self.first, to, least[here])
            self.depth[to], self.row[to] = d, here
            self.upper[to[full[here]]] = True
            if d == 0:
                self.upper[to] = True
            else:
                self.size[to] = [self.rows[k]["sizes"][d - 1] for k in here.tolist()]
        self.end = state

    def nodes(self):
        """Sums below each state that is no upper one; for upper ones of what hangs below them in this shard and is no upper one."""
        n = len(self.base)
        states = np.flatnonzero(self.row >= 0)
        self.children, self.leaves, self.saved = (np.zeros(n, np.int64) for _ in range(3))
        for d in range(self.turns.shape[1] - 1, 0, -1):
            at = states[(self.depth[states] == d) & ~self.upper[states]]
            self.leaves[at] += self.children[at] == 0
            self.saved[at] += (self.members[at] - 1) * self.size[at]
            up = self.check[at]
            np.add.at(self.children, up, 1)
            np.add.at(self.leaves, up, self.leaves[at])
            np.add.at(self.saved, up, self.saved[at])
        return states

    def name(self, state: int) -> str:
        """Key of a node, the same in all shards."""
        row, d = self.rows[self.row[state]], int(self.depth[state])
        if d == 0:
            return row["pre"]
        if row["next"] is not None and d == len(row["body"]) // _KEY:
            return row["next"]
        return hashlib.md5(row["pre"].encode() + b"/" + row["body"][: d * _KEY]).hexdigest()


_OUT = ("pre string, name string, parent string, path array<string>, seg long, conv_id long, depth long, parent_conv_id long, n_convs long, "
        "size long, n_children long, n_leaves long, saved_tokens long, ends string")


def shards(distinct: DataFrame, shard: int = SHARD, length: int = SEGMENT) -> DataFrame:
    """Nodes of all shards: final ones (name null) and parts of upper ones."""

    def run(batches):
        import pyarrow as pa

        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        one = Shard(pa.Table.from_batches(batches).to_pylist())
        states, ends = one.nodes(), {}
        for state, row in zip(one.end.tolist(), one.rows):
            ends[state] = row["ends"]
        names: dict[int, str] = {}
        out = []
        for s in states[np.argsort(one.depth[states], kind="stable")].tolist():
            up, d, row = int(one.check[s]), int(one.depth[s]), one.rows[one.row[s]]
            upper = bool(one.upper[s])
            if upper:
                names[s] = one.name(s)
            path = None
            if upper:
                path, at = [names[s]], s
                while one.depth[at]:
                    at = int(one.check[at])
                    path.append(names[at])
            # the root of a later segment is the last node of the one before, which counts its members
            later = d == 0 and row["seg"] > 0
            out.append((
                row["pre"] if upper else None, names.get(s), names.get(up) if d else None, path, row["seg"],
                None if later else int(one.first[s]), row["seg"] * length + d,
                int(one.first[up]) if d and up not in names else None, 0 if later else int(one.members[s]),
                int(one.size[s]), int(one.children[s]), int(one.leaves[s]), int(one.saved[s]), ends.get(s)))
        columns = list(zip(*out))
        kinds = [pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), *[pa.int64()] * 9, pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[f.split()[0] for f in _OUT.split(", ")])

    parts = max(1, math.ceil(distinct.count() / shard))
    order = ["seg", "pre", "body"]
    return common.cut(distinct.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, _OUT))


def merged(parts: DataFrame) -> DataFrame:
    """The upper nodes, whole: name, conv_id, depth, parent, n_convs, n_children, n_leaves, saved_tokens, ends."""
    upper = parts.where("name IS NOT NULL").groupBy("pre", "name").agg(
        *[F.min(c).alias(c) for c in ("conv_id", "depth", "seg", "parent", "path")], F.max("size").alias("size"), F.max("ends").alias("ends"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])
    upper = common.cut(upper)
    below = upper.where("parent IS NOT NULL").groupBy("pre", F.col("parent").alias("name")).agg(F.count("*").alias("upper_children"))
    upper = upper.join(below, ["pre", "name"], "left").withColumn("n_children", F.col("n_children") + F.coalesce("upper_children", F.lit(0))).drop("upper_children")
    # a later segment's root stands for the last node of the segment before, which takes its children
    root = (F.col("pre") == F.col("name")) & (F.col("seg") > 0)
    roots = upper.where(root)
    nodes = upper.where(~root).join(roots.select("name", F.col("n_children").alias("more")), "name", "left")
    nodes = nodes.withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0))).drop("more")
    own_leaf, own_saved = (F.col("n_children") == 0).cast("long"), (F.col("n_convs") - 1) * F.col("size")
    nodes = common.cut(nodes.withColumns({"n_leaves": F.col("n_leaves") + own_leaf, "saved_tokens": F.col("saved_tokens") + own_saved}))
    sums = [F.sum(c).alias(c) for c in ("n_leaves", "saved_tokens")]

    def to_ancestors(rows):
        return rows.select("pre", F.explode("path").alias("name"), "n_leaves", "saved_tokens")

    given = to_ancestors(nodes.select("pre", "path", "n_leaves", "saved_tokens").unionByName(roots.select("pre", "path", "n_leaves", "saved_tokens")))
    longest = parts.agg(F.max("seg")).first()[0] or 0
    if longest:
        # totals of later segments, with all that follow: the distance to the ancestor doubles from round to round
        inside = given.where("pre = name").groupBy("name").agg(*sums)
        ups = nodes.join(roots.select("name"), "name").select("name", F.when(F.col("pre") != "", F.col("pre")).alias("up"))
        total = common.cut(inside.join(ups, "name"))
        for _ in range(longest.bit_length()):
            lower = total.where("up IS NOT NULL").groupBy(F.col("up").alias("name")).agg(*[F.sum(c).alias(f"{c}_") for c in ("n_leaves", "saved_tokens")])
            above = total.select(F.col("name").alias("up"), F.col("up").alias("up_"))
            total = total.join(lower, "name", "left").join(above, "up", "left")
            total = common.cut(total.select("name", F.col("up_").alias("up"), *[
                (F.col(c) + F.coalesce(f"{c}_", F.lit(0))).alias(c) for c in ("n_leaves", "saved_tokens")]))
        given = given.unionByName(to_ancestors(nodes.select("pre", "name", "path").join(total.drop("up"), "name")))
    # the same name stands for a node and, in a later segment, for its root: only the node's own segment counts
    found = given.groupBy("pre", "name").agg(*sums)
    return nodes.drop("n_leaves", "saved_tokens").join(found, ["pre", "name"])


def trie(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
         shard: int = SHARD, length: int = SEGMENT) -> DataFrame:
    """A row for each distinct prefix of a rebuilt conversation: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves and saved_tokens (both over its subtree), ends_sha256."""
    turns, convs = rebuilt(conversations, conv_id, turn, role, text)
    parts = shards(distinct_segments(segments(turns, convs, length)), shard, length)
    upper = common.cut(merged(parts))
    of_parent = upper.select(F.col("name").alias("parent"), F.col("conv_id").alias("_of"))
    final = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(_NONE)).alias("ends_sha256")]
    lower = parts.where("name IS NULL")
    hung = lower.where("parent IS NOT NULL").join(of_parent, "parent").withColumn("parent_conv_id", F.col("_of"))
    upper = upper.join(of_parent, "parent", "left").withColumn("parent_conv_id", F.col("_of"))
    return lower.where("parent IS NULL").select(*final).unionByName(hung.select(*final)).unionByName(upper.select(*final))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
