"""Conversation prefix trie: shared beginnings of conversations and what they save.

``rebuilt`` gives every conversation as one row: a key (16 bytes for each turn,
the digest of its role and text) and the turns' sizes in code points. Keys sort
like the sequences they stand for, so a range of them is a piece of the trie in
preorder. Keys are range-partitioned with their conversation ids, which also
cuts many copies of one conversation into several shards.

A shard streams its keys, keeps each distinct one once, and writes its piece of
the trie as balanced parentheses. The excess (open less closed) is kept in
blocks of BLOCK positions with a tree of their minima: ``findclose``, the first
later place with less excess, looks in the node's own block and then descends
the tree. It delimits the subtree: rank over the pairs "()" counts its leaves,
and cumulative arrays over nodes and sequences give its savings and members.

Nodes that neighbouring shards may share are those on the path to the shard's
first or last key (its spines). They leave the shard as partial sums and are
merged, ARITY shards at a time, where again only the outer spines of the
merged range stay open. All other nodes are complete where they are made; one
whose parent is on a spine gets the parent's id by a join on node and shard.
The ids of a sequence that several shards may hold are hashed in their order
from pieces of at most IDS ids, as a stream.

Defined results: a null conv_id takes no part. Turns go by number, null first,
equal ones by the digest of role and text (so repeated rows are turns of their
own). Null role or text is empty. An empty table has no node, not even a root.
Memory: a shard holds its distinct keys, a task of ``rebuilt`` a conversation's
digests (not its texts). Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colorway.llm.common import importable, lineage_cut

GROUP = 100  # conversation c begins like conversation c - c % GROUP
HEADS = 6  # for at most HEADS - 1 turns
SHARD_TURNS = 1_000_000
BLOCK = 64
ARITY = 64
IDS = 50_000
_WIDTH = 16
_NO_ENDS = hashlib.sha256(b"").hexdigest()


def rebuilt(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
            text_col: str = "text") -> DataFrame:
    """(conv_id, key, sizes): each conversation with the first h turns of the
    first of its GROUP in place of its own first h, h = crc32(id) % HEADS."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    rows = conversations.where(F.col(id_col).isNotNull()) \
        .select(F.col(id_col).cast("long").alias("conv_id"),
                F.struct(F.col(turn_col).alias("turn"), digest.alias("digest"), F.length(text).alias("size")).alias("t")) \
        .withColumn("base", F.expr(f"conv_id - conv_id % {GROUP}"))
    # one exchange by base serves the conversations and the window over their group
    whole = rows.repartition("base").groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("own"))
    first = F.max(F.when(F.expr("conv_id = base"), F.slice("own", 1, HEADS - 1))).over(Window.partitionBy("base"))
    h = (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("int")
    turns = F.concat(F.slice(F.coalesce("first", F.slice("own", 1, 0)), F.lit(1), h), F.slice("own", h + 1, F.size("own")))
    return whole.withColumn("first", first).withColumn("turns", turns) \
        .select("conv_id", F.unhex(F.array_join("turns.digest", "")).alias("key"), F.col("turns.size").alias("sizes"))


class Parens:
    """Balanced parentheses (1 opens) with the minima of their excess."""

    def __init__(self, bits: np.ndarray, block: int = BLOCK):
        self.bits, self.block = bits, block
        self.excess = np.cumsum(2 * bits.astype(np.int32) - 1, dtype=np.int32)
        blocks = -(-len(bits) // block)
        self.leaves = 1 << max(0, (blocks - 1).bit_length())
        most = np.int32(2 ** 31 - 1)
        self._padded = np.full(self.leaves * block, most, np.int32)
        self._padded[:len(bits)] = self.excess
        self.low = np.full(2 * self.leaves, most, np.int32)  # node k has children 2k and 2k + 1
        self.low[self.leaves:] = self._padded.reshape(self.leaves, block).min(axis=1)
        for k in range(self.leaves.bit_length() - 2, -1, -1):
            level = slice(1 << k, 2 << k)
            self.low[level] = self.low[2 << k:4 << k].reshape(-1, 2).min(axis=1)

    def _within(self, blocks: np.ndarray, after: np.ndarray, below: np.ndarray) -> np.ndarray:
        """First place of each block, beyond ``after``, with an excess less than ``below``; -1 if none."""
        at = blocks[:, None] * self.block + np.arange(self.block)
        found = (self._padded[at] < below[:, None]) & (at > after[:, None])
        return np.where(found.any(axis=1), blocks * self.block + found.argmax(axis=1), -1)

    def findclose(self, opens: np.ndarray, step: int = 1 << 14) -> np.ndarray:
        """The place that closes each opening place."""
        return np.concatenate([self._findclose(opens[k:k + step]) for k in range(0, len(opens), step)] or [np.zeros(0, np.int64)])

    def _findclose(self, opens: np.ndarray) -> np.ndarray:
        below, blocks = self.excess[opens], opens // self.block
        out = self._within(blocks, opens, below)
        left = np.flatnonzero(out < 0)
        node, target = blocks[left] + self.leaves, below[left]
        while True:  # up to the next subtree on the right that holds a smaller excess
            on = (node & 1 == 1) | (self.low[np.minimum(node + 1, len(self.low) - 1)] >= target)
            if not on.any():
                break
            node = np.where(on, node >> 1, node)
        node = node + 1
        while (node < self.leaves).any():
            inner = node < self.leaves
            node = np.where(inner, 2 * node + (self.low[np.minimum(2 * node, len(self.low) - 1)] >= target), node)
        out[left] = self._within(node - self.leaves, opens[left], target)
        return out


def _common(a: bytes, b: bytes) -> int:
    """Turns that two keys begin with alike."""
    n, k, step = min(len(a), len(b)) // _WIDTH, 0, 1
    while k < n:
        if a[_WIDTH * k:_WIDTH * (k + step)] == b[_WIDTH * k:_WIDTH * (k + step)] and k + step <= n:
            k, step = k + step, 2 * step
        elif step > 1:
            step = 1
        else:
            break
    return k


def _prefixes(key: bytes) -> list[bytes]:
    """Digests of a key's prefixes of 0, 1, ... turns."""
    h = hashlib.md5()
    out = [h.digest()]
    for k in range(0, len(key), _WIDTH):
        h.update(key[k:k + _WIDTH])
        out.append(h.copy().digest())
    return out


_PIECE = pa.schema([
    ("kind", pa.int32()), ("shard", pa.int64()), ("node", pa.binary()), ("parent", pa.binary()), ("conv_id", pa.int64()),
    ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
    ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("size", pa.int64()), ("ends", pa.string()),
    ("left", pa.bool_()), ("right", pa.bool_()), ("nth", pa.int64()), ("body", pa.binary())])
_PIECE_SQL = "kind int, shard long, node binary, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, " \
             "n_children long, n_leaves long, saved_tokens long, size long, ends string, left boolean, right boolean, nth long, body binary"
_DONE, _BELOW_SPINE, _SPINE, _ENDS = range(4)


def _pieces(columns: dict, kind: int, shard: int, n: int) -> pa.RecordBatch:
    given = {"kind": [kind] * n, "shard": [shard] * n, **columns}
    return pa.RecordBatch.from_arrays([pa.array(given[f.name], f.type) if f.name in given else pa.nulls(n, f.type) for f in _PIECE],
                                      schema=_PIECE)


class Sequences:
    """The distinct keys of a shard in their order, with their members."""

    def __init__(self):
        self.keys: list[bytes] = []
        self.sizes: list[np.ndarray] = []
        self.first: list[int] = []
        self.count: list[int] = []
        self.ends: list[str] = []
        self._ids: list[int] = []

    def add(self, key: bytes, sizes: np.ndarray, conv: int) -> list[int]:
        """Takes a member; returns the ids of the first key when it is complete."""
        if self.keys and self.keys[-1] == key:
            self.count[-1] += 1
            self._ids.append(conv)
            return []
        done = self.close() if self.keys else []
        self.keys.append(key)
        self.sizes.append(sizes)
        self.first.append(conv)
        self.count.append(1)
        self._ids = [conv]
        return done if len(self.keys) == 2 else []

    def close(self) -> list[int]:
        ids = self._ids
        self.ends.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        return ids


def _trie(s: Sequences, shard: int) -> Iterator[pa.RecordBatch]:
    """Steps of one shard: parentheses, subtrees, finished nodes and spines."""
    n_seq = len(s.keys)
    shared = [0] + [_common(a, b) for a, b in zip(s.keys, s.keys[1:])]
    depth_of = np.array([len(k) // _WIDTH for k in s.keys], np.int64)
    lcp = np.array(shared, np.int64)
    opened, closed = depth_of - lcp, np.append(depth_of[:-1] - lcp[1:], depth_of[-1])
    bits = np.concatenate(([1], np.repeat(np.tile([1, 0], n_seq), np.ravel(np.column_stack((opened, closed)))), [0])).astype(np.int8)
    n = int(opened.sum()) + 1
    # nodes in preorder; node 0 is the root
    seq = np.concatenate(([0], np.repeat(np.arange(n_seq), opened)))
    start = np.cumsum(opened) - opened + 1  # a sequence's first new node
    depth = np.concatenate(([0], np.arange(1, n) - start[seq[1:]] + lcp[seq[1:]] + 1))
    size = np.concatenate(([0], *[z[k:] for z, k in zip(s.sizes, shared)])).astype(np.int64)
    parent = np.arange(n) - 1
    path = [0]
    for i, (k, d) in enumerate(zip(shared, depth_of.tolist())):
        del path[k + 1:]
        if d > k:
            a = int(start[i])
            parent[a] = path[k]
            path.extend(range(a, a + d - k))
        if i == 0:
            left = list(path)
    right = path

    opens = np.flatnonzero(bits)
    close = Parens(bits).findclose(opens)
    end = np.arange(n) + (close - opens + 1) // 2  # first node beyond the subtree
    end_seq = np.append(seq, n_seq)[end]
    members = np.append(0, np.cumsum(s.count))
    n_convs = members[end_seq] - members[seq]
    conv = np.minimum.reduceat(np.append(s.first, 0), np.ravel(np.column_stack((seq, end_seq))))[::2] \
        if n_seq else np.zeros(0, np.int64)
    pairs = np.append(0, np.cumsum((bits[:-1] == 1) & (bits[1:] == 0)))
    leaves = pairs[close] - pairs[opens]
    saving = np.append(0, np.cumsum((n_convs - 1) * size))
    saved = saving[end] - saving[:n]
    children = np.bincount(parent[1:], minlength=n)

    last = start + opened - 1  # the node a sequence ends in (the root's, if it has no turn)
    ends = np.full(n, _NO_ENDS, object)
    ends[np.where(opened > 0, last, 0)] = s.ends
    spine = np.zeros(n, bool)
    spine[left] = spine[right] = True
    own = np.flatnonzero(~spine)
    below = own[spine[parent[own]]]
    done = own[~spine[parent[own]]]
    key_of = {**dict(zip(left, _prefixes(s.keys[0]), strict=True)), **dict(zip(right, _prefixes(s.keys[-1]), strict=True))}

    def values(at: np.ndarray) -> dict:
        return {"conv_id": conv[at], "depth": depth[at], "n_convs": n_convs[at], "n_children": children[at],
                "n_leaves": leaves[at], "saved_tokens": saved[at], "ends": ends[at]}

    for k in range(0, len(done), 8192):
        at = done[k:k + 8192]
        yield _pieces({**values(at), "parent_conv_id": conv[parent[at]]}, _DONE, shard, len(at))
    for k in range(0, len(below), 8192):
        at = below[k:k + 8192]
        yield _pieces({**values(at), "parent": [key_of[p] for p in parent[at].tolist()]}, _BELOW_SPINE, shard, len(at))

    def of_closed(x: np.ndarray | int) -> np.ndarray:  # sums over a spine node's finished children
        out = np.zeros(n, np.int64)
        np.add.at(out, parent[below], x)
        return out

    at = np.flatnonzero(spine)
    in_left, in_right = np.isin(at, left), np.isin(at, right)
    here = np.where(np.isin(at, [int(x) for x in (last[0] if opened[0] else 0, last[-1] if opened[-1] else 0)]), None, ends[at])
    here = np.where(here == _NO_ENDS, None, here)
    yield _pieces({"node": [key_of[v] for v in at.tolist()], "parent": [key_of[int(parent[v])] if v else None for v in at.tolist()],
                   "conv_id": conv[at], "depth": depth[at], "n_convs": n_convs[at], "n_children": of_closed(1)[at],
                   "n_leaves": of_closed(leaves[below])[at], "saved_tokens": of_closed(saved[below])[at], "size": size[at], "ends": here,
                   "left": in_left, "right": in_right}, _SPINE, shard, len(at))


def shard_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, sizes, conv_id), sorted, of one range of keys."""
    context = TaskContext.get()
    shard = context.partitionId() if context else 0
    s = Sequences()

    def ends(key: bytes, ids: list[int]) -> Iterator[pa.RecordBatch]:
        node = hashlib.md5(key).digest()
        for k in range(0, len(ids), IDS):
            yield _pieces({"node": [node], "nth": [k // IDS], "body": [",".join(map(str, ids[k:k + IDS])).encode()]}, _ENDS, shard, 1)

    for batch in batches:
        sizes = batch.column("sizes")
        flat = sizes.flatten().to_numpy(zero_copy_only=False)
        cuts = np.append(0, np.cumsum(np.diff(sizes.offsets.to_numpy()))).tolist()
        for i, (key, conv) in enumerate(zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist(), strict=True)):
            ids = s.add(key, flat[cuts[i]:cuts[i + 1]], conv)
            if ids:
                yield from ends(s.keys[0], ids)
    if s.keys:
        yield from ends(s.keys[-1], s.close())
        yield from _trie(s, shard)


def merged(table: pa.Table, final: bool, block: int = 0) -> pa.Table:
    """Spine nodes of neighbouring shards as one of number ``block``: sums of
    their parts. Those not on the outer spines (all, if ``final``) become
    complete."""
    nodes: dict[bytes, dict] = {}
    low, high = (min(table["shard"].to_pylist()), max(table["shard"].to_pylist()))
    for r in table.select([f.name for f in _PIECE if f.name not in ("kind", "nth", "body")]).to_pylist():
        left, right = r["left"] and r["shard"] == low, r["right"] and r["shard"] == high
        v = nodes.setdefault(r["node"], {**r, "left": False, "right": False, "n_convs": 0, "n_children": 0, "n_leaves": 0, "saved_tokens": 0})
        for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
            v[c] += r[c]
        v["conv_id"] = min(v["conv_id"], r["conv_id"])
        v["ends"] = v["ends"] or r["ends"]
        v["left"], v["right"] = v["left"] or left, v["right"] or right
    for v in sorted(nodes.values(), key=lambda v: -v["depth"]):
        v["kind"] = _SPINE if not final and (v["left"] or v["right"]) else _DONE
        if v["kind"] == _DONE:
            v["n_leaves"] = v["n_leaves"] if v["n_children"] else 1
            v["saved_tokens"] += (v["n_convs"] - 1) * v["size"]
            if v["parent"] is not None:
                up = nodes[v["parent"]]
                up["n_children"] += 1
                up["n_leaves"] += v["n_leaves"]
                up["saved_tokens"] += v["saved_tokens"]
        v["shard"] = block
    columns = {f.name: [v.get(f.name) for v in nodes.values()] for f in _PIECE}
    return pa.table([pa.array(columns[f.name], f.type) for f in _PIECE], schema=_PIECE)


def _merger(final: bool) -> Callable[[tuple, pa.Table], pa.Table]:
    def merge(key: tuple, table: pa.Table) -> pa.Table:
        return merged(table, final, key[0].as_py())

    return merge


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, ends) of pieces of ids in their order, as a stream."""
    node = h = None
    for batch in batches:
        out: list[tuple[bytes, str]] = []
        for k, body in zip(batch.column("node").to_pylist(), batch.column("body").to_pylist(), strict=True):
            if k != node:
                if h is not None:
                    out.append((node, h.hexdigest()))
                node, h = k, hashlib.sha256(body)
            else:
                h.update(b",")
                h.update(body)
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.string())],
                                         names=["node", "ends"])
    if h is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([h.hexdigest()], pa.string())], names=["node", "ends"])


def nodes(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
          shard_turns: int = SHARD_TURNS, arity: int = ARITY) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256) of every node of the trie."""
    spark = conversations.sparkSession
    importable(spark)
    keys = lineage_cut(rebuilt(conversations, id_col, turn_col, role_col, text_col))  # sampled for its ranges, then sorted
    turns = keys.agg(F.sum(F.size("sizes") + 1)).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // shard_turns))
    pieces = lineage_cut(keys.repartitionByRange(shards, "key", "conv_id").sortWithinPartitions("key", "conv_id")
                         .select("key", "sizes", "conv_id").mapInArrow(shard_rows, _PIECE_SQL))

    spines = [pieces.where(F.col("kind") == _SPINE)]
    whole = []
    while shards > 0:
        final = shards <= arity
        level = spines[-1].withColumn("block", F.floor(F.col("shard") / arity))
        met = lineage_cut(level.groupBy("block").applyInArrow(_merger(final), _PIECE_SQL))
        whole.append(met.where(F.col("kind") == _DONE))
        spines.append(met.where(F.col("kind") == _SPINE))
        shards = 0 if final else -(-shards // arity)
    spine = whole[0]
    for more in whole[1:]:
        spine = spine.unionByName(more)
    names = spine.select(F.col("node").alias("parent"), F.col("conv_id").alias("up"))
    # a parent's children are dealt by shard, so a hot parent's meet in no one task
    up = spines[0].select(F.col("node").alias("parent"), "shard").join(names, "parent")
    below = pieces.where(F.col("kind") == _BELOW_SPINE).join(up, ["parent", "shard"])
    ends = pieces.where(F.col("kind") == _ENDS).select("node", "shard", "nth", "body").repartition("node") \
        .sortWithinPartitions("node", "shard", "nth").select("node", "body").mapInArrow(_hashed, "node binary, ends string")
    inner = spine.withColumnRenamed("ends", "found").join(ends, "node", "left").join(names, "parent", "left") \
        .withColumn("ends", F.coalesce("ends", "found", F.lit(_NO_ENDS)))

    def shown(df: DataFrame, parent: str) -> DataFrame:
        return df.select("conv_id", "depth", F.col(parent).alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
                         "saved_tokens", F.col("ends").alias("ends_sha256"))

    return shown(pieces.where(F.col("kind") == _DONE), "parent_conv_id").unionByName(shown(below, "up")).unionByName(shown(inner, "up"))
