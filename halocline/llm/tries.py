"""A trie of conversation prefixes as succinct level-order tries of bounded shards.

Every turn adds a term to a running polynomial of its conversation, so that a prefix has a key of 128 bits and its
parent's key is a difference. Turns are sorted over all partitions; a conversation that crosses partitions takes the
sums of those before along. Distinct keys are the nodes. What only one conversation reaches needs no trie: it is a path
with one leaf. Nodes that conversations share are dealt into shards by a prefix whose subtree is of bounded size. numpy
builds each shard's trie, a LOUDS bit vector with an array of labels, reads parents off the bits by rank, and adds
values up in reverse level order. The upper levels, above prefixes that too many nodes share, are merged afterwards,
level by level.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halocline.llm.groups import join_counted, rows_of
from halocline.llm.workspace import Workspace

BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd, so that they have inverses
MASK = (1 << 64) - 1
KEY = ["k1", "k2"]
CUTS = 8  # the deepest prefix that may name a shard
CHUNK = 10_000  # ids that are joined to one string at once


def powers(base: int, exponents: np.ndarray) -> np.ndarray:
    """base^e modulo 2^64 of every exponent, none negative."""
    out, square, e = np.ones(len(exponents), np.uint64), np.uint64(base), exponents.astype(np.uint64)
    for bit in range(int(exponents.max(initial=0)).bit_length()):
        odd = (e >> np.uint64(bit)) & np.uint64(1) == 1
        out[odd] *= square
        square = np.uint64(int(square) ** 2 & MASK)
    return out


def _signed(x: int) -> int:
    x &= MASK
    return x - (1 << 64) if x >> 63 else x


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns in the order of their conversations: place i in it, running key (k), term of the turn (t), all within the partition."""
    conv, n, sums = None, 0, [0, 0]
    for batch in batches:
        if not batch.num_rows:
            continue
        c = batch.column("conv_id").to_numpy()
        first = np.r_[True, c[1:] != c[:-1]]
        starts = np.flatnonzero(first)
        run = np.cumsum(first) - 1
        goes_on = c[0] == conv
        i = np.arange(1, len(c) + 1) - starts[run]
        i[run == 0] += n if goes_on else 0
        out = {"conv_id": batch.column("conv_id"), "part": batch.column("part"), "bytes": batch.column("bytes"), "i": pa.array(i, pa.int64())}
        last = []
        for j in (0, 1):
            term = batch.column(f"h{j + 1}").to_numpy().view(np.uint64) * powers(BASES[j], i)
            total = np.cumsum(term, dtype=np.uint64)
            total -= np.r_[np.uint64(0), total[starts[1:] - 1]][run]
            if goes_on:
                total[run == 0] += np.uint64(sums[j])
            last.append(int(total[-1]))
            out |= {f"k{j + 1}": pa.array(total.view(np.int64)), f"t{j + 1}": pa.array(term.view(np.int64))}
        conv, n, sums = c[-1], int(i[-1]), last
        yield pa.record_batch(out)


def _carried(numbered: DataFrame) -> dict[int, tuple[int, int, int, int]]:
    """By partition: the conversation that goes on in it, with its turns and sums so far. A row a partition."""
    ends = numbered.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "i", "k1", "k2")).alias("last")).collect()
    out, state = {}, None
    for r in sorted(ends, key=lambda r: r["part"]):
        conv, n, *sums = r["last"]
        if state and r["first"] == state[0]:
            out[r["part"]] = state
            if conv == state[0]:
                sums = [s + x * pow(b, state[1], 1 << 64) for s, x, b in zip(state[2:], sums, BASES, strict=True)]
                n += state[1]
        state = (conv, n, *[x & MASK for x in sums])
    return out


def number_turns(turns: DataFrame, work: Workspace) -> DataFrame:
    """turns: conv_id, turn, h1, h2, bytes. Returns conv_id, i (1, 2, ... in order, null turns first), bytes, key and term."""
    order = [F.col("conv_id").asc(), F.col("turn").asc_nulls_first(), F.col("h1").asc(), F.col("h2").asc()]
    dealt = turns.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    numbered = work.write(dealt.mapInArrow(_number, "conv_id long, part int, bytes long, i long, k1 long, t1 long, k2 long, t2 long"), "numbered")
    carried = _carried(numbered)
    if not carried:
        return numbered.drop("part")

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, part = batch.column("conv_id").to_numpy(), batch.column("part").to_numpy()
            i = batch.column("i").to_numpy().copy()
            keys = {k: batch.column(k).to_numpy().view(np.uint64).copy() for k in ("k1", "k2", "t1", "t2")}
            for p in np.unique(part):
                if int(p) in carried:
                    conv, n, *sums = carried[int(p)]
                    at = (part == p) & (c == conv)
                    i[at] += n
                    for j in (0, 1):
                        shift = np.uint64(pow(BASES[j], n, 1 << 64))
                        keys[f"t{j + 1}"][at] *= shift
                        keys[f"k{j + 1}"][at] = keys[f"k{j + 1}"][at] * shift + np.uint64(sums[j])
            yield pa.record_batch({"conv_id": batch.column("conv_id"), "bytes": batch.column("bytes"), "i": pa.array(i), **{k: pa.array(v.view(np.int64)) for k, v in keys.items()}})

    return numbered.mapInArrow(carry, "conv_id long, bytes long, i long, k1 long, k2 long, t1 long, t2 long")


def rebuild(turns: DataFrame, work: Workspace, step: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(prefixes, conversations) of conversations whose first turns are another's.

    Conversation c gets the first h turns of c - c % step, h = crc32(c) % (most + 1), then its own after its first h. A
    prefix is a row for each conversation and depth: conv_id, depth, key, parent's key, bytes, last, path (keys' first
    halves at depth 1 to CUTS).
    """
    numbered = number_turns(turns, work)
    early = F.when(F.col("i") <= most + CUTS, F.struct("i", "k1", "k2", "t1", "t2", "bytes"))
    convs = work.write(numbered.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(early)).alias("heads")), "conversations")
    base = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"), F.slice("heads", 1, most).alias("base_heads"))
    joined = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % step).withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).join(base, "base", "left")
    numbers, turn = ["conv_id", "n", "h", "s", "total", "shift1", "shift2", "add1", "add2"], ["depth", "k1", "k2", "p1", "p2", "bytes"]
    state = ", ".join(f"{c} long" for c in numbers) + f", path array<long>, taken array<struct<{','.join(f'{c}:long' for c in turn)}>>"

    def start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                theirs, own, h = list(r.base_heads) if r.base_heads is not None else [], list(r.heads), int(r.h)
                s = min(h, len(theirs))
                total = s + max(0, int(r.n) - h)
                before = own[min(h, len(own)) - 1] if h else None
                end = theirs[s - 1] if s else None
                shift, add = [], []
                for j in (0, 1):
                    k = f"k{j + 1}"
                    shift.append(pow(BASES[j], s - h, 1 << 64))
                    add.append((end[k] if end else 0) - (before[k] if before else 0) * shift[j])
                path = [t["k1"] for t in theirs[:s]] + [_signed(t["k1"] * shift[0] + add[0]) for t in own[h : h + CUTS]]
                taken = [(t["i"], t["k1"], t["k2"], _signed(t["k1"] - t["t1"]), _signed(t["k2"] - t["t2"]), t["bytes"]) for t in theirs[:s]]
                taken = [dict(zip(turn, x, strict=True)) for x in taken]
                rows.append((r.conv_id, r.n, h, s, total, *[_signed(x) for x in (*shift, *add)], path[:CUTS], taken))
            yield pd.DataFrame(rows, columns=[*numbers, "path", "taken"])

    info = work.write(joined.select("conv_id", "n", "h", "heads", "base_heads").mapInPandas(start, state), "starts")
    taken = info.select("conv_id", "total", "path", F.explode("taken").alias("t")).select("conv_id", "t.depth", "t.k1", "t.k2", "t.p1", "t.p2", "t.bytes", "total", "path")
    own = join_counted(numbered, info.select(*numbers, "path"), ["conv_id"], "n", rows_of(info, "n")).filter("i > h")

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = {c: batch.column(c).to_numpy() for c in ("i", "h", "s")}
            out = {"conv_id": batch.column("conv_id"), "depth": pa.array(of["s"] + of["i"] - of["h"])}
            parents = {}
            for j in ("1", "2"):
                k, t, shift, add = (batch.column(c + j).to_numpy().view(np.uint64) for c in ("k", "t", "shift", "add"))
                key = k * shift + add
                out["k" + j] = pa.array(key.view(np.int64))
                parents["p" + j] = pa.array((key - t * shift).view(np.int64))
            yield pa.record_batch(out | parents | {c: batch.column(c) for c in ("bytes", "total", "path")})

    own = own.mapInArrow(moved, taken.schema)
    prefixes = taken.unionByName(own)
    prefixes = prefixes.select("conv_id", "depth", *KEY, "p1", "p2", "bytes", (F.col("depth") == F.col("total")).alias("last"), F.slice("path", F.lit(1), F.least(F.lit(CUTS), F.col("depth").cast("int"))).alias("path"))
    return work.write(prefixes, "prefixes"), info


def louds(parent: np.ndarray, label: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bits, labels, order, level starts) of a forest under one more root.

    parent: index of each node's parent, -1 for roots; order: the nodes level by level, those of a parent by label. Bits:
    for the added root and then every node, in order, a 1 for each child and a 0.
    """
    n = len(parent)
    level = np.zeros(n, np.int64)
    by_depth = np.argsort(depth, kind="stable")
    for lo, hi in _runs(depth[by_depth]):
        at = by_depth[lo:hi]
        level[at] = np.where(parent[at] >= 0, level[parent[at]] + 1, 0)
    by_level = np.argsort(level, kind="stable")
    place, order, starts = np.full(n, -1), np.zeros(n, np.int64), []
    for lo, hi in _runs(level[by_level]):
        at = by_level[lo:hi]
        above = np.where(parent[at] >= 0, place[parent[at]], -1)
        at = at[np.lexsort((label[at], above))]
        place[at], order[lo:hi] = np.arange(lo, hi), at
        starts.append(lo)
    above = np.where(parent >= 0, place[parent], -1)
    children = np.bincount(above + 1, minlength=n + 1)
    bits = np.ones(2 * n + 1, np.uint8)
    bits[np.cumsum(children) + np.arange(n + 1)] = 0
    return np.packbits(bits), label[order], order, np.r_[starts, n].astype(np.int64)


def parents_of(bits: np.ndarray, n: int) -> np.ndarray:
    """The place of each node's parent, by rank: the zeros before a node's 1 count the nodes before its parent; -1 for roots."""
    ones = np.flatnonzero(np.unpackbits(bits, count=2 * n + 1))
    return ones - np.arange(n) - 1


def roll_up(parent: np.ndarray, starts: np.ndarray, *values: np.ndarray) -> None:
    """Adds the values of every node, in level order, to its parent's, the last level first."""
    for lo, hi in zip(starts[-2:0:-1], starts[:1:-1], strict=True):
        for v in values:
            np.add.at(v, parent[lo:hi], v[lo:hi])


def _runs(x: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(x)) + 1
    return zip(np.r_[0, edges].tolist(), np.r_[edges, len(x)].tolist(), strict=True) if len(x) else iter(())


def _shard(part: pd.DataFrame) -> pd.DataFrame:
    """Leaves and savings below each node of a shard's trie; top marks those whose parent is outside."""
    at = {k: i for i, k in enumerate(zip(part["k1"], part["k2"], strict=True))}
    parent = np.array([at.get(k, -1) for k in zip(part["p1"], part["p2"], strict=True)], np.int64)
    bits, _, order, starts = louds(parent, part["k1"].to_numpy(), part["depth"].to_numpy())
    rows = part.iloc[order]
    above = parents_of(bits, len(rows))
    leaves = rows["singles"].to_numpy() + (rows["n_children"].to_numpy() == 0)
    saved = (rows["n_convs"].to_numpy() - 1) * rows["bytes"].to_numpy()
    if "n_leaves" in rows:  # of shards below
        leaves, saved = leaves + rows["n_leaves"].to_numpy(), saved + rows["saved_tokens"].to_numpy()
    roll_up(above, starts, leaves, saved)
    return pd.DataFrame({"k1": rows["k1"], "k2": rows["k2"], "p1": rows["p1"], "p2": rows["p2"], "n_leaves": leaves, "saved_tokens": saved, "top": above < 0})


def _deal(shared: DataFrame, most: int, work: Workspace) -> tuple[DataFrame, DataFrame | None]:
    """(nodes with their shard, nodes above): a shard is the shortest prefix under which there are at most ``most`` nodes."""
    rest, dealt, above = shared, [], []
    for level in range(1, CUTS + 1):
        named = rest.withColumn("shard", F.get("path", F.lit(level - 1)))
        sizes = work.write(named.groupBy("shard").agg(F.count(F.lit(1)).alias("shard_n")), f"sizes{level}")
        crowded = sizes.filter(F.col("shard_n") > most)
        if crowded.isEmpty():
            dealt.append(named)
            return _union(dealt), _union(above)
        total = rows_of(sizes, "shard_n")
        placed = work.write(join_counted(named, sizes, ["shard"], "shard_n", total), f"placed{level}")
        dealt.append(placed.filter(F.col("shard_n") <= most).select(*named.columns))
        crowd = placed.filter(F.col("shard_n") > most).drop("shard", "shard_n")
        above.append(crowd.filter(F.col("depth") == level).select(*shared.columns))
        rest = crowd.filter(F.col("depth") > level).select(*shared.columns)
    return _union(dealt), _union([*above, rest])


def _union(parts: list[DataFrame]) -> DataFrame | None:
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out


def _digests(ends: DataFrame, nodes: DataFrame, work: Workspace) -> DataFrame:
    """ends: key, conv_id; nodes: key, n_ends. Returns key, ends_sha256 of the sorted ids, joined by commas.

    Ids of nodes with many are joined in chunks, by ranges, and a node's chunks are hashed one after another.
    """
    text = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    many = work.write(nodes.filter(F.col("n_ends") > CHUNK).select(*KEY, "n_ends"), "many_ends")
    if many.isEmpty():
        return ends.groupBy(*KEY).agg(F.sha2(text, 256).alias("ends_sha256"))
    total = rows_of(nodes, "n_ends")
    few = ends.join(F.broadcast(many.filter(F.col("n_ends") > total / 1000).select(*KEY)), KEY, "left_anti") if total else ends
    crowd = join_counted(ends, many, KEY, "n_ends", total).select(*KEY, "conv_id")
    few = few.join(many.filter(F.col("n_ends") <= total / 1000).select(*KEY).hint("merge"), KEY, "left_anti").groupBy(*KEY).agg(F.sha2(text, 256).alias("ends_sha256"))
    order = [*KEY, "conv_id"]
    chunk = F.floor(F.monotonically_increasing_id() / CHUNK)
    chunks = crowd.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("chunk", chunk).groupBy(*KEY, "chunk").agg(text.alias("ids"))

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for batch in batches:
            done = []
            for k1, k2, ids in zip(batch["k1"], batch["k2"], batch["ids"], strict=True):
                if (k1, k2) == key:
                    state.update(b"," + ids.encode())
                else:
                    if key:
                        done.append((*key, state.hexdigest()))
                    key, state = (k1, k2), hashlib.sha256(ids.encode())
            yield pd.DataFrame(done, columns=[*KEY, "ends_sha256"])
        if key:
            yield pd.DataFrame([(*key, state.hexdigest())], columns=[*KEY, "ends_sha256"])

    streamed = chunks.repartition(*KEY).sortWithinPartitions(*KEY, "chunk").mapInPandas(digest, "k1 long, k2 long, ends_sha256 string")
    return few.unionByName(streamed)


def prefix_trie(turns: DataFrame, step: int = 5, most: int = 8, shard: int = 1 << 16, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per distinct prefix of rebuilt conversations: conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by ``turn``, null first; turns of one number by hashes of their contents, so that reruns agree.
    Null roles and texts are empty. Conversation c is rebuilt from the first h turns of conversation c - c % ``step``,
    h = crc32(c) % (``most`` + 1), and its own after its first h. Rows without a conv_id are in no conversation and are
    left out. Repeated rows are turns of their own. An empty table gives no rows, not even a root. Texts and conversations
    may be of any length. Prefixes are told apart by 128 bits of hashes.

    saved_tokens: over the subtree, (members - 1) x bytes of the node's last text. ends_sha256: of the ids of the
    conversations that end at the node, sorted, joined by commas; it is one hash, so ids of one node are hashed in turn.
    """
    spark = turns.sparkSession
    work = Workspace(spark, "tries")
    r, t = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    rows = turns.filter(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.xxhash64(r, t).alias("h1"), F.xxhash64(F.lit("2"), t, r).alias("h2"), F.octet_length(t).cast("long").alias("bytes")
    )
    prefixes, convs = rebuild(rows, work, step, most)
    found = prefixes.groupBy(*KEY, "depth").agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.first("bytes").alias("bytes"), F.first("p1").alias("p1"), F.first("p2").alias("p2"),
        F.first("path").alias("path"), F.sum(F.col("last").cast("long")).alias("n_ends"),
    )
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = convs.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.coalesce(F.sum((F.col("total") == 0).cast("long")), zero).alias("n_ends")).filter("n_convs > 0")
    root = root.select(zero.alias("k1"), zero.alias("k2"), zero.alias("depth"), "n_convs", "conv_id", zero.alias("bytes"), none.alias("p1"), none.alias("p2"), F.array().cast("array<long>").alias("path"), "n_ends")
    found = work.write(found.unionByName(root), "found")
    kids = found.filter("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"), F.sum((F.col("n_convs") == 1).cast("long")).alias("singles"))
    nodes = found.join(kids.hint("merge"), KEY, "left").withColumns({c: F.coalesce(F.col(c), zero) for c in ("n_children", "singles")})
    nodes = work.write(nodes, "nodes")

    shared = nodes.filter("n_convs > 1 and depth > 0").select(*KEY, "p1", "p2", "depth", "n_convs", "bytes", "n_children", "singles", "path")
    dealt, above = _deal(shared, shard, work)
    bins = max(1, math.ceil(dealt.count() / shard))
    rolled = dealt.drop("path").withColumn("bin", F.pmod(F.xxhash64("shard"), F.lit(bins)))
    rolled = rolled.groupBy("bin").applyInPandas(_shard, ROLLED)
    rolled = work.write(rolled, "rolled")
    tops = rolled.filter("top").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    upper = nodes.filter("depth = 0").select(*[c for c in shared.columns if c != "path"])
    upper = work.write(upper.unionByName(above.drop("path")) if above is not None else upper, "upper")
    merged = _merge(upper, tops, shard, work)

    values = rolled.select(*KEY, "n_leaves", "saved_tokens").unionByName(merged)
    alone = nodes.filter("n_convs = 1 and depth > 0").withColumns({"n_leaves": F.lit(1).cast("long"), "saved_tokens": zero})
    rest = nodes.filter("n_convs > 1 or depth = 0").join(values.hint("merge"), KEY)
    whole = alone.unionByName(rest)
    # a parent goes to its children: as many rows as it has
    parents = nodes.filter("n_children > 0").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("parent_n"))
    parents = work.write(parents, "parents")
    whole = join_counted(whole.filter("depth > 0"), parents, ["p1", "p2"], "parent_n", rows_of(parents, "parent_n")).unionByName(whole.filter("depth = 0").withColumns({"parent_conv_id": none, "parent_n": none}))
    whole = work.write(whole, "whole")
    ends = prefixes.filter("last").select(*KEY, "conv_id").unionByName(convs.filter("total = 0").select(zero.alias("k1"), zero.alias("k2"), "conv_id"))
    digests = work.write(_digests(ends, nodes, work), "digests")
    work.keep("whole", "digests")
    sha = F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256")
    return whole.join(digests.hint("merge"), KEY, "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", sha)


ROLLED = "k1 long, k2 long, p1 long, p2 long, n_leaves long, saved_tokens long, top boolean"


def _merge(upper: DataFrame, below: DataFrame, most: int, work: Workspace) -> DataFrame:
    """Leaves and savings of the nodes above the shards; below: by parent, the sums of shards.

    Up to ``most`` nodes are one more trie; more are merged level by level, the deepest first.
    """
    if upper.count() <= most:
        whole = upper.join(F.broadcast(upper.select(*KEY).join(below, KEY)), KEY, "left")
        whole = whole.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast("long")) for c in ("n_leaves", "saved_tokens")}).withColumns({c: F.coalesce(F.col(c), F.lit(-1).cast("long")) for c in ("p1", "p2")})
        return whole.groupBy(F.lit("upper")).applyInPandas(_shard, ROLLED).select(*KEY, "n_leaves", "saved_tokens")
    deepest = upper.agg(F.max("depth")).first()[0]
    done, sums = [], below
    for depth in range(deepest if deepest is not None else -1, -1, -1):
        level = upper.filter(F.col("depth") == depth)
        own = level.join(sums.hint("merge"), KEY, "left")
        leaves = F.coalesce("n_leaves", F.lit(0)) + F.col("singles") + F.when(F.col("n_children") == 0, 1).otherwise(0)
        saved = F.coalesce("saved_tokens", F.lit(0)) + (F.col("n_convs") - 1) * F.col("bytes")
        own = work.write(own.select(*KEY, "p1", "p2", leaves.cast("long").alias("n_leaves"), saved.cast("long").alias("saved_tokens")), f"level{depth}")
        done.append(own.select(*KEY, "n_leaves", "saved_tokens"))
        if depth:
            up = own.select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), "n_leaves", "saved_tokens")
            sums = below.unionByName(up).groupBy(*KEY).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    return _union(done) if done else upper.select(*KEY, F.lit(0).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"))
