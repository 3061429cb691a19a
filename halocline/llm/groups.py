"""What the operators share where keys are hot: joins, numbering and blocks of large groups, connected components."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halocline.llm.workspace import Workspace, fresh

#: A key is hot if more than one in so many rows have it: there are no more hot keys than that, so they can be sent.
HOT = 1000


def join_counted(rows: DataFrame, keyed: DataFrame, on: list[str], n: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``keyed``, which has a row a key and in ``n`` how many of ``rows`` have the key; ``total``: of all.

    Keys that more than total / HOT rows have, HOT of them at most, are broadcast, so that their rows stay where they
    are; the others, which grow with the corpus, are merged at every size. ``keyed`` should be a written table, as it is
    read twice.
    """
    hot = keyed.filter(F.col(n) > total / HOT)
    if total <= HOT or hot.isEmpty():
        return rows.join(keyed.hint("merge"), on, how)
    spread = rows.join(F.broadcast(hot), on)
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(keyed.filter(F.col(n) <= total / HOT).hint("merge"), on, how)
    return spread.unionByName(rest)


def join_spread(rows: DataFrame, keyed: DataFrame, on: list[str], how: str = "left", most: int = 100_000, salts: int = 64) -> DataFrame:
    """``rows`` joined with ``keyed``, which has a row a key, whatever key is hot in ``rows``. ``keyed`` is read twice.

    A table of ``most`` rows or fewer is broadcast. A larger one goes out ``salts`` times, and rows meet it by key and by
    the input partition that they come from.
    """
    if keyed.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(keyed), on, how)
    (salt,) = fresh(rows, "salt")
    every = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    return rows.withColumn(salt, F.pmod(F.spark_partition_id(), F.lit(salts))).join(keyed.withColumn(salt, every), [*on, salt], how).drop(salt)


def marked(rows: DataFrame, keyed: DataFrame, on: list[str], out: str, most: int = 1 << 18) -> DataFrame:
    """``rows`` with ``out``: true if ``keyed``, a written table, has their key, and by chance for a few of the others.

    A bitmap of the hashes of ``keyed``, of ``most`` words of 64 bits at most, is broadcast, so rows stay where they are.
    A row in 32 or fewer is marked by chance, more only beyond 2 * ``most`` keys: an exact join of the marked rows follows.
    """
    word, bits = fresh(rows, "bitmap_word", "bitmap_bits")
    words = min(most, 1 << max(4, (keyed.count() // 2).bit_length()))
    place = F.pmod(F.xxhash64(*on), F.lit(words)).cast("int")
    mine = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(F.xxhash64(*on), 58).cast("int"))
    bitmap = keyed.groupBy(place.alias(word)).agg(F.bit_or(mine).alias(bits))
    found = rows.withColumn(word, place).join(F.broadcast(bitmap), word, "left")
    return found.select(*rows.columns, F.coalesce(F.col(bits).bitwiseAND(mine) != 0, F.lit(False)).alias(out))


def rows_of(counted: DataFrame, n: str) -> int:
    """Sum of a column of counts."""
    return int(counted.agg(F.sum(n)).first()[0] or 0)


def in_blocks(members: DataFrame, group: list[str], order: Column, block: int, work: Workspace, source: DataFrame | None = None) -> DataFrame:
    """Adds bi, bj and side: a group of up to ``block`` members is one piece (0, 0); a larger one is cut into blocks.

    Every two blocks meet in one piece (bi < bj; side says which of the two a member is of), and every block meets
    itself (bi = bj), so every pair of members meets once, and no task gets more than two blocks. ``source``: a table
    with the same groups to count them in, if ``members`` takes long to make.
    """
    counted = work.write((source or members).groupBy(*group).agg(F.count(F.lit(1)).alias("group_size")), "group_sizes")
    large = counted.filter(F.col("group_size") > block)
    dealt = members.withColumn("group_size", F.lit(None).cast("long")) if large.isEmpty() else join_counted(members, large, group, "group_size", rows_of(counted, "group_size"), "left")
    blocks = F.coalesce(F.ceil(F.col("group_size") / block), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64(order), blocks).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), blocks - 1), lambda other: F.struct(F.least(own, other).alias("bi"), F.greatest(own, other).alias("bj"), (own > other).alias("side")))
    return dealt.withColumn("piece", F.explode(pieces)).select(*members.columns, "piece.bi", "piece.bj", "piece.side")


def numbered(rows: DataFrame, key: list[str], out: str, work: Workspace) -> DataFrame:
    """Adds ``out``: 1 to n over the rows of each key, in any order. ``rows`` should be a written table.

    Rows are numbered within their input partition first, and each partition starts where those before it have ended,
    so that the rows of a hot key stay spread.
    """
    from pyspark.sql import Window as W

    part, n, before = fresh(rows, "input_part", "rows_n", "rows_before")
    tagged = work.write(rows.withColumn(part, F.spark_partition_id()), f"tagged_{out}")
    local = tagged.withColumn(out, F.row_number().over(W.partitionBy(*key, part).orderBy(F.lit(0))))
    counts = tagged.groupBy(*key, part).agg(F.count(F.lit(1)).alias(n))
    earlier = F.coalesce(F.sum(n).over(W.partitionBy(*key).orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))
    starts = counts.select(*[F.col(k).alias(f"{k}_of") for k in key], F.col(part).alias(f"{part}_of"), earlier.alias(before))
    match = F.lit(True)
    for k in [*key, part]:
        match = match & F.col(k).eqNullSafe(F.col(f"{k}_of"))
    return local.join(starts, match).withColumn(out, F.col(out) + F.col(before)).select(*rows.columns, out)


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes is joined to by the links a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            return root


def components(edges: DataFrame, work: Workspace) -> DataFrame:
    """edges: a, b, of one orderable type, neither null, a != b. Returns node, root: the smallest node it is joined to.

    Alternating large and small stars: in each round all nodes are drawn towards the smallest neighbour, in two joins
    on sums of the whole; the number of rounds grows with the logarithm of the longest path. The edges of a hub, which
    may be a large part of all, stay spread: its smallest neighbour is sent to them.
    """
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    down, mark, n = work.write(down, "edges0"), None, 0
    while True:
        now = down.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")).first()
        if now == mark:
            break
        mark, n = now, n + 1
        both = down.union(down.select("b", "a")).toDF("a", "b")
        least = work.write(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count(F.lit(1)).alias("n")), f"least{n}")
        large = join_counted(both.filter("b > a"), least, ["a"], "n", 2 * now["n"]).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = work.write(large, f"large{n}")
        small = work.write(large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), f"small{n}")
        moved = join_counted(large, small, ["a"], "n", rows_of(small, "n")).filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = work.write(moved.union(small.select("a", "m")).toDF("a", "b").distinct(), f"edges{n}")
        work.drop(f"large{n}", f"least{n}", f"small{n}", f"edges{n - 1}")
    # every node now hangs on its root
    roots = down.select(F.col("b").alias("node")).distinct()
    return work.write(down.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select("node", F.col("node").alias("root"))), "components")


def lowest_of(members: DataFrame, group: str, value: str, out: str, work: Workspace) -> DataFrame:
    """``members`` with ``out``, the least ``value`` of their ``group``; a giant group stays spread."""
    lowest = work.write(members.groupBy(group).agg(F.min(value).alias(out), F.count(F.lit(1)).alias("_members")), f"lowest_{out}")
    return join_counted(members, lowest, [group], "_members", rows_of(lowest, "_members")).drop("_members")


def runs_for(recall: float, per_run: float) -> int:
    """Independent runs that reach ``recall`` if each finds a pair with the probability ``per_run``."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - per_run)))
