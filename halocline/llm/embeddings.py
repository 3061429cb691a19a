"""Near-duplicate embeddings by a pivot-permutation index.

Reference vectors (pivots) are drawn from a bounded sample and thinned until no two are alike. A vector is described
by its nearest pivots, in order. Vectors that are near share many of them: an inverted list for two pivots holds the
vectors that have both; in a list, shared pivots are counted, and pairs that share enough are verified in double
precision. Equal vectors count as one until the end. The list of the two rarest shared pivots verifies a pair, so it
counts once; lists of any length are dealt out in blocks.
"""

from __future__ import annotations

import math
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halocline.llm.groups import components, in_blocks, join_counted, local_roots, lowest_of, rows_of
from halocline.llm.workspace import Workspace

NONE = np.zeros(0, np.int64)


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.array([np.asarray(v, np.float64) for v in vectors])
    x = x / np.abs(x).max(1)[:, None]  # keeps the squares in range
    return x / np.linalg.norm(x, axis=1)[:, None]


def choose_pivots(sample: np.ndarray, most: int, apart: float) -> np.ndarray:
    """The first ``most`` unit vectors, in order, of which no two have a cosine above ``apart``."""
    taken, n = np.zeros((min(most, len(sample)), sample.shape[1])), 0
    for v in sample:
        if n < len(taken) and (not n or np.max(taken[:n] @ v) <= apart):
            taken[n] = v
            n += 1
    return taken[:n]


def pivots_for(vectors: int, least: int, nearest: int, shared: int, block: int) -> int:
    """How many pivots keep the mean list of two pivots within ``block`` of so many vectors, ``least`` at least."""
    chosen = nearest - shared + 2
    return max(least, math.ceil(math.sqrt(chosen * (chosen - 1) * vectors / block)))


def link_embeddings(vectors: DataFrame, threshold: float = 0.95, pivots: int = 256, sample: int = 4096, nearest: int = 8, shared: int = 4,
                    block: int = 512, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    n_links: other rows whose cosine is ``threshold`` or more; component_id: the smallest vec_id reachable by links,
    itself included; kept: whether that is its own. Vectors that are null, empty, zero, or hold null or non-finite
    numbers, link with nothing. Only vectors of equal length are compared. Rows with equal vectors link with each
    other; repeated rows, and rows with a null vec_id, count as rows. An empty table gives no rows.

    The index is fit on a sample, the vectors whose hashes are smallest: ``sample`` of them, or 8 a pivot where there
    are more pivots; all vectors are indexed. There are ``pivots``, and more as their root where so many vectors ask
    for it, so that lists do not grow with the table. A pair is found if ``shared`` of its ``nearest`` pivots agree; if
    there are fewer pivots, as many as there are. Of pairs with a cosine of 0.95, nearly all do (tests measure the
    recall against brute force, at the parameters of the query and with more pivots). A vector of any length is read
    whole; of equal ids the class is the same.
    """
    spark = vectors.sparkSession
    work = Workspace(spark, "pivots")
    e = F.col("embedding")
    sound = e.isNotNull() & F.forall(e, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)) & F.exists(e, lambda x: x != 0)
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("embedding")).withColumn("sound", F.coalesce(sound, F.lit(False)))
    key = F.when(F.col("sound"), F.unhex(F.md5(F.to_json(F.struct("embedding")))))
    rows = work.write(rows.withColumn("key", key), "rows")
    classes = rows.filter("sound").groupBy("key").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("n"), F.any_value("embedding").alias("embedding"))
    classes = work.write(classes, "classes")

    pivots = pivots_for(classes.count(), pivots, nearest, shared, block)
    drawn = classes.orderBy(F.xxhash64("key"), "key").limit(max(sample, 8 * pivots)).toPandas()
    by_size: dict[int, np.ndarray] = {}
    for size, part in drawn.groupby(drawn["embedding"].map(len)):
        by_size[int(size)] = choose_pivots(_unit(part["embedding"]), pivots, 0.8)
    sent = spark.sparkContext.broadcast(by_size)

    def describe(batches):
        for batch in batches:
            sizes = batch["embedding"].map(len)
            for size, part in batch.groupby(sizes):
                p = sent.value.get(int(size))
                if p is None:  # no sampled vector is of this length: they share one list
                    near = np.zeros((len(part), 1), int)
                else:
                    k = min(nearest, len(p))
                    cos = _unit(part["embedding"]) @ p.T
                    near = np.argsort(-cos, axis=1, kind="stable")[:, :k]
                yield pd.DataFrame({"key": part["key"], "n": part["n"], "size": int(size), "embedding": part["embedding"], "pivots": list(near)})

    index = work.write(classes.select("key", "n", "embedding").mapInPandas(describe, "key binary, n long, size int, embedding array<double>, pivots array<int>"), "index")
    counts = index.select("size", F.explode("pivots").alias("p")).groupBy("size", "p").agg(F.count(F.lit(1)).alias("c")).collect()  # a row a pivot and length
    rank: dict[int, dict[int, int]] = {}
    for r in sorted(counts, key=lambda r: (r["size"], r["c"], r["p"])):
        of = rank.setdefault(r["size"], {})
        of[r["p"]] = len(of)
    ranks = spark.createDataFrame([(s, [of.get(i, 0) for i in range(max(of) + 1)]) for s, of in rank.items()], "size int, rank array<int>")
    ranked = index.join(F.broadcast(ranks), "size").withColumn("pivots", F.array_sort(F.transform("pivots", lambda p: F.element_at("rank", p + 1)))).drop("rank")
    # with pivots in order of rarity, the two rarest that a pair shares are among the first of either
    k = F.size("pivots")
    first = F.slice("pivots", F.lit(1), F.when(k < nearest, k).otherwise(F.lit(nearest - shared + 2)))
    pairs = F.flatten(F.transform(first, lambda a: F.transform(F.filter(first, lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    pairs = F.when(k < 2, F.transform("pivots", lambda a: F.struct(a.alias("a"), a.alias("b")))).otherwise(pairs)
    lists = ranked.withColumn("of", F.explode(pairs)).select("size", "of.a", "of.b", "key", "n", "pivots", "embedding")
    dealt = in_blocks(lists, ["size", "a", "b"], F.col("key"), block, work)

    def verify(key_: tuple[Any, ...], part: pd.DataFrame) -> pd.DataFrame:
        a, b, bi, bj = key_[1:]
        if len(part) < 2:
            return pd.DataFrame({"key": [], "links": [], "root": []})
        part = part.sort_values("key", kind="stable").reset_index(drop=True)
        own = [np.asarray(p) for p in part["pivots"]]
        has = np.zeros((len(part), max(p.max() for p in own) + 1), np.float32)
        for i, p in enumerate(own):
            has[i, p] = 1
        most = max(len(p) for p in own)
        enough = has @ has.T >= (shared if most >= nearest else min(2, most))
        rarer = has[:, : b + 1].copy()
        rarer[:, [a, b]] = 0
        found = enough & (rarer @ rarer.T == 0)
        if bi != bj:
            side = part["side"].to_numpy(bool)
            found &= side[:, None] != side[None, :]
        x, y = np.nonzero(np.triu(found, 1))
        vectors_ = _unit(part["embedding"])
        near = np.concatenate([np.einsum("ij,ij->i", vectors_[x[i : i + 65536]], vectors_[y[i : i + 65536]]) >= threshold for i in range(0, len(x), 65536)] or [NONE.astype(bool)])
        x, y = x[near], y[near]
        n = part["n"].to_numpy()
        links = np.bincount(x, n[y], len(part)) + np.bincount(y, n[x], len(part))
        root = local_roots(len(part), x, y)
        hit = links > 0
        keys = part["key"].to_numpy()
        return pd.DataFrame({"key": keys[hit], "links": links[hit].astype(np.int64), "root": keys[root[hit]]})

    found = work.write(dealt.groupBy("size", "a", "b", "bi", "bj").applyInPandas(verify, "key binary, links long, root binary"), "found")
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    joined = components(found.filter("key != root").select(F.col("key").alias("a"), F.col("root").alias("b")), work).withColumnRenamed("node", "key")
    placed = classes.select("key", "n", "first_id").join(joined, "key", "left").withColumn("root", F.coalesce("root", "key"))
    placed = lowest_of(work.write(placed, "placed"), "root", "first_id", "component_id", work).join(links, "key", "left")
    result = work.write(placed.select("key", "n", "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")), "result")
    work.keep("rows", "result")
    linked = join_counted(rows.filter("sound").select("vec_id", "key"), result, ["key"], "n", rows_of(result, "n")).select("vec_id", "n_links", "component_id")
    alone = rows.filter("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))
