"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source should be taken target / source size times. The whole part is certain; the fractional
parts are settled in pairs: words move at random from one document to the other until one of the two is taken whole or
not at all. What a pair moves keeps its words constant, so a source's taken words stay at its target to within one
document. Chunks of a source are settled side by side; each leaves one unsettled document at most, and those meet in
chunks again, up a tree, until one is left a source.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from halocline.llm.workspace import Workspace

WORD_BREAK = r"[\x20\x09-\x0D]+"
KEY = ["doc_id", "source", "size", "text_hash"]


def count_words(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), lambda x: x != "")).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """sizes: source, source_size, n_units; a row a source. Adds target.

    A target is a common level times the weight, but ``cap`` times the size at most. Sources sorted by the level at
    which they stop: those before the first that the level left over does not fill are full.
    """
    every = F.array(*[F.lit(float(w)) for w in weights])
    order = W.orderBy(F.col("source").asc_nulls_last())
    by_stop = W.orderBy("stop", "rank")
    before, whole = by_stop.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    ranked = sizes.withColumn("rank", F.row_number().over(order)).withColumn("weight", F.element_at(every, ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    leveled = (
        ranked.withColumn("most", cap * F.col("source_size"))
        .withColumn("stop", F.col("most") / F.col("weight"))
        .withColumn("level", (F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / left)
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("stop"), F.struct("stop", "rank", "level"))).over(whole)["level"])
    )
    target = F.least(F.col("most"), F.coalesce(F.col("level"), F.lit(math.inf)) * F.col("weight"))
    return leveled.select("source", "source_size", "n_units", target.alias("target"))


def settle(words: np.ndarray, share: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Shares in [0, 1] after pairing; all but one at most are 0 or 1, and sum(words * share) is as before."""
    out, held = share.astype(float), -1
    for i in range(len(out)):
        if not 0 < out[i] < 1:
            continue
        if held < 0:
            held = i
            continue
        a, b, most_a, most_b = out[held] * words[held], out[i] * words[i], words[held], words[i]
        to_a, to_b = min(most_a - a, b), min(a, most_b - b)
        if draws[i] * (to_a + to_b) < to_b:  # a gains to_a with odds to_b : to_a, so that nobody's expectation changes
            out[held] = 1.0 if to_a == most_a - a else (a + to_a) / most_a
            out[i] = 0.0 if to_a == b else (b - to_a) / most_b
        else:
            out[held] = 0.0 if to_b == a else (a - to_b) / most_a
            out[i] = 1.0 if to_b == most_b - b else (b + to_b) / most_b
        held = held if 0 < out[held] < 1 else i if 0 < out[i] < 1 else -1
    return out


def _settle_chunk(chunk: pd.DataFrame) -> pd.DataFrame:
    # large documents first: the small ones that follow fill them up, and what is left open is small
    chunk = chunk.assign(words=-chunk["size"]).sort_values(["words", "place", "text_hash", "draw"], kind="stable").drop(columns="words").reset_index(drop=True)
    draws = (chunk["draw"].to_numpy(np.int64).view(np.uint64) >> np.uint64(11)) / float(1 << 53)
    chunk["share"] = settle(chunk["size"].to_numpy(float), chunk["share"].to_numpy(float), draws)
    return chunk


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0, fan_in: int = 1024, seed: int = 0,
        doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """One or two rows per distinct (doc_id, source, size, text_hash) of ``docs``: KEY, n, source_size, target, copies.

    size: words of the text (null: 0); text_hash: xxhash64 of the text; n: how many rows with this key take so many
    ``copies``, at most ``cap`` rounded up each. Rows that share a key are alike: settling them in pairs leaves some
    with one copy more than the others, and one open, which goes on. Sources sorted by code point, null last, take the
    weights in turn and share the size of all; no target exceeds ``cap`` times its source's size. Words of a source
    taken, the sum of n * size * copies, differ from its target by less than the words of one document. The draws are
    hashes of keys and ``seed``: reruns agree, whatever the partitions. Empty tables give no rows; texts without words
    get the whole part of their source's ratio. Targets are set in one task, which gets a row a source. Other columns
    of ``docs`` play no part.
    """
    work = Workspace(docs.sparkSession, "mix")
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), count_words(F.col(text)).alias("size"), F.xxhash64(F.col(text)).alias("text_hash"))
    units = work.write(keyed.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")), "units")
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count(F.lit(1)).alias("n_units"))
    aims = work.write(targets(sizes, weights, cap), "targets")
    largest = aims.agg(F.max("n_units")).first()[0] or 0

    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    aims = aims.withColumnRenamed("source", "aim_source").withColumns({"whole": F.floor(ratio), "share": ratio - F.floor(ratio)})
    drawn = lambda level, use: F.xxhash64(*[F.col(c) for c in KEY], F.lit(seed), F.lit(level), F.lit(use))
    draws = lambda level: {"place": drawn(level, 0), "draw": drawn(level, 1)}
    state = units.join(aims, F.col("source").eqNullSafe(F.col("aim_source"))).withColumn(
        "chunk", F.pmod(F.xxhash64(*[F.col(c) for c in KEY], F.lit(seed)), F.ceil(F.col("n_units") / fan_in))
    )
    # n rows that are alike, of the same share: some take one copy more, one is left with what is over
    over = F.col("n") * F.col("share")
    open_ = (F.col("share") > 0) & (F.col("size") > 0)
    more = F.when(open_, F.floor(over)).otherwise(F.lit(0)).cast("long")
    state = state.select(*KEY, "n", "source_size", "target", "whole", more.alias("more"), F.when(open_, over - F.floor(over)).otherwise(F.lit(0.0)).alias("share"), "chunk").withColumns(draws(0))
    open_ = (F.col("share") > 0) & (F.col("share") < 1)
    settled, chunks, level = [state.filter(~open_)], max(1, math.ceil(largest / fan_in)), 0
    state = state.filter(open_)
    while True:
        state = work.write(state.groupBy("source", "chunk").applyInPandas(_settle_chunk, state.schema), f"level{level}")
        settled.append(state.filter(~open_))
        state = state.filter(open_)
        if chunks == 1:
            break
        level, chunks = level + 1, math.ceil(chunks / fan_in)
        state = state.withColumns({"chunk": F.col("chunk") % chunks} | draws(level))
    # one document a source may be left; it is taken with its share as the odds
    last = F.shiftrightunsigned(drawn(level, 2), 11) / float(1 << 53)
    settled.append(state.withColumn("share", F.when(last < F.col("share"), 1.0).otherwise(0.0)))
    every = settled[0]
    for further in settled[1:]:
        every = every.unionByName(further)
    taken = F.col("more") + F.col("share").cast("long")  # rows with one copy more than the others
    parts = F.array(F.struct((F.col("n") - taken).alias("n"), F.lit(0).alias("extra")), F.struct(taken.alias("n"), F.lit(1).alias("extra")))
    every = every.withColumn("part", F.explode(F.filter(parts, lambda p: p["n"] > 0)))
    return every.select(*KEY, "part.n", "source_size", "target", (F.col("whole") + F.col("part.extra")).cast("long").alias("copies"))


def rows_of_mix(mixed: DataFrame, chunk: int = 10_000) -> DataFrame:
    """A row for each of the ``n`` rows that ``mixed`` counts; a row that stands very often is dealt out in chunks."""
    last = ((F.col("n") - 1) / chunk).cast("long")
    few = mixed.filter(F.col("n") <= chunk).withColumn("many", F.col("n"))
    often = mixed.filter(F.col("n") > chunk).withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), last))).repartition("c", *KEY)
    often = often.withColumn("many", F.least(F.lit(chunk).cast("long"), F.col("n") - F.col("c") * chunk)).drop("c")
    every = few.unionByName(often)
    return every.withColumn("row", F.explode(F.array_repeat(F.lit(0), F.col("many").cast("int")))).drop("row", "many", "n")
