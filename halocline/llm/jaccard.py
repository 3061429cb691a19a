"""Self-join of word n-gram sets with a Jaccard similarity of a threshold or more, by chosen paths.

In a run every set walks down a random tree: at each node it chooses each of its tokens (n-gram hashes) by a hash of
path and token that all sets share, and goes on along every token chosen. Two sets that are similar enough share one
chosen token at the first step in the mean, and more at later ones; others part. Small buckets are compared by brute
force. Large ones are compared in blocks if their sets are so alike that no token would part them; if not, they are
dealt out by the sizes of the sets, which parts no similar pair, and what is still large is split by further tokens.
Independent runs are made until the target recall.

Comparing takes two steps. Sketches of 128 bytes first clear the pairs that are far from the threshold; then the sets
of those that remain are compared in full, so that no link is wrong. A pair counts in the first bucket that its two
sets share, and nowhere else. Pairs are never listed: a bucket returns a count of links for each set and what joins
the sets to components.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from halocline.llm.groups import components, in_blocks, join_counted, local_roots, lowest_of, marked, rows_of, runs_for
from halocline.llm.hashing import mix, normalize, word_hashes
from halocline.llm.workspace import Workspace

SKETCH = 128
SLICE = 4 << 20  # bytes of text whose n-grams are made at once


def ngram_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its word n-grams; of fewer words, one of them all; of none, none."""
    out: list[np.ndarray] = []
    bodies = [normalize(t) for t in texts]
    size, begin = 0, 0
    for i in range(len(bodies) + 1):
        if i == len(bodies) or (size and size + len(bodies[i]) > SLICE):
            out += _sets(bodies[begin:i], n)
            size, begin = 0, i
        if i < len(bodies):
            size += len(bodies[i])
    return out


def _sets(bodies: list[bytes], n: int) -> list[np.ndarray]:
    found = [*word_hashes(bodies)]
    words = np.concatenate([h for h, _ in found]) if found else np.zeros(0, np.uint64)
    of = np.concatenate([i for _, i in found]) if found else np.zeros(0, int)
    ends = np.searchsorted(of, np.arange(len(bodies) + 1))
    many = max(0, len(words) - n + 1)
    grams = np.zeros(many, np.uint64)
    for k in range(n):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + words[k : k + many]
    grams = mix(grams)
    out = []
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            few = 0
            for w in words[a:b].tolist():
                few = (few * 0xC2B2AE3D27D4EB4F + w) % 2**64
            out.append(mix(np.array([few], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def choose(tokens: np.ndarray, paths: np.ndarray, threshold: float, expected: float = 1.0) -> np.ndarray:
    """The paths that a set of tokens goes on along from each of ``paths``; of two sets at the threshold ``expected``
    are shared in the mean, or more if the sets are of nearly the same size."""
    drawn = mix(tokens[None, :] ^ mix(paths)[:, None])
    odds = min(1.0, expected / (threshold * max(1, len(tokens))))
    return mix(drawn[drawn <= np.uint64(min(2**64 - 1, int(odds * 2**64)))] ^ np.uint64(0xD1B54A32D192ED03))


def found_in_run(steps: int, later: float) -> float:
    """The least odds that a pair at the threshold shares a path of ``steps`` steps in a run, of which the first shares
    one token in the mean and the others ``later``."""
    odds = 1.0
    for _ in range(steps - 1):
        odds = 1 - math.exp(-later * odds)
    return 1 - math.exp(-odds)


def sketch(tokens: np.ndarray) -> bytes:
    """A byte for each of SKETCH ranges of hashes: of the smallest token there, 0 if there is none. tokens are sorted."""
    edges = np.arange(SKETCH, dtype=np.uint64) * np.uint64(2**64 // SKETCH)
    at = np.searchsorted(tokens, edges)
    first = tokens[np.minimum(at, len(tokens) - 1)]
    there = (at < len(tokens)) & (first // np.uint64(2**64 // SKETCH) == np.arange(SKETCH, dtype=np.uint64))
    return np.where(there, mix(first) % np.uint64(255) + np.uint64(1), 0).astype(np.uint8).tobytes()


def _shared(rows: list[np.ndarray], below: int | None = None) -> np.ndarray:
    """Matrix of how many values each two of the sorted sets share, of those less than ``below``."""
    lengths = [len(r) if below is None else int(np.searchsorted(r, below)) for r in rows]
    values = np.concatenate([r[:k] for r, k in zip(rows, lengths, strict=True)]) if rows else np.zeros(0)
    of = np.repeat(np.arange(len(rows)), lengths)
    _, column, count = np.unique(values, return_inverse=True, return_counts=True)
    common = count > 1  # a value that one set has is shared by none
    number = np.cumsum(common) - 1
    keep = common[column]
    of, column = of[keep], number[column[keep]]
    total = np.zeros((len(rows), len(rows)), np.float32)  # whole numbers, exact up to 2^24
    order = np.argsort(column, kind="stable")
    of, column = of[order], column[order]
    for at in range(0, int(common.sum()), 4096):
        a, b = np.searchsorted(column, [at, at + 4096])
        block = np.zeros((len(rows), 4096), np.float32)
        block[of[a:b], column[a:b] - at] = 1
        total += block @ block.T
    return total


def _parts(batches: Iterator[pd.DataFrame], rows: int = 1000) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.iloc[at : at + rows]


def _agreement(a: Column, b: Column) -> Column:
    """Share of the sketches' first 32 ranges that agree, of those in which either has a token."""
    here = F.transform(F.sequence(F.lit(1), F.lit(32)), lambda i: F.struct(F.hex(F.substring(a, i, F.lit(1))).alias("a"), F.hex(F.substring(b, i, F.lit(1))).alias("b")))
    either = F.filter(here, lambda x: (x["a"] != "00") | (x["b"] != "00"))
    return F.size(F.filter(either, lambda x: x["a"] == x["b"])) / F.greatest(F.size(either), F.lit(1))


def _groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of rows with the same leaf, bi and bj; the partitions are sorted by these."""
    held: list[pd.DataFrame] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        ids = batch[["leaf", "bi", "bj"]].to_numpy()
        cuts = np.r_[0, np.flatnonzero((ids[1:] != ids[:-1]).any(1)) + 1, len(ids)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            now = tuple(ids[a])
            if now != last and held:
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            last = now
            held.append(batch.iloc[a:b])
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def _fresh(group: pd.DataFrame) -> np.ndarray:
    """Which pairs of the group (upper triangle) are to be compared here: blocks that meet, no earlier bucket shared."""
    leaf, bi, bj = group["leaf"].iat[0], group["bi"].iat[0], group["bj"].iat[0]
    pairs = _shared([np.asarray(x) for x in group["leaves"]], leaf) == 0
    if bi != bj:
        side = group["side"].to_numpy(bool)
        pairs &= side[:, None] != side[None, :]
    return np.triu(pairs, 1)


def clear(threshold: float) -> Callable:
    """Keeps the members of a group that have a pair whose sketches do not rule ``threshold`` out: of the ranges that
    either has a token in, the share that agrees is less by five standard deviations at most."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _groups(batches):
            if len(group) < 2:
                continue
            marks = np.frombuffer(b"".join(group["sketch"]), np.uint8).reshape(len(group), SKETCH)
            pairs = _fresh(group)
            for i in np.flatnonzero(pairs.any(1)):
                later = np.flatnonzero(pairs[i])
                either = np.maximum(1, ((marks[later] > 0) | (marks[i] > 0)).sum(1))
                agree = ((marks[later] == marks[i]) & (marks[i] > 0)).sum(1)
                pairs[i, later] = agree / either >= threshold - 5 * np.sqrt(threshold * (1 - threshold) / either)
            hit = pairs.any(0) | pairs.any(1)
            if hit.any():
                yield group.loc[hit, ["leaf", "bi", "bj", "side", "leaves", "key"]]

    return run


def compare(threshold: float) -> Callable:
    """Links and local roots of the members of a group, by their whole sets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _groups(batches):
            if len(group) < 2:
                continue
            group = group.sort_values("key", kind="stable").reset_index(drop=True)
            sets = [np.frombuffer(x, np.uint64) for x in group["tokens"]]
            size = np.array([len(s) for s in sets])
            common, fresh = _shared(sets), _fresh(group)
            for at in range(0, len(group), 256):  # some rows at a time, in double precision
                part = common[at : at + 256].astype(float) * (1 + threshold)
                # the small term absorbs rounding: similarities are ratios of whole numbers
                fresh[at : at + 256] &= part >= threshold * (size[at : at + 256, None] + size[None, :]) - 1e-6
            x, y = np.nonzero(fresh)
            if not len(x):
                continue
            n = group["n"].to_numpy()
            links = np.bincount(x, n[y], len(group)) + np.bincount(y, n[x], len(group))
            root = local_roots(len(group), x, y)
            hit, keys = links > 0, group["key"].to_numpy()
            yield pd.DataFrame({"key": keys[hit], "links": links[hit].astype(np.int64), "root": keys[root[hit]]})

    return run


def join_similar(docs: DataFrame, threshold: float = 0.8, words: int = 5, recall: float = 0.9995, small: int = 512, alike: float = 0.3,
                 depth: int = 3, later: float = 2.0, block: int = 1024, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, text_key, class_id, n_links, copy_of, kept.

    n_links: other rows whose sets of ``words``-grams (of words in ASCII lower case) have a Jaccard similarity of
    ``threshold`` or more, exact copies included; class_id: the smallest doc_id that links reach; copy_of: the
    smallest doc_id with the same text; text_key: md5 of the text, null if it has no words; kept: whether the row has
    the text that stays of its class (that of the smallest copy_of, null last, then of the smallest text_key) and its
    copy_of for a doc_id. A text of fewer words is one n-gram of them all. A text that is null or has no words links
    with nothing, is its own class and is kept. Repeated rows, and rows with a null doc_id, count as rows; a null
    doc_id is a class_id only if its class has no other. doc_id is of any orderable type. Other columns are left out;
    an empty table gives no rows. Texts of any length are read whole. Link counts of a group of different texts that
    are all alike take a comparison a pair: they are dealt out in blocks.

    Runs follow from ``recall``, the odds that a pair at the threshold is found though all its buckets take ``depth``
    steps, which is the more certain the more similar the pair. Buckets of up to ``small`` sets are compared as they
    are. Larger ones whose sets have a mean similarity of ``alike`` or more are compared in blocks of ``block``, every
    two of which meet. The others are dealt out by size; those that stay large are split, with ``later`` shared tokens
    to be expected of a pair at the threshold. What is large after the last step is compared in blocks, too.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "jaccard")
    runs = runs_for(recall, found_in_run(depth, later))
    has_words = F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.when(has_words, F.unhex(F.md5(F.col(text).cast("binary")))).alias("key"), F.col(text).alias("text"))

    def begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        roots = mix(np.arange(1, runs + 1, dtype=np.uint64))
        for batch in _parts(batches):
            sets = ngram_sets(list(batch["text"]), words)
            paths = [choose(s, roots, threshold).view(np.int64) if len(s) else np.zeros(0, np.int64) for s in sets]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "key": batch["key"], "paths": paths, "tokens_n": [len(s) for s in sets], "sketch": [sketch(s) if len(s) else None for s in sets]})

    schema = keyed.select("doc_id", "key").schema.add("paths", T.ArrayType(T.LongType())).add("tokens_n", T.IntegerType()).add("sketch", "binary")
    rows = work.write(keyed.mapInPandas(begin, schema), "rows")
    classes = rows.filter("key is not null").groupBy("key").agg(
        F.min("doc_id").alias("copy_of"), F.count(F.lit(1)).alias("n"), F.any_value("paths").alias("paths"), F.any_value("tokens_n").alias("tokens_n"), F.any_value("sketch").alias("sketch")
    )
    classes = work.write(classes, "classes")
    worded = rows_of(classes, "n")
    sketches = classes.select("key", "sketch")

    def sets_of(keys: DataFrame, name: str) -> DataFrame:
        """key, n, tokens of some classes, made anew from the text of a row with their copy_of. Other texts stay where
        they are."""
        first = F.xxhash64("copy_of").alias("at")
        wanted = work.write(classes.join(keys, "key", "left_semi").select("key", first, "n", "copy_of"), f"{name}_wanted")
        texts = keyed.filter("key is not null").withColumn("at", F.xxhash64("doc_id"))
        texts = marked(texts, wanted, ["key", "at"], "may_be").filter("may_be").drop("may_be")
        found = join_counted(texts, wanted, ["key", "at"], "n", worded).filter(F.col("doc_id").eqNullSafe(F.col("copy_of")))
        return found.select("key", "n", "text").dropDuplicates(["key"]).mapInPandas(fill, "key binary, n long, tokens binary")

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _parts(batches):
            yield pd.DataFrame({"key": batch["key"], "n": batch["n"], "tokens": [s.tobytes() for s in ngram_sets(list(batch["text"]), words)]})

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _parts(batches):
            on = [choose(np.frombuffer(s, np.uint64), np.array([p], np.int64).view(np.uint64), threshold, later) for s, p in zip(batch["tokens"], batch["leaf"], strict=True)]
            yield pd.DataFrame({**{c: np.repeat(batch[c].to_numpy(), [len(x) for x in on]) for c in ("key", "tokens_n")}, "leaf": np.concatenate(on).view(np.int64) if on else []})

    def crowded(level: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """Rows (key, leaf) of the small buckets of two sets or more, and those of the large ones. Of buckets
        that hold the same sets one stays: whatever the others would find, it finds."""
        counted = work.write(level.groupBy("leaf").agg(F.count(F.lit(1)).alias("size"), F.sum(F.xxhash64("key").cast("decimal(20,0)")).alias("print")), f"{name}_counted")
        once = work.write(counted.filter("size > 1").groupBy("size", "print").agg(F.min("leaf").alias("leaf")).select("leaf", "size"), f"{name}_sizes")
        shared = work.write(join_counted(level, once, ["leaf"], "size", rows_of(counted, "size")), f"{name}_shared")
        return shared.filter(F.col("size") <= small).select("key", "leaf"), shared.filter(F.col("size") > small).drop("size")

    level = work.write(classes.select("key", "tokens_n", F.explode(F.array_distinct("paths")).alias("leaf")), "level1")
    leaves, sets, size_class = None, None, F.floor(F.log("tokens_n") / (math.log(1 / threshold) + 1e-9)).cast("int")
    for at in range(1, depth + 1):
        found, large = crowded(level, f"level{at}")
        leaves = found if leaves is None else leaves.union(found)
        if large.isEmpty():
            break
        if at == depth:
            leaves = leaves.union(large.select("key", "leaf"))
            break
        # mean similarity of a bucket, from eight of its members: they alone get their sketches
        some = large.groupBy("leaf").agg(F.count(F.lit(1)).alias("size"), F.array(*[F.min_by("key", F.xxhash64("key", F.lit(k))) for k in range(8)]).alias("some"))
        some = some.select("leaf", "size", F.posexplode("some").alias("k", "key")).join(sketches, "key")
        some = some.groupBy("leaf", "size").agg(*[F.max(F.when(F.col("k") == k, F.col("sketch"))).alias(f"s{k}") for k in range(8)])
        pairs = [_agreement(F.col(f"s{i}"), F.col(f"s{k}")) for k in range(8) for i in range(k)]
        mean = work.write(some.select("leaf", "size", (sum(pairs, F.lit(0.0)) / len(pairs)).alias("mean")), f"mean{at}")
        large = work.write(join_counted(large, mean, ["leaf"], "size", rows_of(mean, "size")), f"large{at}")
        leaves = leaves.union(large.filter(F.col("mean") >= alike).select("key", "leaf"))
        # sets that are similar enough are of the same class of sizes, or of one next to it
        apart = large.filter(F.col("mean") < alike).select("key", "tokens_n", "leaf")
        dealt = apart.withColumn("class", F.explode(F.array(size_class, size_class + 1))).select("key", "tokens_n", F.xxhash64("leaf", "class").alias("leaf"))
        found, rest = crowded(work.write(dealt, f"dealt{at}"), f"dealt{at}")
        leaves = leaves.union(found)
        if rest.isEmpty():
            break
        if sets is None:  # deeper buckets hold no others
            sets = work.write(sets_of(rest.select("key").distinct(), "split"), "split_sets").drop("n")
        level = work.write(rest.join(sets, "key").mapInPandas(split, "key binary, tokens_n int, leaf long").distinct(), f"level{at + 1}")
    leaves = work.write(leaves, "leaves")
    work.keep("rows", "classes", "leaves")

    order = ["leaf", "bi", "bj"]
    members = leaves.groupBy("key").agg(F.array_sort(F.collect_list("leaf")).alias("leaves")).join(sketches, "key").withColumn("leaf", F.explode("leaves"))
    members = members.withColumn("leaves", F.filter("leaves", lambda x: x < F.col("leaf")))  # only earlier ones are asked for
    cleared = in_blocks(members, ["leaf"], F.col("key"), block, work, leaves).repartition(*order).sortWithinPartitions(*order)
    cleared = work.write(cleared.mapInPandas(clear(threshold), "leaf long, bi int, bj int, side boolean, leaves array<long>, key binary"), "cleared")
    whole = cleared.join(sets_of(cleared.select("key").distinct(), "cleared"), "key").repartition(*order).sortWithinPartitions(*order)
    links = work.write(whole.mapInPandas(compare(threshold), "key binary, links long, root binary"), "links")
    work.keep("rows", "classes", "links")

    joined = components(links.filter("key != root").select(F.col("key").alias("a"), F.col("root").alias("b")), work).withColumnRenamed("node", "key")
    counts = links.groupBy("key").agg(F.sum("links").alias("links"))
    placed = classes.select("key", "n", "copy_of").join(joined, "key", "left").withColumn("root", F.coalesce("root", "key"))
    # the smallest doc_id, null last; of equal ones the smallest text
    placed = placed.withColumn("rank", F.struct(F.col("copy_of").isNull().alias("none"), F.col("copy_of").alias("id"), F.col("key").alias("key")))
    placed = lowest_of(work.write(placed, "placed"), "root", "rank", "first", work).join(counts, "key", "left")
    found = (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")
    result = work.write(placed.select("key", "n", F.col("first.id").alias("class_id"), "copy_of", (F.col("first.key") == F.col("key")).alias("stays"), found), "result")
    work.keep("rows", "result")
    out = join_counted(rows.filter("key is not null").select("doc_id", "key"), result, ["key"], "n", worded).select(
        "doc_id", F.col("key").alias("text_key"), "class_id", "n_links", "copy_of", (F.col("stays") & F.col("doc_id").eqNullSafe(F.col("copy_of"))).alias("kept")
    )
    own = rows.filter("key is null").select("doc_id", F.col("key").alias("text_key"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("copy_of"), F.lit(True).alias("kept"))
    return out.unionByName(own)
