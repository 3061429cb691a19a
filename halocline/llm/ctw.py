"""Language-model scores by context-tree weighting over bytes, each byte decomposed into eight bits.

The model is counted over all training texts. A node is a context of d bytes, d from 0 to ``depth``, with the bits of
the next byte read so far; it holds how often a 0 and a 1 followed. Its Krichevsky-Trofimov estimate of those bits is
mixed, half and half, with the product over the contexts that are one byte longer, from the longest contexts down to
none; so every node carries the weight that its own estimate has against those of longer contexts. Going back up, a
bit's probability is the sum over all depths of estimate times weight. The counts then stand still: a text's score
depends on the model alone.

Counting, weighting and mixing are joins and sums over nodes. Texts are dealt into blocks of bounded size. A block
sends the distinct byte strings of depth + 1 that it holds, and gets back one probability for each, so that no task
holds the model. The baseline, a smoothed count of words, takes the same way.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halocline.llm.hashing import normalize, word_hashes
from halocline.llm.workspace import Workspace

END = 0  # key of the token that ends a text
STRIDE = 1 << 18  # bytes that are turned into grams at once
BLOCKS = 1 << 24  # blocks that one partition may number
MERGE = 1 << 19  # keys that are gathered before they are merged


def grams(texts: list[bytes], depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(gram, index of its text) for every byte, some at a time: the byte and the ``depth`` before it, 0 before the text."""
    held, index, size = [], [], 0
    for i, text in enumerate(texts):
        for at in range(0, len(text), STRIDE):
            before = text[max(0, at - depth) : at]
            part = bytes(depth - len(before)) + before + text[at : at + STRIDE]
            held.append(part)
            index.append((i, len(part)))
            size += len(part)
            if size >= STRIDE:
                yield _pack(held, index, depth)
                held, index, size = [], [], 0
    if held:
        yield _pack(held, index, depth)


def _pack(held: list[bytes], index: list[tuple[int, int]], depth: int) -> tuple[np.ndarray, np.ndarray]:
    b = np.frombuffer(b"".join(held), np.uint8)
    lengths = np.array([n for _, n in index])
    own = np.ones(len(b), bool)  # the first ``depth`` bytes of a part are only context
    starts = np.r_[0, np.cumsum(lengths)[:-1]]
    for k in range(depth):
        own[starts + k] = False
    # a word of eight bytes begins at every byte: the first depth + 1 of them are the gram
    words = np.ndarray((len(b) - depth,), ">u8", np.r_[b, np.zeros(8, np.uint8)], strides=(1,))
    gram = (words >> np.uint64(8 * (7 - depth))).astype(np.int64)
    return gram[own[depth:]], np.repeat([i for i, _ in index], lengths - depth)


def stage(docs: DataFrame, train: Column, block_bytes: int, doc_id: str, text: str) -> DataFrame:
    """doc_id, train, block, n_tokens, body: the normalized texts in blocks of about ``block_bytes``."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text).alias("text"), F.spark_partition_id().alias("part"))
    schema = rows.select("doc_id", "train").schema.add("block", "long").add("n_tokens", "long").add("body", "binary")

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = 0
        for batch in batches:
            body = [normalize(t) for t in batch["text"]]
            ends = size + np.cumsum([len(x) for x in body])
            size = int(ends[-1]) if len(ends) else size
            tokens = [x.count(b" ") + (len(x) > 1) + 1 for x in body]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "train": batch["train"], "block": batch["part"].astype("int64") * BLOCKS + ends // block_bytes, "n_tokens": tokens, "body": body})

    return rows.mapInPandas(deal, schema)


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Runs of rows of the same block, which written tables keep together."""
    block, held = None, []
    for batch in batches:
        of = batch.column("block").to_numpy()
        starts = _runs(of)
        for a, b in zip(starts, [*starts[1:], len(of)], strict=True):
            if of[a] != block and held:
                yield block, held
                held = []
            block = int(of[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield block, held


def _runs(sorted_: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]]) if len(sorted_) else np.zeros(0, int)


class _Counts:
    """Distinct keys with the number of their learned occurrences."""

    def __init__(self):
        self.keys: list[np.ndarray] = []
        self.n: list[np.ndarray] = []

    def add(self, keys: np.ndarray, learned: int) -> None:
        part = np.sort(keys)
        first = _runs(part)
        self.keys.append(part[first])
        self.n.append(np.diff(np.r_[first, len(part)]) * learned)
        if sum(map(len, self.keys[1:])) > MERGE:
            self.merged()

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        keys, n = np.concatenate(self.keys), np.concatenate(self.n)
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        first = _runs(keys)
        self.keys, self.n = [keys[first]], [np.add.reduceat(n, first) if len(first) else n]
        return self.keys[0], self.n[0]


def counter(depth: int):
    """Rows (block, token, key, n) of a block: its distinct words' hashes (token) and its distinct grams."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, parts in _by_block(batches):
            words, strings = _Counts(), _Counts()
            for part in parts:
                train, bodies = part.column("train").to_numpy(zero_copy_only=False), part.column("body").to_pylist()
                for learned in (0, 1):
                    some = [body for body, t in zip(bodies, train.tolist(), strict=True) if t == bool(learned)]
                    words.add(np.full(len(some), END), learned)
                    for h, _ in word_hashes(some):
                        words.add(h.view(np.int64), learned)
                    for g, _ in grams(some, depth):
                        strings.add(g, learned)
            for token, counts in ((True, words), (False, strings)):
                key, n = counts.merged()
                yield pa.RecordBatch.from_pydict({"block": np.full(len(key), block), "token": np.full(len(key), token), "key": key, "n": n})

    return count


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x >= 1/2: Stirling's series at x + 8, taken back by the recurrence."""
    y = x + 8
    product = x
    for k in range(1, 8):
        product = product * (x + k)
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5.0)))
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - F.log(product)


def log_block(n0: Column, n1: Column) -> Column:
    """ln of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return F.when((n0 == 0) & (n1 == 0), 0.0).otherwise(log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0) - math.log(math.pi))


def _bits(counted: DataFrame) -> DataFrame:
    """A row for each bit of a gram's last byte: key (context, then bits read with a leading 1), bit."""
    byte = F.col("gram").bitwiseAND(F.lit(255))
    read = lambda k: F.shiftrightunsigned(byte, 8 - k).bitwiseOR(F.lit(1 << k))
    pairs = F.array(*[
        F.struct((F.col("gram") - byte + read(k)).alias("key"), F.shiftrightunsigned(byte, 7 - k).bitwiseAND(F.lit(1)).alias("bit")) for k in range(8)
    ])
    return counted.withColumn("node", F.explode(pairs)).select("gram", *[c for c in counted.columns if c != "gram"], "node.key", "node.bit")


def _shorter(key: Column, depth: int) -> Column:
    """The key whose context of ``depth`` bytes lacks the oldest byte."""
    return key.bitwiseAND(F.lit((1 << (8 * depth)) - 1))


def train_model(counted: DataFrame, depth: int, work: Workspace) -> DataFrame:
    """counted: gram, n; distinct grams, n 0 where only unlearned texts have it. Returns gram, log10_p of its last byte."""
    zeros, ones = F.sum(F.when(F.col("bit") == 0, F.col("n")).otherwise(0)), F.sum(F.when(F.col("bit") == 1, F.col("n")).otherwise(0))
    own = log_block(F.col("n0"), F.col("n1"))
    level = _bits(counted).groupBy("key").agg(zeros.alias("n0"), ones.alias("n1"))
    level = work.write(level.withColumns({"weighted": own, "alone": F.lit(1.0)}), f"depth{depth}")
    levels = [level]
    for d in range(depth, 0, -1):
        up = levels[0].groupBy(_shorter(F.col("key"), d).alias("key")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("weighted").alias("longer"))
        up = up.withColumn("own", own)
        # ln (e^own + e^longer) / 2, and the own estimate's part in it
        mixed = F.greatest("own", "longer") + F.log1p(F.exp(-F.abs(F.col("own") - F.col("longer")))) - math.log(2)
        up = up.select("key", "n0", "n1", mixed.alias("weighted"), F.exp(F.col("own") + math.log(0.5) - mixed).alias("alone"))
        levels.insert(0, work.write(up, f"depth{d - 1}"))
    zero = (F.col("n0") + 0.5) / (F.col("n0") + F.col("n1") + 1)
    mix = levels[0].select("key", (F.col("alone") * zero).alias("p0"), (1 - F.col("alone")).alias("left"))
    for d in range(1, depth + 1):
        above = mix.withColumnRenamed("key", "above").hint("merge")  # it grows with the corpus: never broadcast
        joined = levels[d].withColumn("above", _shorter(F.col("key"), d)).join(above, "above")
        mix = joined.select("key", (F.col("p0") + F.col("left") * F.col("alone") * zero).alias("p0"), (F.col("left") * (1 - F.col("alone"))).alias("left"))
    p = F.when(F.col("bit") == 0, F.col("p0")).otherwise(1 - F.col("p0"))
    return _bits(counted.select("gram")).join(mix.hint("merge"), "key").groupBy("gram").agg(F.sum(F.log10(p)).alias("log10_p"))


def score(docs: DataFrame, train: Column, depth: int = 5, block_bytes: int = 16 << 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, train, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    ``train``: boolean column, null as false; the rows to learn from. score: log10 of the model's probability of the
    normalized text with its end; base_score: that of its tokens by counts smoothed with 0.1. A null text is as an
    empty one: one token, the end. Repeated rows count as often as they stand and are scored alike. Bytes that no
    context has foretold are scored by the shorter contexts, at worst half a bit's odds each. If nothing is learned,
    every bit has odds of one half. An empty table gives no rows. Columns of ``docs`` beyond these are left out; of
    equal texts the scores are equal. ``depth`` is 6 at most, as a context and its byte are one key of 64 bits; there
    the bytes before a text are NUL, which a NUL in a text is taken for. A block's share of a task's memory is some 12
    times ``block_bytes``, or of its longest text. Words are counted by 64-bit hashes: of some 10^9 distinct words the
    first may share one, and would be counted together. Counts are exact up to 2^53; probabilities are rounded to 32-bit
    floats, which keeps the tables small. A key that is in
    every block has a row a block in the join that answers it, 6 million at 100 TB, which skew handling may split.
    """
    if not 1 <= depth <= 6:
        raise ValueError("depth is 1 to 6")
    spark = docs.sparkSession
    work = Workspace(spark, "ctw")
    staged = work.write(stage(docs, train, block_bytes, doc_id, text), "staged")
    lists = work.write(staged.select("block", "train", "body").mapInArrow(counter(depth), "block long, token boolean, key long, n long"), "lists")
    sums = lists.groupBy("token", "key").agg(F.sum("n").alias("n"))
    words = work.write(sums.filter("token and n > 0").select("key", "n"), "words")
    total = words.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = total["n"] or 0, total["v"]
    counted = work.write(sums.filter("not token").select(F.col("key").alias("gram"), "n"), "counted")
    model = work.write(train_model(counted, depth, work), "model")
    work.drop("counted", *[f"depth{d}" for d in range(depth + 1)])
    # what a block is told: of a word (token) its count, of a gram log10 of its probability
    learned = words.select(F.lit(True).alias("token"), "key", F.col("n").cast("double").alias("value"))
    learned = learned.unionByName(model.select(F.lit(False).alias("token"), F.col("gram").alias("key"), F.col("log10_p").cast("float").cast("double").alias("value")))
    told = work.write(lists.select("block", "token", "key").join(learned.hint("merge"), ["token", "key"]).select("block", "token", "key", "value"), "told")
    work.keep("staged", "told")

    def lookup(key: np.ndarray, value: np.ndarray) -> tuple[pd.Index, np.ndarray]:
        """The keys, and their values with a 0 more for a key that is not there."""
        keys = pd.Index(key)
        if not keys.is_unique:  # a block that two tasks have read comes twice
            once = ~keys.duplicated()
            keys, value = keys[once], value[once]
        return keys, np.r_[value.astype(float), 0.0]

    def block(rows: pa.Table, told: pa.Table) -> pa.Table:
        bodies, key, value, many = rows.column("body").to_pylist(), told.column("key").to_numpy(), told.column("value").to_numpy(), rows.num_rows
        token = told.column("token").to_numpy()
        rows = rows.drop_columns(["body"])
        del told
        keys, counts = lookup(key[token], value[token])
        log = np.log10((counts + 0.1) / (n + 0.1 * (v + 1)))
        at = keys.get_indexer([END])[0]
        base, known = np.full(many, log[at]), np.full(many, int(at >= 0))
        for h, i in word_hashes(bodies):
            at = keys.get_indexer(h.view(np.int64))
            base += np.bincount(i, log[at], many)
            known += np.bincount(i[at >= 0], minlength=many)
        keys, log = lookup(key[~token], value[~token])
        sums = np.zeros(many)
        for g, i in grams(bodies, depth):
            sums += np.bincount(i, log[keys.get_indexer(g)], many)
        size = np.array([len(t) for t in bodies])
        return pa.table({
            "doc_id": rows.column("doc_id"), "train": rows.column("train"), "n_tokens": rows.column("n_tokens"), "n_known": known, "train_tokens": np.full(many, n),
            "base_score": base, "score": sums, "n_bytes": size, "bits_per_byte": -sums * math.log2(10) / size,
        })

    schema = staged.select("doc_id", "train", "n_tokens").schema
    for name, kind in (("n_known", "long"), ("train_tokens", "long"), ("base_score", "double"), ("score", "double"), ("n_bytes", "long"), ("bits_per_byte", "double")):
        schema = schema.add(name, kind)
    return staged.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(block, schema)
