"""Language identification by a Bloom filter whose slots are bitmasks of languages.

A slot of the filter is a row of bits, one a language: it is set for the languages of which an n-gram hashes there.
The AND of an n-gram's slots are all languages that may contain it. For each language the bits of a text's n-grams
are counted; the share that the language's false positives would make is taken off; the largest share decides.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from halocline.llm.workspace import Workspace

N = 4
HASHES = 3
PIECE = 1 << 18  # characters that are hashed at once
UNDETERMINED = "und"


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def pieces(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes of the n-grams, row of each) of all texts, some characters at a time; a longer text comes in pieces.

    Letters in lower case; whatever else lies between two words is one space, as are the ends of a text.
    """
    held, rows, size = [], [], 0
    for row, text in enumerate(texts):
        text = (text or "").lower()
        for at in range(0, len(text), PIECE):
            part = text[at : at + PIECE]
            held.append(f"\n{part}\n")
            rows.append((row, len(part) + 2))
            size += len(part)
            if size >= PIECE:
                yield _hashes(held, rows)
                held, rows, size = [], [], 0
    if held:
        yield _hashes(held, rows)


def _hashes(held: list[str], rows: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer("".join(held).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat([r for r, _ in rows], [n for _, n in rows])
    letter = _letters()[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first sign after a word ends it
    keep[:-1] |= (codes[:-1] == 10) & letter[1:]  # and a text begins with one
    codes, row = np.where(letter, codes, 0)[keep].astype(np.uint64), row[keep]
    # one more space before each text, so that a word of one letter has an n-gram
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, int)
    codes, row = np.insert(codes, first, 0), np.insert(row, first, row[first])
    if len(codes) < N:
        return np.zeros(0, np.uint64), np.zeros(0, int)
    h = np.zeros(len(codes) - N + 1, np.uint64)
    for k in range(N):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[k : len(codes) - N + 1 + k] + np.uint64(1)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    same = row[: len(h)] == row[N - 1 :]
    return h[same], row[: len(h)][same]


class LanguageFilter:
    """languages, in order of their bits; masks: an unsigned word of bits a slot, more columns beyond 64 languages."""

    def __init__(self, languages: list[str], masks: np.ndarray):
        self.languages, self.masks = languages, masks
        self.false_positive = np.array([(masks[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)).mean() for i in range(len(languages))]) ** HASHES

    def _slots(self, h: np.ndarray) -> list[np.ndarray]:
        return [(h >> np.uint64(20 * i)) % np.uint64(len(self.masks)) for i in range(HASHES)]

    def shares(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """For each text the corrected share of its n-grams that each language holds, and whether it has any."""
        hits, total = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for h, row in pieces(texts):
            total += np.bincount(row, minlength=len(texts))
            found = np.bitwise_and.reduce([self.masks[s] for s in self._slots(h)])
            for i in range(len(self.languages)):
                has = found[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)
                hits[:, i] += np.bincount(row, has, minlength=len(texts))
        share = hits / np.maximum(total, 1)[:, None]
        return np.clip((share - self.false_positive) / np.maximum(1 - self.false_positive, 1e-9), 0, 1), total > 0


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", slots: int = 1 << 20, per_language: int = 20_000, least: float = 1e-7, near: float = 0.1) -> LanguageFilter:
    """Fits the filter to the rows of ``labelled`` whose text and lang are not null.

    Of a language with more rows than ``per_language``, about so many are taken, by a hash of the text: this bounds the
    sample, and ``slots`` the filter (8 bytes a slot for each 64 languages), whatever the corpus. An n-gram is of a
    language if it is ``least`` of the sample's n-grams there, so that of a language with little text each counts, and
    at least ``near`` times as often, in proportion, as in any other language. No rows give a filter without languages.
    ``slots`` is a power of two, 2^20 at most, as three places of a slot are taken from one hash.
    """
    if slots & (slots - 1) or not 0 < slots <= 1 << 20:
        raise ValueError("slots must be a power of two, 2^20 at most")
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter("text is not null and lang is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return LanguageFilter([], np.zeros((slots, 1), np.uint64))
    spark = rows.sparkSession
    bits = spark.createDataFrame([(k, i, min(1.0, per_language / counts[k])) for i, k in enumerate(languages)], "lang string, bit int, part double")
    sample = rows.join(F.broadcast(bits), "lang").filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < F.col("part") * (1 << 20)).select("text", "bit")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bit = batch["bit"].to_numpy()
            for h, row in pieces(list(batch["text"])):
                for i in np.unique(bit[row]):
                    grams, n = np.unique(h[bit[row] == i], return_counts=True)
                    yield pd.DataFrame({"gram": grams.view(np.int64), "bit": i, "n": n})

    grams = sample.mapInPandas(count, "gram long, bit int, n long").groupBy("gram", "bit").agg(F.sum("n").alias("n"))
    grams = Workspace(spark, "langid").write(grams, "grams")
    total = grams.groupBy("bit").agg(F.sum("n").alias("total"))
    shared = grams.join(F.broadcast(total), "bit").withColumn("rate", F.col("n") / F.col("total"))
    top = shared.groupBy("gram").agg(F.max("rate").alias("top"), F.collect_list(F.struct("bit", "rate")).alias("of"))
    own = top.select("gram", F.filter("of", lambda x: (x["rate"] >= least) & (x["rate"] >= near * F.col("top")))["bit"].alias("bits"))
    at = [F.pmod(F.shiftrightunsigned(F.col("gram"), 20 * i), F.lit(slots)) for i in range(HASHES)]
    placed = own.select(F.explode("bits").alias("bit"), F.array(*at).alias("at"))
    placed = placed.select("bit", F.explode("at").alias("slot"))
    word = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit") % 64))
    found = placed.groupBy("slot", F.floor(F.col("bit") / 64).cast("int").alias("word")).agg(word.alias("mask")).toPandas()  # at most a row a slot and word
    masks = np.zeros((slots, (len(languages) + 63) // 64), np.uint64)
    masks[found["slot"].to_numpy(int), found["word"].to_numpy(int)] = found["mask"].to_numpy(np.int64).view(np.uint64)
    return LanguageFilter(languages, masks)


PREDICTION = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])


def predict(docs: DataFrame, model: LanguageFilter, text: str = "text", out: str = "language") -> DataFrame:
    """Adds ``out``, struct<lang, score>, to every row: the language with the largest share, and that share.

    Of equal shares the first language by name wins; a text in no learned language has it too, with a score of 0 or
    little more, so that a least score tells those apart. A text that is null or has no letter is 'und' with score 0, as is
    any text if the model has no language. Whole texts are read; repeated rows get the same answer. The filter, of a
    fixed size, is sent to the executors once. A column named ``out`` is replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(PREDICTION)
    def language(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for texts in batches:
            share, any_ = m.shares(list(texts))
            if not m.languages:
                share, any_ = np.zeros((len(texts), 1)), np.zeros(len(texts), bool)
            best = share.argmax(1)
            names = np.array([*m.languages, UNDETERMINED], object)
            yield pd.DataFrame({"lang": names[np.where(any_, best, len(m.languages))], "score": np.where(any_, share.max(1), 0.0)})

    return docs.withColumn(out, language.asNondeterministic()(F.col(text)))  # else a filter on it would run it twice
