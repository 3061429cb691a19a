"""Benchmark decontamination by latent semantic retrieval.

Texts are cut into overlapping passages, vectors of the benchmark's words weighted by tf-idf (other words cannot match
an item). A randomised SVD of all passages, the benchmark's among them, gives latent axes: every task multiplies its
passages with a small random matrix, only sums of the size words x axes are gathered. Passages whose latent vector is
near an item's are candidates, and for short items, which a passage dilutes, those that hold one of the item's rarest
words, so many that no match can be without them all; of these the longest common subsequence with the item decides,
in whole words, together with a check for the item's answer when the text is a paraphrase.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halocline.llm.workspace import Workspace

NONE = np.zeros(0, int)
STRIDE = 20  # words; a passage has twice as many, and every word is in two passages
SHORT = 15  # words; items of so many or fewer are looked up by word as well
ITEMS = 4096  # items that are compared at once
SLICE = 1 << 17  # vocabulary words whose passages are made at once, so that their vectors stay in a core's cache
#: Bytes of a text to tokens: A-Z in lower case, other ASCII but letters and digits are breaks.
TOKEN_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def tokenize(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(TOKEN_BYTES).split()


@dataclass
class Items:
    """A block of the benchmark, short items first: numbers of the words (1 and up) of each, and where its answer starts."""

    ids: list
    words: list[np.ndarray]
    answers: list[int]
    vocabulary: dict[bytes, int]


def read_items(rows: list, answer: str | None) -> Items:
    vocabulary: dict[bytes, int] = {}
    ids, words, answers = [], [], []
    for r in rows:
        tokens = tokenize(r["text"])
        if answer:
            start, tokens = len(tokens), tokens + tokenize(r["answer"])
        else:  # the last sentence stands for the answer, the last fifth if there is but one
            last = len(tokenize((r["text"] or "").rstrip().rstrip(".!?").rpartition(". ")[2]))
            start = len(tokens) - (last if last < len(tokens) else max(1, len(tokens) // 5))
        if tokens:
            ids.append(r["item_id"])
            words.append(np.array([vocabulary.setdefault(t, len(vocabulary) + 1) for t in tokens]))
            answers.append(start)
    order = sorted(range(len(ids)), key=lambda i: len(words[i]))
    return Items([ids[i] for i in order], [words[i] for i in order], [answers[i] for i in order], vocabulary)


def encode(texts: list[str | None], vocabulary: dict[bytes, int]) -> tuple[list[int], list[np.ndarray], list[np.ndarray]]:
    """Of each text the number of words, and of those in the vocabulary the places and numbers."""
    sizes, places, numbers = [], [], []
    for text in texts:
        tokens = tokenize(text)
        found = np.fromiter(map(vocabulary.get, tokens, itertools.repeat(0)), np.int32, len(tokens))
        at = np.flatnonzero(found)
        sizes.append(len(tokens))
        places.append(at.astype(np.int32))
        numbers.append(found[at])
    return sizes, places, numbers


@dataclass
class Passages:
    """Passages of some texts. cells: STRIDE words each, 0 where a word is none of the vocabulary; a passage is a cell
    and the next one of its text, if there is one."""

    cells: np.ndarray
    text: np.ndarray  # of each passage
    first: np.ndarray  # its first cell
    last: np.ndarray  # its last cell, the same if a text has but one
    number: np.ndarray  # its first cell, counted within the text

    def words(self) -> np.ndarray:
        """The passages' words, sorted within each."""
        both = np.concatenate([self.cells[self.first], np.where((self.first == self.last)[:, None], 0, self.cells[self.last])], axis=1)
        both.sort(axis=1)
        return both

    def norms(self, idf: np.ndarray) -> np.ndarray:
        """Lengths of the tf-idf vectors; 1 for passages without words."""
        words = self.words()
        n, width = words.shape
        flat = words.ravel()
        fresh = np.ones((n, width), bool)
        fresh[:, 1:] = words[:, 1:] != words[:, :-1]
        run = np.flatnonzero(fresh)
        tf = np.diff(np.r_[run, n * width])
        total = np.bincount(run // width, (idf[flat[run]] * tf) ** 2, n)
        return np.sqrt(np.where(total > 0, total, 1))

    def times(self, weighted: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """Passage vectors of unit length times a matrix, given idf times the matrix."""
        by_cell = np.zeros((len(self.cells), weighted.shape[1]), np.float32)
        for k in range(STRIDE):
            by_cell += weighted[self.cells[:, k]]
        out = by_cell[self.first]
        two = self.first != self.last
        out[two] += by_cell[self.last[two]]
        return out / norms[:, None].astype(np.float32)

    def transposed_times(self, rows: np.ndarray, norms: np.ndarray, idf: np.ndarray) -> np.ndarray:
        """For each word the sum over passages of its weight there times the passage's row."""
        rows = rows / norms[:, None]
        by_cell = np.zeros((rows.shape[1], len(self.cells)))
        by_cell[:, self.first] = rows.T
        two = self.first != self.last
        by_cell[:, self.last[two]] += rows[two].T  # a cell is first of one passage and last of one
        cell, column = np.nonzero(self.cells)
        word = self.cells[cell, column]
        return np.stack([np.bincount(word, line[cell], len(idf)) for line in by_cell], axis=1) * idf[:, None]


def passages(sizes: list[int], places: list[np.ndarray], numbers: list[np.ndarray]) -> Passages:
    count = np.maximum(1, -(-np.asarray(sizes, int) // STRIDE))
    base = np.r_[0, np.cumsum(count)]
    text = np.repeat(np.arange(len(places)), [len(p) for p in places])
    cells = np.zeros((base[-1], STRIDE), np.int32)
    if len(text):
        place = np.concatenate(places)
        cells[base[text] + place // STRIDE, place % STRIDE] = np.concatenate(numbers)
    n = np.maximum(1, count - 1)
    text = np.repeat(np.arange(len(places)), n)
    number = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    first = base[text] + number
    return Passages(cells, text, first, np.minimum(first + 1, base[text + 1] - 1), number)


def item_vectors(items: Items, idf: np.ndarray) -> Iterator[np.ndarray]:
    """tf-idf vectors of unit length, some items at a time."""
    for at in range(0, len(items.words), 256):
        some = np.array([np.bincount(w, minlength=len(idf)) * idf for w in items.words[at : at + 256]])
        yield some / np.maximum(np.linalg.norm(some, axis=1), 1e-12)[:, None]


def _slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        total = np.cumsum([len(p) for p in batch["places"]]) // SLICE
        for _, part in batch.groupby(total, sort=False):
            yield part


def lcs(item: np.ndarray, region: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel over the item."""
    masks: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    v = full
    for w in region:
        if m := masks.get(w):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(item) - v.bit_count()


def coverage(p: Passages, i: np.ndarray, j: np.ndarray, words: np.ndarray, n_words: int) -> np.ndarray:
    """For candidate pairs (passage i, item j) the share of the item's words that the passage has, or the text an item's
    length around it: no common subsequence is longer. words: a row an item, 0 beyond its end; i is sorted."""
    around = -(-words.shape[1] // STRIDE)
    out = np.zeros(len(i))
    cell_text = np.zeros(len(p.cells), int)
    cell_text[p.first] = p.text
    cell_text[p.last] = p.text
    step = max(1, (1 << 24) // n_words)
    which, row = np.unique(i, return_inverse=True)
    for at in range(0, len(which), step):
        some = which[at : at + step]
        has = np.zeros((len(some), n_words), bool)
        for d in range(-around, around + 2):
            cell = p.first[some] + d
            inside = (cell >= 0) & (cell < len(p.cells))
            inside[inside] = cell_text[cell[inside]] == p.text[some[inside]]
            has[np.flatnonzero(inside)[:, None], p.cells[cell[inside]]] = True
        has[:, 0] = False
        a, b = np.searchsorted(row, [at, at + len(some)])
        mine = words[j[a:b]]
        out[a:b] = has[(row[a:b] - at)[:, None], mine].sum(1) / np.maximum(1, (mine > 0).sum(1))
    return out


def rare_words(items: Items, idf: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(word, item) of the short items, sorted by word: of each so many of its rarest words that a common subsequence
    of ``least`` of the item has one of them."""
    pairs = []
    for j, words in enumerate(items.words):
        if len(words) > SHORT:
            break
        many = len(words) - math.ceil(least * len(words) - 1e-9) + 1
        pairs += [(int(w), j) for w in words[np.argsort(-idf[words], kind="stable")[:many]]]
    pairs = np.array(sorted(set(pairs)), int).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def with_words(p: Passages, word: np.ndarray, item: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(passage, item) pairs of which the passage, or its neighbour in the text, has a word of the item's, given as
    rare_words: a match reaches SHORT words beyond a passage at most, into the next cell."""
    wanted = np.zeros(n_words, bool)
    wanted[word] = True
    wanted[0] = False
    words = p.words()
    i, k = np.nonzero(wanted[words])
    lo, hi = np.searchsorted(word, words[i, k]), np.searchsorted(word, words[i, k], side="right")
    at = np.repeat(lo, hi - lo) + np.arange((hi - lo).sum()) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
    i, j = np.repeat(i, hi - lo), item[at]
    before, after = i > 0, i + 1 < len(p.text)
    before[before] = p.text[i[before] - 1] == p.text[i[before]]
    after[after] = p.text[i[after] + 1] == p.text[i[after]]
    return np.concatenate([i, i[before] - 1, i[after] + 1]), np.concatenate([j, j[before], j[after]])


def judge(item: np.ndarray, answer: int, places: np.ndarray, numbers: np.ndarray, begin: int, end: int) -> tuple[float, float]:
    """Shares of the item, and of its answer, that stand in order among the words of [begin, end) and an item's length around."""
    a, b = np.searchsorted(places, [begin - len(item), end + len(item)])
    region = numbers[a:b].tolist()
    return lcs(item, region) / len(item), lcs(item[answer:], region) / max(1, len(item) - answer)


def find_leaks(docs: DataFrame, benchmark: DataFrame, axes: int = 64, iterations: int = 1, near: float = 0.5, verbatim: float = 0.75, paraphrase: float = 0.55, answered: float = 0.8,
               items_per_pass: int = 50_000, seed: int = 0, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
               answer: str | None = None) -> DataFrame:
    """One row per row of ``docs`` and item of ``benchmark`` that it leaks: doc_id, text_key, item_id, cosine, lcs, answer, place.

    A row leaks an item if, around passages whose latent cosine with the item is ``near`` or more, the longest common
    subsequence has ``verbatim`` of the item's words, or ``paraphrase`` of them and ``answered`` of its answer (column
    ``answer``; without one, its last sentence). Around an item of SHORT words or fewer all passages that may hold
    enough of it are judged. place: the first word of the passage that says so best, of equal ones the first. text_key:
    md5 of the text. Null and wordless texts and items match nothing; repeated rows of ``docs`` are each found,
    repeated rows of the benchmark count once. Other columns are left out; empty tables give no rows. All texts are
    searched whole, against all items, in one pass over the corpus for each ``items_per_pass`` items, which bounds what
    is sent to the tasks. Words that no item has are no axes of the passages: they match nothing.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "latent")
    numbered = benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"), *([F.col(answer).alias("answer")] if answer else [])).distinct()
    passes = max(1, -(-numbered.count() // items_per_pass))
    source = docs.select(F.col(doc_id).alias("doc_id"), F.unhex(F.md5(F.col(text).cast("binary"))).alias("text_key"), F.col(text).alias("text"))
    ids = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, text_key binary"
    result = None
    for b in range(passes):
        mine = numbered.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == b) if passes > 1 else numbered
        items = read_items(sorted(mine.collect(), key=str), answer)
        found = _search(source, items, ids, numbered.schema["item_id"].dataType.simpleString(), axes, iterations, near, (verbatim, paraphrase, answered), seed, work, b)
        result = found if result is None else result.unionByName(found)
    return result


def _search(source: DataFrame, items: Items, ids: str, item_type: str, axes: int, iterations: int, near: float, least: tuple[float, float, float], seed: int, work: Workspace, number: int) -> DataFrame:
    spark = source.sparkSession
    out = f"{ids}, item_id {item_type}, cosine double, lcs double, answer double, place long"
    if not items.ids:
        return spark.createDataFrame([], out)
    sent, n_words = spark.sparkContext.broadcast(items.vocabulary), len(items.vocabulary) + 1

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes, places, numbers = encode(list(batch["text"]), sent.value)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text_key": batch["text_key"], "size": sizes, "places": places, "numbers": numbers})

    coded = work.write(source.mapInPandas(read, f"{ids}, size int, places array<int>, numbers array<int>"), f"coded{number}")
    matrix = coded.select("size", "places", "numbers")

    def seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _slices(batches):
            words = passages(part["size"], list(part["places"]), list(part["numbers"])).words()
            fresh = np.c_[np.ones(len(words), bool), words[:, 1:] != words[:, :-1]]
            n = np.bincount(words[fresh], minlength=n_words)
            n[0] = len(words)  # all passages
            at = np.flatnonzero(n)
            yield pd.DataFrame({"word": at, "n": n[at]})

    counts = {r["word"]: r["n"] for r in matrix.mapInPandas(seen, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}  # a row a word
    df = np.array([counts.get(i, 0) for i in range(n_words)], float)
    idf = np.log((1 + df[0]) / (1 + df))
    idf[0] = 0
    share = df[0] / len(items.ids)  # so that the items weigh as much as all other passages

    axes = min(axes, n_words - 1)
    basis = np.random.default_rng(seed).standard_normal((n_words, axes))
    columns = [f"c{i}" for i in range(axes)]
    for _ in range(iterations):  # of the power method on the passages' covariance
        basis = np.linalg.qr(basis)[0]
        sent_basis = spark.sparkContext.broadcast((idf, basis))

        def multiply(batches: Iterator[pd.DataFrame], sent_basis=sent_basis) -> Iterator[pd.DataFrame]:
            idf, basis = sent_basis.value
            weighted, total = (idf[:, None] * basis).astype(np.float32), np.zeros((n_words, axes))
            for part in _slices(batches):
                p = passages(part["size"], list(part["places"]), list(part["numbers"]))
                norms = p.norms(idf)
                total += p.transposed_times(p.times(weighted, norms), norms, idf)
            at = np.flatnonzero(total.any(1))
            yield pd.DataFrame(total[at], columns=columns).assign(word=at)

        sums = matrix.mapInPandas(multiply, ", ".join(f"{c} double" for c in columns) + ", word int").groupBy("word").agg(*[F.sum(c).alias(c) for c in columns]).toPandas()  # a row a word
        basis = share * sum(x.T @ (x @ basis) for x in item_vectors(items, idf))
        basis[sums["word"].to_numpy(int)] += sums[columns].to_numpy()
    basis = np.linalg.qr(basis)[0]
    latent = np.concatenate([x @ basis for x in item_vectors(items, idf)]).astype(np.float32)
    latent /= np.maximum(np.linalg.norm(latent, axis=1), 1e-12)[:, None]
    model = spark.sparkContext.broadcast((idf, basis, items, latent))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        idf, basis, items, latent = model.value
        verbatim, paraphrase, answered = least
        enough = min(verbatim, paraphrase)
        slices = []
        for begin in range(0, len(items.words), ITEMS):
            some = items.words[begin : begin + ITEMS]
            padded = np.zeros((len(some), len(some[-1])), np.int32)  # the last one is the longest
            for i, w in enumerate(some):
                padded[i, : len(w)] = w
            slices.append((begin, padded))
        rare, rare_of = rare_words(items, idf, enough)
        weighted, step = (idf[:, None] * basis).astype(np.float32), max(1, (1 << 24) // min(ITEMS, len(latent)))
        for part in _slices(batches):
            places, numbers = list(part["places"]), list(part["numbers"])
            p = passages(part["size"], places, numbers)
            at = p.times(weighted, p.norms(idf))
            at /= np.maximum(np.linalg.norm(at, axis=1), 1e-12)[:, None]
            short, short_of = with_words(p, rare, rare_of, n_words) if len(rare) else (NONE, NONE)
            best: dict[tuple[int, int], tuple] = {}
            for a, (begin, padded) in itertools.product(range(0, len(at), step), slices):
                cosine = at[a : a + step] @ latent[begin : begin + len(padded)].T
                near_ = cosine >= near
                here = (short >= a) & (short < a + len(near_)) & (short_of >= begin) & (short_of < begin + len(padded))
                near_[short[here] - a, short_of[here] - begin] = True
                i, j = np.nonzero(near_)
                likely = coverage(p, i + a, j, padded, n_words) >= enough
                for i, j in zip(i[likely], j[likely], strict=True):
                    t, w, k = int(p.text[a + i]), int(p.number[a + i]), int(begin + j)
                    share, has = judge(items.words[k], items.answers[k], places[t], numbers[t], w * STRIDE, (w + 2) * STRIDE)
                    if share >= verbatim or (share >= paraphrase and has >= answered):
                        now = (share, float(cosine[i, j]), -w, has)
                        best[t, k] = max(now, best.get((t, k), now))
            rows = [(*part.iloc[t][["doc_id", "text_key"]], items.ids[j], cos, share, has, -w * STRIDE) for (t, j), (share, cos, w, has) in best.items()]
            yield pd.DataFrame(rows, columns=["doc_id", "text_key", "item_id", "cosine", "lcs", "answer", "place"])

    return coded.mapInPandas(search, out)
