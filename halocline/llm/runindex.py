"""Exact removal of long repeated byte strings by run-length indexes of a repetitive corpus.

Every string of ``length`` bytes has an anchor: the 32 bytes in it whose hash is least, the first of equal ones. Strings
that are equal have equal anchors at equal places, so they meet if text goes by its anchor. Neighbouring strings mostly
share one; the text that they cover together is a piece. Texts are put in order and packed in blocks. A block sends a
hash of every different piece, and learns which pieces another block has before it (all strings in them repeat) and
which stand alone under their anchor. Only the others, alike but not equal, are sent as text.

There a run-length index decides: the suffixes of the pieces are sorted, their Burrows-Wheeler transform is kept as runs,
and each run's ends are sampled: where they stand, and how long the suffixes at a border agree. Streaming the samples
along the text gives, for every position, its predecessor among the sorted suffixes and the length of their match: both
move on by one from position to position until the next sample. Matches of ``length`` bytes or more chain equal strings
together, and all but the earliest are marked. Few runs describe pieces that repeat each other.

An anchor that stands in too many different pieces would fill an index: their strings go one by one, by hashes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halocline.llm.hashing import _powers, mix
from halocline.llm.workspace import Workspace

GRAM = 32  # bytes of an anchor; of strings under 96 bytes, a third
STRIDE = 1 << 16  # strings that are looked at at once
BLOCKS = 1 << 24  # blocks that one partition may number
OTHER = np.uint64(0xD6E8FEB86659FD93)
PLACE = np.uint64((1 << 17) - 1)  # bits of a hash that give way to the place, so that the first of equal ones is least
#: What a piece turns out to be: alone (or the first of equal ones, with no other of its anchor), repeated, alike, crowded.
REPEATED, ALIKE, CROWDED = 1, 2, 3


class Pieces(NamedTuple):
    """By piece, in order: where its strings start, how many there are, hashes of the anchor and of all its bytes."""

    start: np.ndarray
    n: np.ndarray
    key: np.ndarray
    digest: np.ndarray


def _inside(ends: np.ndarray, size: int, length: int) -> np.ndarray:
    """Which positions start a string that ends within its document."""
    starts = np.r_[0, ends[:-1]]
    step = np.zeros(size + 1, np.int8)
    late = np.maximum(starts, ends - length + 1)
    np.add.at(step, late, 1)
    np.add.at(step, ends, -1)
    return np.cumsum(step[:-1], dtype=np.int8) == 0


def _sums(b: np.ndarray, powers: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * powers[: len(b)], out=sums[1:])
    return sums


def pieces(b: np.ndarray, ends: np.ndarray, length: int) -> Pieces:
    """The pieces of concatenated documents that end at ``ends``."""
    found: list[tuple[np.ndarray, ...]] = []
    inside = _inside(ends, len(b), length)
    powers, inverses = _powers(2 * STRIDE)
    gram = min(GRAM, max(1, length // 3))
    grams = length - gram + 1
    for at in range(0, len(b) - length + 1, STRIDE):
        count = min(STRIDE, len(b) - length + 1 - at)
        ok = inside[at : at + count]
        if not ok.any():
            continue
        sums = _sums(b[at : at + count + length - 1], powers)
        hashes = mix((sums[gram:] - sums[:-gram]) * inverses[: len(sums) - gram])
        least, width = (hashes & ~PLACE) | np.arange(len(hashes), dtype=np.uint64), 1
        while 2 * width <= grams:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if grams > width:
            least = np.minimum(least[: width - grams], least[grams - width :])
        anchor = (least & PLACE).astype(np.int64)
        edges = np.flatnonzero((anchor[1:] != anchor[:-1]) | (ok[1:] != ok[:-1])) + 1
        lo, hi = np.r_[0, edges], np.r_[edges, count]
        lo, hi = lo[ok[lo]], hi[ok[lo]]
        whole = (sums[hi + length - 1] - sums[lo]) * inverses[lo]
        found.append((at + lo, hi - lo, mix(hashes[anchor[lo]] ^ OTHER), mix(whole + (hi - lo).astype(np.uint64) * OTHER)))
    if not found:
        none = np.zeros(0, np.uint64)
        return Pieces(none.astype(np.int64), none.astype(np.int64), none, none)
    return Pieces(*(np.concatenate(x) for x in zip(*found, strict=True)))


def strings(b: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the string at each of ``starts``, in order."""
    powers, inverses = _powers(2 * STRIDE)
    out = np.zeros(len(starts), np.uint64)
    for at in range(0, len(b), STRIDE):
        lo, hi = np.searchsorted(starts, (at, at + STRIDE))
        if hi > lo:
            here = starts[lo:hi] - at
            sums = _sums(b[at : at + STRIDE + length], powers)
            out[lo:hi] = (sums[here + length] - sums[here]) * inverses[here]
    return mix(out ^ OTHER), mix(out + OTHER)


class Different(NamedTuple):
    """Pairs of hashes without repeats, sorted: which rows are their first, and the number of each row's pair."""

    key: np.ndarray
    digest: np.ndarray
    first: np.ndarray
    number: np.ndarray


def different(key: np.ndarray, digest: np.ndarray) -> Different:
    order = np.lexsort((digest, key))
    k, d = key[order], digest[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
    number = np.zeros(len(k), np.int64)
    number[order] = np.cumsum(new) - 1
    return Different(k[new], d[new], order[new], number)


def shares(key: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's part of sorted keys begins; and the end."""
    return np.searchsorted(key >> np.uint64(32), (np.arange(buckets + 1, dtype=np.float64) * 2.0**32 / buckets).astype(np.uint64))


def judge(key: np.ndarray, digest: np.ndarray, crowd: int) -> np.ndarray:
    """A code for each row; rows are in order, the earlier first."""
    order = np.lexsort((digest, key))
    k, d = key[order], digest[order]
    new_key = np.ones(len(k), bool)
    new_key[1:] = k[1:] != k[:-1]
    new = new_key.copy()
    new[1:] |= d[1:] != d[:-1]
    kinds = np.add.reduceat(new.astype(np.int64), np.flatnonzero(new_key)) if len(k) else np.zeros(0, np.int64)
    kinds = kinds[np.cumsum(new_key) - 1] if len(k) else kinds
    code = np.zeros(len(k), np.uint8)
    code[order] = np.where(~new, REPEATED, np.where(kinds == 1, 0, np.where(kinds <= crowd, ALIKE, CROWDED)))
    return code


class RunIndex:
    """The Burrows-Wheeler transform of pieces, as runs with samples at their ends.

    Every piece ends with a mark of its own, less than all bytes and than those of later pieces. ``start`` are the
    positions of suffixes at the starts of runs, in text order; ``before`` the suffix that ends the run before, -1 for
    the first of all, and ``agree`` how many bytes the two share.
    """

    def __init__(self, text: np.ndarray, sizes: np.ndarray):
        n = self.n = len(text)
        ends = np.cumsum(sizes)
        left = np.repeat(ends, sizes) - np.arange(n)  # bytes to the piece's end
        self.left = left
        packed = np.zeros(n, np.uint64)
        padded = np.r_[text, np.zeros(8, np.uint8)]
        for i in range(8):
            packed = (packed << np.uint64(8)) | np.where(left > i, padded[i : i + n], 0).astype(np.uint64)
        ranks, width = {8: self._rank(packed)}, 8
        while width < sizes.max(initial=0):
            rank = ranks[width]
            after = np.zeros(n, np.uint64)
            on = np.flatnonzero(left > width)
            after[on] = rank[on + width]
            ranks[2 * width] = self._rank((rank.astype(np.uint64) << np.uint64(32)) | after)
            width *= 2
        # suffixes that only their marks tell apart: the shorter first, then the earlier
        suffixes = np.argsort((ranks[width].astype(np.uint64) << np.uint64(32)) | left.astype(np.uint64), kind="stable")
        starts = np.zeros(n, bool)
        starts[ends - sizes] = True
        last = np.where(starts[suffixes], -1, text[suffixes - 1].astype(np.int64))  # the transform
        run = np.ones(n, bool)
        run[1:] = (last[1:] != last[:-1]) | (last[1:] < 0)
        at = np.flatnonzero(run)
        self.symbols, self.runs = last[at], np.diff(np.r_[at, n])
        start, before = suffixes[at], np.where(at > 0, suffixes[at - 1], -1)
        agree = np.where(at > 0, self._agree(start, np.maximum(before, 0), ranks, packed), 0)
        order = np.argsort(start)
        self.start, self.before, self.agree = start[order], before[order], agree[order]

    @staticmethod
    def _rank(key: np.ndarray) -> np.ndarray:
        order = np.argsort(key)
        key = key[order]
        rank = np.empty(len(key), np.uint32)
        rank[order] = np.cumsum(np.r_[True, key[1:] != key[:-1]]) if len(key) else 0
        return rank

    def _agree(self, a: np.ndarray, b: np.ndarray, ranks: dict[int, np.ndarray], packed: np.ndarray) -> np.ndarray:
        size, most = np.zeros(len(a), np.int64), np.minimum(self.left[a], self.left[b])
        for width in sorted(ranks, reverse=True):
            go = np.flatnonzero(size < most)
            same = ranks[width][a[go] + size[go]] == ranks[width][b[go] + size[go]]
            size[go[same]] += width
        go = np.flatnonzero(size < most)
        differ = packed[a[go] + size[go]] ^ packed[b[go] + size[go]]
        size[go] += sum((differ >> np.uint64(8 * k)) == 0 for k in range(7, -1, -1))
        return np.minimum(size, most)

    def statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """By position: the suffix before its own among the sorted ones (-1: none), and how many bytes they share."""
        of = np.repeat(np.arange(len(self.start)), np.diff(np.r_[self.start, self.n]))
        on = np.arange(self.n) - self.start[of]
        before = self.before[of]
        return np.where(before < 0, -1, before + on), np.where(before < 0, 0, self.agree[of] - on)


def repeats(text: np.ndarray, sizes: np.ndarray, length: int) -> np.ndarray:
    """Of every string of ``length`` bytes of every piece, in order: whether it also starts earlier."""
    index = RunIndex(text, sizes)
    before, match = index.statistics()
    root = np.arange(index.n)
    chained = np.flatnonzero(match >= length)
    root[chained] = before[chained]
    while True:
        up = root[root[chained]]
        if (up == root[chained]).all():
            break
        root[chained] = up
    lowest = np.arange(index.n)
    np.minimum.at(lowest, root[chained], chained)
    return (lowest[root] < np.arange(index.n))[index.left >= length]


def _spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... n of them, of every row."""
    return np.repeat(start - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)


class _Block:
    """What a block works out from its texts, the same in every step."""

    def __init__(self, row: dict, length: int):
        self.b = np.frombuffer(row["body"], np.uint8)
        self.ends = np.asarray(row["ends"], np.int64)
        self.length = length
        self.pieces = pieces(self.b, self.ends, length)
        self.of = different(self.pieces.key, self.pieces.digest)

    def told(self, answers: dict[tuple[int, int], bytes], buckets: int) -> np.ndarray:
        """The code of every different piece."""
        code, at = np.zeros(len(self.of.key), np.uint8), shares(self.of.key, buckets)
        for i in range(buckets):
            if (0, i) in answers:
                code[at[i] : at[i + 1]] = np.frombuffer(answers[0, i], np.uint8)
        return code

    def alike(self, code: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
        """(bucket, first occurrences of the alike pieces that go to it, in order)."""
        at = shares(self.of.key, buckets)
        for i in range(buckets):
            of = self.of.first[at[i] : at[i + 1]][code[at[i] : at[i + 1]] == ALIKE]
            if len(of):
                yield i, np.sort(of)

    def crowded(self, code: np.ndarray) -> tuple[np.ndarray, Different]:
        """The strings of crowded pieces, one by one: where they start, and their hashes without repeats."""
        first = np.sort(self.of.first[code == CROWDED])
        starts = _spread(self.pieces.start[first], self.pieces.n[first])
        return starts, different(*strings(self.b, starts, self.length))


def _answers(table: pa.Table) -> dict[tuple[int, int], bytes]:
    return {(k, i): c for k, i, c in zip(table.column("kind").to_pylist(), table.column("bucket").to_pylist(), table.column("codes").to_pylist(), strict=True)}


def remove_repeats(docs: DataFrame, length: int = 100, block_bytes: int = 1 << 23, bucket_bytes: int = 1 << 24, index_bytes: int = 1 << 20,
                   crowd: int = 4096, doc_id: str = "doc_id", text: str = "text", out_text: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with ``out_text``, the bytes kept.

    Removed is each byte of the UTF-8 text that is covered by a string of ``length`` bytes which also starts earlier: in a
    smaller doc_id (null last; of equal ids the smaller hash of the text, and of repeated rows one, is earlier) or
    earlier in the same document. Strings are judged on the input and never cross documents. n_spans: maximal removed
    runs. Null texts are empty; texts that are shorter than ``length`` lose nothing. An empty table gives no rows. A text
    of any length is read whole, in one block. Pieces and strings are told apart by 128 bits of hashes, those in an index
    byte by byte.

    ``crowd``: different pieces of one anchor that an index takes; the strings of more are compared by hashes.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "repeats")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("tie").asc()]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text", F.spark_partition_id().alias("part"))
    id_type = rows.schema["doc_id"].dataType
    schema = f"block long, doc_ids array<{id_type.simpleString()}>, ends array<long>, size long, body binary"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size, block = [], [], 0, None

        def packed() -> pa.RecordBatch:
            kind = pa.list_(ids[0].type) if ids else None
            chunk = pa.concat_arrays(ids)
            return pa.record_batch({
                "block": pa.array([block], pa.int64()), "doc_ids": pa.ListArray.from_arrays(pa.array([0, len(chunk)], pa.int32()), chunk).cast(kind),
                "ends": pa.array([np.cumsum([len(t) for t in texts])], pa.list_(pa.int64())), "size": pa.array([size], pa.int64()), "body": pa.array([b"".join(texts)], pa.binary()),
            })

        for batch in batches:
            if batch.num_rows and block is None:
                block = batch.column("part")[0].as_py() * BLOCKS
            begun = 0
            for i, t in enumerate(batch.column("text")):
                texts.append(t.as_py())
                size += len(texts[-1])
                if size >= block_bytes:
                    ids.append(batch.column("doc_id").slice(begun, i + 1 - begun))
                    yield packed()
                    ids, texts, size, block, begun = [], [], 0, block + 1, i + 1
            if begun < batch.num_rows:
                ids.append(batch.column("doc_id").slice(begun))
        if texts:
            yield packed()

    blocks = work.write(dealt.mapInArrow(pack, schema), "blocks")
    total = blocks.agg(F.sum("size")).first()[0] or 0
    buckets = max(1, math.ceil(total / bucket_bytes))
    asked_schema = "kind int, bucket int, block long, a binary, b binary"

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = _Block(row, length)
                at = shares(own.of.key, buckets)
                sent = [(0, i, row["block"], own.of.key[at[i] : at[i + 1]].tobytes(), own.of.digest[at[i] : at[i + 1]].tobytes()) for i in range(buckets) if at[i] < at[i + 1]]
                yield _messages(sent)

    def answer(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("block", kind="stable")
        kind = int(part["kind"].iloc[0])
        if kind == ALIKE:
            sizes = [np.frombuffer(a, np.int32) for a in part["a"]]
            bits = repeats(np.frombuffer(b"".join(part["b"]), np.uint8), np.concatenate(sizes), length)
            counts = [int((s - length + 1).sum()) for s in sizes]
            codes = [np.packbits(x).tobytes() for x in np.split(bits, np.cumsum(counts)[:-1])]
        else:
            keys = [np.frombuffer(a, np.uint64) for a in part["a"]]
            code = judge(np.concatenate(keys), np.concatenate([np.frombuffer(b, np.uint64) for b in part["b"]]), crowd if kind == 0 else 0)
            codes = [x.tobytes() for x in np.split(code, np.cumsum([len(k) for k in keys])[:-1])]
        alike = [c.count(bytes([ALIKE])) if kind == 0 else 0 for c in codes]
        return pd.DataFrame({"block": part["block"], "kind": kind, "bucket": part["bucket"], "codes": codes, "alike": alike})

    answer_schema = "block long, kind int, bucket int, codes binary, alike long"
    asked = blocks.select("block", "ends", "body").mapInArrow(ask, asked_schema)
    first = work.write(asked.groupBy("kind", "bucket").applyInPandas(answer, answer_schema), "answers")
    alike = first.agg(F.sum("alike")).first()[0] or 0
    indexes = max(1, math.ceil(alike * (length + length // 3) / index_bytes))

    def ask_again(rows: pa.Table, told: pa.Table) -> pa.Table:
        sent = []
        for row in _once(rows):
            own = _Block(row, length)
            code = own.told(_answers(told), buckets)
            for i, of in own.alike(code, indexes):
                sizes = own.pieces.n[of] + length - 1
                sent.append((ALIKE, i, row["block"], sizes.astype(np.int32).tobytes(), own.b[_spread(own.pieces.start[of], sizes)].tobytes()))
            _, crowded = own.crowded(code)
            at = shares(crowded.key, buckets)
            sent += [(CROWDED, i, row["block"], crowded.key[at[i] : at[i + 1]].tobytes(), crowded.digest[at[i] : at[i + 1]].tobytes()) for i in range(buckets) if at[i] < at[i + 1]]
        return pa.Table.from_batches([_messages(sent)])

    again = blocks.select("block", "ends", "body").groupBy("block").cogroup(first.drop("alike").groupBy("block")).applyInArrow(ask_again, asked_schema)
    second = work.write(again.groupBy("kind", "bucket").applyInPandas(answer, answer_schema), "answers2")
    told = work.write(first.unionByName(second).drop("alike"), "told")
    work.keep("blocks", "told")
    result = rows.select("doc_id").schema
    for name, kind in (("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept_sha256", "string")):
        result = result.add(name, kind)
    if out_text:
        result = result.add(out_text, "binary")

    def remove(rows: pa.Table, told: pa.Table) -> pa.Table:
        found: dict[str, list] = {f.name: [] for f in result.fields[1:]}
        ids = []
        for row, doc_ids in zip(_once(rows), [c for c in rows.column("doc_ids").chunks if len(c)], strict=False):
            own = _Block(row, length)
            lo, hi = _removed(own, _answers(told), buckets, indexes)
            ids.append(doc_ids.flatten())
            body, ends = memoryview(row["body"]), own.ends
            starts = np.r_[0, ends[:-1]]
            a, z = np.searchsorted(lo, starts), np.searchsorted(lo, ends)
            for s, e, i, j in zip(starts.tolist(), ends.tolist(), a.tolist(), z.tolist(), strict=True):
                cuts = [s, *[x for p in zip(lo[i:j].tolist(), hi[i:j].tolist(), strict=True) for x in p], e] if i < j else [s, e]
                kept = [body[p:q] for p, q in zip(cuts[::2], cuts[1::2], strict=True)]
                digest = hashlib.sha256()
                for k in kept:
                    digest.update(k)
                found["n_bytes"].append(e - s)
                found["n_removed"].append(e - s - sum(map(len, kept)))
                found["n_spans"].append(j - i)
                found["kept_sha256"].append(digest.hexdigest())
                if out_text:
                    found[out_text].append(b"".join(kept))
        types = {f.name: pa.binary() if f.name == out_text else pa.string() if f.name == "kept_sha256" else pa.int64() for f in result.fields[1:]}
        columns = {n: pa.array(v, types[n]) for n, v in found.items()}
        return pa.table({"doc_id": pa.chunked_array(ids), **columns})

    return blocks.drop("size").groupBy("block").cogroup(told.groupBy("block")).applyInArrow(remove, result)


def _once(rows: pa.Table) -> list[dict]:
    """The row of a block."""
    return rows.to_pylist()[:1]


def _messages(sent: list[tuple]) -> pa.RecordBatch:
    kind, bucket, block, a, b = zip(*sent, strict=True) if sent else ((),) * 5
    return pa.record_batch({"kind": pa.array(kind, pa.int32()), "bucket": pa.array(bucket, pa.int32()), "block": pa.array(block, pa.int64()), "a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})


def _removed(own: _Block, answers: dict[tuple[int, int], bytes], buckets: int, indexes: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the removed runs of a block, none across documents."""
    code = own.told(answers, buckets)
    p, length = own.pieces, own.length
    step = np.zeros(len(own.b) + 1, np.int8)
    later = np.ones(len(p.start), bool)
    later[own.of.first] = False
    whole = later | (code[own.of.number] == REPEATED)
    np.add.at(step, p.start[whole], 1)
    np.add.at(step, p.start[whole] + p.n[whole], -1)
    marked = np.cumsum(step[:-1], dtype=np.int8) > 0
    for i, of in own.alike(code, indexes):
        starts = _spread(p.start[of], p.n[of])
        marked[starts] = np.unpackbits(np.frombuffer(answers[ALIKE, i], np.uint8), count=len(starts)).astype(bool)
    starts, crowded = own.crowded(code)
    if len(starts):
        at, told = shares(crowded.key, buckets), np.zeros(len(crowded.key), np.uint8)
        for i in range(buckets):
            if (CROWDED, i) in answers:
                told[at[i] : at[i + 1]] = np.frombuffer(answers[CROWDED, i], np.uint8)
        later = np.ones(len(starts), bool)
        later[crowded.first] = False
        marked[starts] = later | (told[crowded.number] == REPEATED)
    edges = np.flatnonzero(np.diff(np.r_[False, marked, False].astype(np.int8)))
    lo, hi = edges[::2], edges[1::2] + length - 1
    document = np.searchsorted(own.ends, lo, side="right")
    new = np.ones(len(lo), bool)
    new[1:] = (lo[1:] > hi[:-1]) | (document[1:] != document[:-1])
    at = np.flatnonzero(new)
    return lo[at], np.maximum.reduceat(hi, at) if len(at) else hi
