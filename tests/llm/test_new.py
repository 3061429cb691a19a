"""Run-length index, sort-means and prefix tries: against brute force and awkward rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from halocline.llm import clusters, runindex, tries
from tests.llm.conftest import MESSY


def repeats_by_hand(rows, length):
    """rows: (doc_id, bytes) in order."""
    seen, out = set(), []
    for i, b in rows:
        cut = bytearray(len(b))
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            if s in seen:
                cut[p : p + length] = b"\1" * length
            seen.add(s)
        spans = sum(1 for p in range(len(b)) if cut[p] and not (p and cut[p - 1]))
        out.append((i, len(b), sum(cut), spans, hashlib.sha256(bytes(x for x, c in zip(b, cut, strict=True) if not c)).hexdigest()))
    return out


def pieces_by_hand(pieces, length):
    seen, out = set(), []
    for piece in pieces:
        for p in range(len(piece) - length + 1):
            out.append(piece[p : p + length] in seen)
            seen.add(piece[p : p + length])
    return out


@pytest.mark.parametrize("seed", range(12))
def test_run_index_marks_what_starts_earlier(seed):
    rng = random.Random(seed)
    length = rng.choice([2, 3, 5, 9, 40])
    base = [bytes(rng.choice(b"ab\0") for _ in range(150)) for _ in range(3)]
    pieces = []
    for _ in range(rng.randint(1, 80)):
        at = rng.randrange(40)
        s = bytearray(rng.choice(base)[at : at + rng.randint(length, length + 60)])
        if rng.random() < 0.4:
            s[rng.randrange(len(s))] = rng.choice(b"ab\0\xff")
        pieces.append(bytes(s))
    text, sizes = np.frombuffer(b"".join(pieces), np.uint8), np.array([len(p) for p in pieces])
    assert runindex.repeats(text, sizes, length).tolist() == pieces_by_hand(pieces, length)


def test_run_index_is_a_run_length_transform():
    """Copies add no runs but those of their marks; the samples give every predecessor and match."""
    piece = bytes(random.Random(3).choice(b"abcd") for _ in range(120))
    pieces = [piece] * 30
    index = runindex.RunIndex(np.frombuffer(b"".join(pieces), np.uint8), np.full(30, 120))
    assert index.runs.sum() == index.n and len(index.runs) <= 120 + 30
    suffixes = sorted((piece[i:] + bytes(1), k, i) for k in range(30) for i in range(120))  # no zero byte within
    before, match = index.statistics()
    for (s, k, i), (r, j, h) in zip(suffixes[1:], suffixes, strict=False):
        shared = next((n for n, (x, y) in enumerate(zip(s[:-1], r[:-1], strict=False)) if x != y), min(len(s), len(r)) - 1)
        assert before[k * 120 + i] == j * 120 + h and match[k * 120 + i] == shared


def long_repeats(seed=0, n=60):
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abcdefgh é") for _ in range(rng.randint(60, 400))) for _ in range(12)]
    line = "a line of boilerplate that stands in most of the texts, whatever is around it"
    out = []
    for _ in range(n):
        own = "".join(rng.choice("ijklmnop ") for _ in range(rng.randint(0, 300)))
        p = rng.choice(passages)
        out.append(own[:100] + p[rng.randrange(40) :] + own[100:] + line + own[:7] + rng.choice(passages)[: rng.randint(80, 200)])
    return [*out, "x" * 500, "xy" * 300, "", None, passages[0][:99], "é" * 50, "é" * 50]


@pytest.mark.parametrize("options", [{}, {"block_bytes": 1500, "bucket_bytes": 5000, "index_bytes": 4000}, {"block_bytes": 1500, "bucket_bytes": 9000, "crowd": 3}, {"length": 40, "block_bytes": 4000, "crowd": 5}])
def test_removed_repeats(spark, options):
    texts = long_repeats()
    docs = spark.createDataFrame([(i * 3 - 40, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    got = sorted(tuple(r) for r in runindex.remove_repeats(docs, **options).collect())
    want = repeats_by_hand([(i * 3 - 40, (t or "").encode()) for i, t in enumerate(texts)], options.get("length", 100))
    assert got == want
    assert sum(r[2] for r in got) > 2000


def test_kept_bytes_and_a_long_text(spark):
    rng = random.Random(1)
    long = "".join(rng.choice("abc") for _ in range(200_000))
    docs = spark.createDataFrame([(1, long), (2, "z" + long[70_000:140_000] + "q"), (3, "k" * 100_000)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in runindex.remove_repeats(docs, out_text="kept").collect()}
    assert bytes(got[1]["kept"]) == long.encode() and bytes(got[2]["kept"]) == b"zq" and got[2]["n_spans"] == 1
    assert got[3]["n_removed"] == 99_999  # only the first byte is in no string that is not the first


def test_repeats_of_awkward_rows(spark, messy, empty, clashing):
    assert runindex.remove_repeats(empty).count() == 0
    for docs in (messy, clashing):
        got = [tuple(r) for r in runindex.remove_repeats(docs, length=10).collect()]
        assert len(got) == len(MESSY)
        whole = {r[0]: r for r in got if r[0] != 1}
        assert whole[2][1:4] == (0, 0, 0) and whole[None][2] == 0
        once = sorted(r[2] for r in got if r[0] == 1)
        assert once == [0, len(MESSY[0][1])]  # of repeated rows one is the first


def means_by_hand(ids, v, k, rounds):
    order = sorted(range(len(ids)), key=lambda i: (hashlib.sha256(f"3:{ids[i]}".encode()).hexdigest(), v[i]))[:k]
    c = [list(v[i]) for i in order]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), j) for j, y in enumerate(c))

    for _ in range(rounds):
        at = [nearest(x)[1] for x in v]
        for j in range(len(c)):
            own = [x for x, a in zip(v, at, strict=True) if a == j]
            if own:
                c[j] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    found = [nearest(x) for x in v]
    by = defaultdict(int)
    for d, j in found:
        by[j] += d
    return sorted((i, j, d, by[j], sum(by.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, (d, j) in zip(ids, found, strict=True))


def drawn():
    return F.sha2(F.concat(F.lit("3:"), F.col("vec_id").cast("string")), 256)


@pytest.mark.parametrize(("scale", "replay"), [(1.0, 8), (1.0, 2), (1e5, 3)])
def test_sort_means(spark, scale, replay):
    """Integer grids, so that ties and equal centroids occur; small components in doubles, large ones in long integers."""
    rng = random.Random(7)
    vectors = [[rng.randint(-3, 3) * scale / 2 for _ in range(3)] for _ in range(150)]
    ids = list(range(100, 250))
    df = spark.createDataFrame(list(zip(ids, vectors, strict=True)), "vec_id long, embedding array<double>").repartition(3)
    got = sorted(tuple(r) for r in clusters.sort_means(df, 6, 7, 3, drawn(), replay=replay).collect())
    whole = [[int(np.floor(1024 * x)) for x in v] for v in vectors]
    assert got == means_by_hand(ids, whole, 6, 7)


def test_scan_stops_only_strictly_beyond_twice_the_distance():
    c = np.array([[2.0], [0.0], [4.0]])
    at, d = clusters.scan(np.array([[1.0], [3.0]]), np.array([0, 0]), c)
    assert at.tolist() == [0, 0] and d.tolist() == [1, 1]
    at, _ = clusters.scan(np.array([[1.0]]), np.array([1]), np.array([[2.0], [0.0]]))
    assert at.tolist() == [0]  # as near, at exactly twice the distance, of the smaller number


def test_sort_means_of_awkward_rows(spark):
    e = [(1, [0.1, 0.2], "x"), (1, [0.1, 0.2], "x"), (None, [0.5, 0.5], "x"), (2, None, "x"), (3, [0.1], "x"), (4, [0.1, None], "x"), (5, [float("nan"), 0.0], "x"), (6, [float("inf"), 0.0], "x"), (7, [1e300, -1e300], "x"), (8, [0.0, 0.0], "x")]
    df = spark.createDataFrame(e, "vec_id long, embedding array<double>, cluster string")
    got = clusters.sort_means(df, 3, 4, 2, drawn()).collect()
    assert sorted(str(r["vec_id"]) for r in got) == ["1", "1", "7", "8", "None"]
    assert len({(r["cluster"], r["distance"]) for r in got if r["vec_id"] == 1}) == 1
    assert clusters.sort_means(df.limit(0), 3, 4, 2, drawn()).count() == 0
    assert len(clusters.sort_means(df.filter("vec_id = 8"), 3, 4, 2, drawn()).collect()) == 1


def trie_by_hand(rows, step=5, most=8):
    conv = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            conv[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v, key=lambda x: x[:2])] for c, v in conv.items()}
    members, kids, rebuilt = defaultdict(list), defaultdict(list), {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % (most + 1)
        rebuilt[c] = tuple(own.get(c - int(np.fmod(c, step)), [])[:h]) + tuple(own[c][h:])
        for d in range(len(rebuilt[c]) + 1):
            members[rebuilt[c][:d]].append(c)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
    ends = {p: ",".join(str(c) for c in sorted(m) if len(rebuilt[c]) == len(p)) for p, m in members.items()}
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends[p].encode()).hexdigest()) for p, m in members.items()), key=repr)


def conversations(seed, n, turns, texts):
    rng = random.Random(seed)
    out = []
    for c in rng.sample(range(-n, 3 * n), n):
        k = rng.randint(1, turns)
        out += [(c, t, rng.choice(["user", "assistant"]), rng.choice(texts)) for t in range(k)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("shard", "deep"), [(1 << 16, 400), (30, 25)])
def test_prefix_trie_equals_brute_force(spark, monkeypatch, shard, deep):
    monkeypatch.setattr(tries, "CHUNK", 3)
    rows = conversations(2, 150, 12, ["a", "é"]) + [(1000, t, "user", "a") for t in range(deep)] + [(1001, t, "user", "a") for t in range(deep - 10)] + [(2000 + k, 0, "user", "a") for k in range(40)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    assert sorted((tuple(r) for r in tries.prefix_trie(df, shard=shard).collect()), key=repr) == trie_by_hand(rows)


def test_prefix_trie_of_awkward_rows(spark):
    rows = [(1, 0, "user", "x", "k"), (1, 1, None, None, "k"), (1, None, "system", "first", "k"), (1, 1, None, None, "k"), (None, 0, "user", "lost", "k"), (5, 0, None, "", "k"), (6, 0, "", None, "k"), (7, 3, "user", "z" * 100_000, "k")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth string")
    got = sorted((tuple(r) for r in tries.prefix_trie(df).collect()), key=repr)
    assert got == trie_by_hand([r[:4] for r in rows])
    assert tries.prefix_trie(df.limit(0)).count() == 0


def test_louds_round_trip():
    rng = np.random.default_rng(4)
    parent = np.array([-1, -1, *[rng.integers(-1, i) for i in range(2, 200)]])
    depth = np.zeros(200, int)
    for i in range(200):
        depth[i] = depth[parent[i]] + 1 if parent[i] >= 0 else rng.integers(1, 5)
    bits, labels, order, starts = tries.louds(parent, rng.permutation(200), depth)
    above = tries.parents_of(bits, 200)
    assert [order[a] if a >= 0 else -1 for a in above] == parent[order].tolist()
    total = np.ones(200, np.int64)
    tries.roll_up(above, starts, total)
    for place, node in enumerate(order):
        below = [node]
        for i in range(200):
            if parent[i] in below:
                below.append(i)
        assert total[place] == len(below)
    assert len(bits) == -(-401 // 8) and len(labels) == 200
