"""Jaccard join, embedding index, decontamination and the pipeline: against brute force."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from halocline.llm import decontaminate, embeddings, groups, jaccard


def brute_classes(sets, threshold):
    n = len(sets)
    links = [[j for j in range(n) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9] for i in range(n)]
    root = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            low = min([root[i], *[root[j] for j in links[i]]])
            changed |= low != root[i]
            root[i] = low
    return [len(x) for x in links], root


def texts_with_copies(seed=0, base=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    shared = " ".join(rng.choices(words, k=40))
    out = []
    for _ in range(base):
        t = rng.choices(words, k=rng.randint(3, 160))
        out.append(" ".join(t))
        if rng.random() < 0.2:
            out.append(shared + " " + " ".join(t))
        for _ in range(rng.choice([0, 0, 1, 4])):
            e = list(t)
            for _ in range(rng.randint(0, 2)):
                e[rng.randrange(len(e))] = rng.choice(words)
            out.append(" ".join(e))
    return out


def word_sets(texts, n=5):
    out = []
    for t in texts:
        w = (t or "").lower().split()
        out.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    return out


@pytest.mark.parametrize("small", [512, 4])
def test_links_and_classes(spark, small):
    """Small buckets only, and with a bound that makes buckets split and meet in blocks."""
    texts = [*texts_with_copies(), "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r for r in jaccard.join_similar(docs, small=small, block=small, recall=0.9999).collect()}
    links, root = brute_classes(word_sets(texts), 0.8)
    assert [got[i]["n_links"] for i in range(len(texts))] == links
    assert [got[i]["class_id"] for i in range(len(texts))] == root
    assert [got[i]["kept"] for i in range(len(texts))] == [i == r for i, r in enumerate(root)]


def test_a_large_group_of_near_copies(spark):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for _ in range(120):
        t = list(base)
        t[rng.randrange(200)] = f"v{rng.randrange(10**6)}"
        texts.append(" ".join(t))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = jaccard.join_similar(docs, small=16, block=16).collect()
    links, _ = brute_classes(word_sets(texts), 0.8)
    assert {r["class_id"] for r in got} == {0}
    assert sum(r["n_links"] for r in got) >= 0.999 * sum(links)
    assert all(r["n_links"] <= links[r["doc_id"]] for r in got)


@pytest.mark.parametrize("text", ["", "a", "a b", "a b c", "a b c d", "a b c d e", "a b c d e f"])
def test_sets_of_short_batches(text):
    n = len(text.split())
    assert [len(s) for s in jaccard.ngram_sets([text], 5)] == [max(1, n - 4) if n else 0]
    assert [len(s) for s in jaccard.ngram_sets([text, None, "x y"], 5)] == [max(1, n - 4) if n else 0, 0, 1]


def test_one_text_of_a_class_without_ids_is_kept(spark):
    words = " ".join(f"w{i}" for i in range(100))
    docs = spark.createDataFrame([(None, words), (None, words + " z"), (None, words), (None, "a"), (None, None)], "doc_id string, text string")
    got = jaccard.join_similar(docs).collect()
    assert sorted(r["n_links"] for r in got) == [0, 0, 2, 2, 2]
    kept = [r for r in got if r["kept"] and r["n_links"]]
    assert len({r["text_key"] for r in kept}) == 1
    assert sum(r["kept"] for r in got if not r["n_links"]) == 2


@pytest.mark.parametrize("text", ["x", "x y z", "a b c d"])
def test_a_table_of_one_short_text(spark, text):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [(r["class_id"], r["n_links"], r["kept"]) for r in jaccard.join_similar(docs).collect()] == [(1, 0, True)]


def test_near_copies_without_ids(spark):
    """Of near copies whose ids are null one stays; texts without words all stay."""
    words = " ".join(f"w{i}" for i in range(100))
    rows = [(None, words), (None, words + " z"), (None, None), (None, None), (None, " \n"), (4, words + " y"), (4, words + " y"), (9, "else")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("text_key", F.lit("x"))
    kept = sorted((r["doc_id"] or 0, r["text"] or "") for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect())
    assert kept == [(0, ""), (0, ""), (0, " \n"), (4, words + " y"), (9, "else")]


def test_mix_numbers_repeated_rows(spark):
    """A row that stands often takes its share of the target, one copy more on some of its rows."""
    rows = [(1, "a", "w " * 10)] * 90 + [(i, "b", "w " * 9) for i in range(2, 52)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("place", F.lit(1))
    out = corpus_pipeline.mix_sources(spark, docs, "").collect()
    taken = {s: sum(r["copies"] * len(r["text"].split()) for r in out if r["source"] == s) for s in ("a", "b")}
    assert abs(taken["a"] - (900 + 450) * 5 / 7) <= 10
    assert abs(taken["b"] - (900 + 450) * 2 / 7) <= 9
    assert len([r for r in out if r["source"] == "a"]) <= 90


def test_join_of_awkward_rows(messy, empty, clashing):
    for docs in (messy, clashing):
        got = {(r["doc_id"], r["n_links"], r["class_id"]) for r in jaccard.join_similar(docs).collect()}
        assert (1, 1, 1) in got
        assert (2, 0, 2) in got
        assert (None, 0, None) in got
    assert jaccard.join_similar(empty).count() == 0


def test_blocks_make_every_pair_once(spark):
    members = spark.range(100).select(F.lit(1).alias("g"), "id")
    rows = groups.in_blocks(members, ["g"], F.col("id"), 16, jaccard.Workspace(spark, "test")).collect()
    seen = {}
    for r in rows:
        seen.setdefault((r["bi"], r["bj"]), []).append((r["id"], r["side"]))
    pairs = [(a, b) for (bi, bj), m in seen.items() for a, s in m for b, t in m if a < b and (bi == bj or s != t)]
    assert len(pairs) == len(set(pairs)) == 100 * 99 // 2


def test_numbers_of_hot_keys(spark):
    rows = spark.range(3000).repartition(6).select(F.when(F.col("id") < 2500, F.lit(None)).otherwise(F.col("id") % 3).alias("k"), "id")
    got = groups.numbered(groups.Workspace(spark, "test").write(rows, "rows"), ["k"], "place", groups.Workspace(spark, "test")).collect()
    assert len(got) == len({r["id"] for r in got}) == 3000
    by = {}
    for r in got:
        by.setdefault(r["k"], []).append(r["place"])
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in by.values())


@pytest.mark.parametrize("how", ["inner", "left"])
def test_a_join_with_hot_keys_is_the_join(spark, how):
    rows = spark.range(4000).select((F.when(F.col("id") < 1500, F.lit(7)).otherwise(F.col("id"))).alias("k"), F.col("id").alias("v"))
    counted = groups.Workspace(spark, "test").write(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("k % 5 != 0"), "counted")
    got = groups.join_counted(rows, counted, ["k"], "n", 4000, how)
    assert sorted(got.collect(), key=str) == sorted(rows.join(counted, ["k"], how).select(got.columns).collect(), key=str)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40) if i != 20] + [(100, 105), (105, 101)]
    got = {r["node"]: r["root"] for r in groups.components(spark.createDataFrame(edges, "a long, b long"), jaccard.Workspace(spark, "test")).collect()}
    assert got == {**{i: 0 for i in range(21)}, **{i: 21 for i in range(21, 41)}, 100: 100, 101: 100, 105: 100}


def test_embedding_links_and_recall(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(150, 24))
    rows = [v for v in base] + [v + rng.normal(size=24) * s for v in base[:60] for s in (0.02, 0.12, 0.3)] + [base[0]] * 3
    data = [(i, [float(x) for x in v]) for i, v in enumerate(rows)]
    n = len(data)
    bad = [None, [0.0] * 24, [float("nan")] + [1.0] * 23, [None] + [1.0] * 23, [], [float("inf")] * 24]
    data += [(n + k, v) for k, v in enumerate(bad)]
    got = {r["vec_id"]: r for r in embeddings.link_embeddings(spark.createDataFrame(data, "vec_id long, embedding array<double>"), pivots=64, block=32).collect()}
    unit = np.array(rows) / np.linalg.norm(rows, axis=1)[:, None]
    near = unit @ unit.T >= 0.95
    links = near.sum(1) - 1
    found = np.array([got[i]["n_links"] for i in range(n)])
    assert (found <= links).all()
    assert found.sum() >= 0.9 * links.sum()
    a, b = np.nonzero(near)
    root = groups.local_roots(n, a, b)
    assert np.mean([got[i]["component_id"] == root[i] for i in range(n)]) > 0.95
    assert all((got[n + k]["n_links"], got[n + k]["component_id"], got[n + k]["kept"]) == (0, n + k, True) for k in range(len(bad)))


def test_recall_at_the_parameters_of_the_query(spark):
    """Pairs with cosines just above the threshold, too."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(1500, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    other = rng.normal(size=(1500, 64))
    other -= (other * base).sum(1)[:, None] * base
    other /= np.linalg.norm(other, axis=1)[:, None]
    cosine = rng.uniform(0.951, 0.99, 1500)[:, None]
    rows = np.concatenate([base, cosine * base + np.sqrt(1 - cosine**2) * other])
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    for pivots in (256, 1024):
        got = embeddings.link_embeddings(docs, pivots=pivots)
        assert got.agg(F.sum("n_links")).first()[0] >= 0.9 * 3000


def test_pivots_grow_with_the_table():
    assert embeddings.pivots_for(50_000, 256, 8, 4, 512) == 256
    assert 7000 < embeddings.pivots_for(10**9, 256, 8, 4, 512) < 8000


def test_awkward_embeddings(spark):
    """Null ids, repeated rows, equal and long vectors, vectors of other lengths, columns of the names that are used."""
    long = [float(i % 7 + 1) for i in range(5000)]
    rows = [(None, [1.0, 2.0]), (None, [1.0, 2.0]), (3, [1.0, 2.0]), (3, [1.0, 2.0]), (4, [2.0, 4.0]), (5, [1.0, 2.0, 0.0]), (6, long), (7, [2 * x for x in long]), (None, None), (8, [-1.0, -2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in ("key", "pivots", "size", "n", "sound", "root", "links")})
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0, r["kept"]) for r in embeddings.link_embeddings(df).collect())
    assert got == sorted([(0, 4, 3, False), (0, 4, 3, False), (3, 4, 3, True), (3, 4, 3, True), (4, 4, 3, False), (5, 0, 5, True), (6, 1, 6, True), (7, 1, 6, False), (0, 0, 0, True), (8, 0, 8, True)])


def test_no_embeddings(spark):
    assert embeddings.link_embeddings(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def lcs_table(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_bit_parallel_subsequence():
    rng = random.Random(0)
    for _ in range(200):
        a, b = rng.choices(range(1, 8), k=rng.randint(1, 30)), rng.choices(range(1, 8), k=rng.randint(0, 60))
        assert decontaminate.lcs(np.array(a), b) == lcs_table(a, b)


def bench_and_docs(spark):
    rng = random.Random(6)
    words = [f"b{i}" for i in range(300)]
    items = [" ".join(rng.choices(words, k=30)) + ". " + " ".join(rng.choices(words, k=6)) + "." for _ in range(12)]
    prose = lambda: rng.choices([f"p{i}" for i in range(2000)] + words, k=rng.randint(50, 300))
    docs, truth = [], set()
    for d in range(60):
        t = prose()
        if d % 4 == 0:
            k = rng.randrange(12)
            w = items[k].upper().split() if d % 8 else items[k].split()
            if d % 12 == 0:  # a paraphrase: a fifth of the words that are not the answer are others
                w = [x if i >= 30 or rng.random() > 0.2 else rng.choice(["p1", "p2"]) for i, x in enumerate(w)]
            at = rng.randrange(len(t))
            t[at:at] = w
            truth.add((d, k))
        docs.append((d, " ".join(t)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), truth


@pytest.mark.parametrize("block", [5000, 5])
def test_leaks(spark, block):
    """All items at once, and some at a time."""
    docs, bench, truth = bench_and_docs(spark)
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, bench, items_per_pass=block).collect()}
    assert got == truth


def test_leaks_against_every_item_with_every_text(spark):
    """Without the search for candidates: the longest common subsequence around every passage, short items too."""
    rng = random.Random(12)
    words = [f"b{i}" for i in range(250)]
    items = [" ".join(rng.choices(words, k=rng.choice([4, 6, 9, 14, 20, 45, 90]))) + ". " + " ".join(rng.choices(words, k=3)) for _ in range(40)]
    docs = []
    for d in range(120):
        t = rng.choices([f"p{i}" for i in range(500)] + words, k=rng.randint(5, 260))
        if d % 2:
            w = items[rng.randrange(40)].split()
            w = [x if rng.random() > rng.choice([0, 0.1, 0.25, 0.4]) else rng.choice(["p1", "b2", "p3"]) for x in w]
            at = rng.randrange(len(t))
            t[at:at] = w
        docs.append((d, " ".join(t)))
    truth = set()
    for d, text in docs:
        tokens = text.lower().replace(".", " ").split()
        for k, item in enumerate(items):
            stem, last = (x.split() for x in item.split(". "))
            whole = stem + last
            for w in range(max(1, -(-len(tokens) // 20) - 1)):
                region = tokens[max(0, w * 20 - len(whole)) : (w + 2) * 20 + len(whole)]
                share = lcs_table(whole, region) / len(whole)
                if share >= 0.75 or (share >= 0.55 and lcs_table(last, region) / len(last) >= 0.8):
                    truth.add((d, k))
                    break
    assert len(truth) > 40
    benchmark = spark.createDataFrame([*enumerate(items), (0, items[0])], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), benchmark).collect()}
    assert got <= truth
    assert len(got) >= 0.97 * len(truth)
    short = {k for k, item in enumerate(items) if len(item.split()) <= 15}
    assert {(d, k) for d, k in truth if k in short} <= got


def test_leaks_of_awkward_rows(spark, messy, empty, clashing):
    bench = spark.createDataFrame([(1, None), (2, ""), (None, "quick brown fox jumps over the lazy dog and runs"), (4, "nothing of the kind stands there")], "item_id long, text string")
    for docs in (messy, clashing):
        assert [(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, bench).collect()] == [(1, None)] * 2
    assert decontaminate.find_leaks(empty, bench).count() == 0
    assert decontaminate.find_leaks(messy, bench.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the driver's tables")
def test_pipeline_stage_by_stage(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    spoken = corpus_pipeline.identify_language(spark, docs, d)
    assert spoken.columns == columns
    assert spoken.count() >= 0.98 * docs.filter("text rlike '[a-z]'").count()
    apart = corpus_pipeline.drop_near_copies(spark, spoken, d)
    rows = spoken.select("doc_id", "text").orderBy("doc_id").collect()
    _, root = brute_classes(word_sets([r["text"] for r in rows]), 0.8)
    assert {r["doc_id"] for r in apart.collect()} == {rows[k]["doc_id"] for k in set(root)}
    clean = corpus_pipeline.drop_leaks(spark, apart, d)
    items = [r["text"] for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    leaky = {r["doc_id"] for r in apart.collect() if any(i in r["text"] for i in items)}
    assert {r["doc_id"] for r in apart.collect()} - {r["doc_id"] for r in clean.collect()} == leaky
    safe = corpus_pipeline.redact_secrets(spark, clean, d)
    assert safe.columns == columns
    assert safe.count() == clean.count()
    assert safe.filter("text rlike '[0-9a-f]{32}' or text rlike 'AKIA[A-Z0-9]{12}' or n_chars != length(text)").count() == 0
    mixed = corpus_pipeline.mix_sources(spark, safe, d)
    assert mixed.columns == [*columns, "copies"]
    assert mixed.filter("copies < 1 or copies > 3").count() == 0


def stays(rows) -> list:
    return sorted((r["doc_id"] for r in rows), key=lambda i: (i is None, i))


def test_pipeline_stages_on_awkward_rows(spark, messy, empty, clashing, tmp_path):
    spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stage = dict(corpus_pipeline.STAGES)
    texts = {r["doc_id"]: r["text"] for r in messy.collect()}
    for docs in (messy, clashing):
        spoken = stays(stage["language"](spark, docs, str(tmp_path)).collect())
        assert spoken.count(1) == 2 and 5 in spoken and not {2, 3, 4, 6} & set(spoken)  # those without a letter go
        apart = stage["near copies"](spark, docs, str(tmp_path)).collect()
        assert stays(apart) == [1, 2, 3, 4, 5, 6, 7, None]  # one of the repeated rows; wordless ones are no copies
        clean = stage["benchmark"](spark, docs, str(tmp_path)).collect()
        assert stays(clean) == [2, 3, 4, 5, 6, 7, None]  # both repeated rows leak
        safe = stage["secrets"](spark, docs, str(tmp_path)).collect()
        assert stays(safe) == [1, 1, 2, 3, 4, 5, 6, 7, None] and all(r["text"] == texts[r["doc_id"]] for r in safe if r["doc_id"] != 5)
        mixed = stage["mix"](spark, docs, str(tmp_path)).collect()
        assert {r["doc_id"] for r in mixed} <= set(texts) and all(1 <= r["copies"] <= 3 and r["text"] == texts[r["doc_id"]] for r in mixed)
    for docs in (messy, empty, clashing):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            assert set(docs.columns) <= set(out.columns), name
            out.write.format("noop").mode("overwrite").save()
