"""Operators do the whole of their job: cases that an earlier cut left out."""

import random
import re
from importlib import resources

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from halocline.llm import groups, jaccard, licenses, pii
from halocline.llm.workspace import Workspace
from tests.llm.test_pairs import brute_classes, word_sets


def test_split_buckets_keep_the_recall(spark):
    """Texts put together from frequent passages: all buckets are split several times, at the recall of production."""
    rng = random.Random(5)
    passages = [" ".join(f"p{i}w{k}" for k in range(20)) for i in range(40)]
    texts = []
    for _ in range(250):
        taken = rng.sample(passages, 11)
        texts += [" ".join(taken[:10]), " ".join([*taken[:9], taken[10]])]
    links, _ = brute_classes(word_sets(texts), 0.8)
    assert sum(links) >= 500
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["n_links"] for r in jaccard.join_similar(docs, small=4, alike=2.0, block=8).collect()}
    assert sum(got.values()) >= 0.999 * sum(links)
    assert all(got[i] <= n for i, n in enumerate(links))


@pytest.mark.parametrize("steps", [1, 2, 3, 6])
def test_runs_hold_the_recall_at_any_depth(steps):
    """Pairs just at the threshold, of sizes as unequal as it allows, whose every bucket takes so many steps."""
    rng = np.random.default_rng(steps)
    runs = jaccard.runs_for(0.999, jaccard.found_in_run(steps, 2.0))
    missed, pairs = 0, 400
    for _ in range(pairs):
        big = rng.integers(0, 2**63, 200).astype(np.uint64)
        small = big[:160]
        at = [jaccard.mix(rng.integers(0, 2**63, runs).astype(np.uint64))] * 2
        for step in range(steps):
            at = [jaccard.choose(s, p, 0.8, 2.0 if step else 1.0) if len(p) else p for s, p in zip((big, small), at, strict=True)]
            both = np.intersect1d(*at)
            at = [both, both]
        missed += not len(at[0])
    assert missed <= 3


@pytest.mark.parametrize(
    ("text", "iban"),
    [
        ("IBAN DE89370400440532013000 BIC COBADEFFXXX", "DE89370400440532013000"),
        ("IBAN DE89 3704 0044 0532 0130 00 EUR 50", "DE89 3704 0044 0532 0130 00"),
        ("GB82WEST12345698765432 2024-01-02", "GB82WEST12345698765432"),
        ("REF AB12 CDEF GH89 IBAN GB82 WEST 1234 5698 7654 32 OK", "GB82 WEST 1234 5698 7654 32"),
    ],
)
def test_iban_followed_by_words_and_numbers(text, iban):
    assert [x["match"] for x in pii.scan(text) if pii.KINDS[x["kind"]] == "iban"] == [iban]


def test_licences_as_published(spark):
    by = "Copyright (c) 2020, Some One\n"
    clause = "3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.\n\n"
    two = licenses.LICENSES["BSD-2-Clause"]
    long = {f.name.removesuffix(".txt"): f.read_text() for f in resources.files("halocline.llm").joinpath("license_texts").iterdir()}
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0"} <= set(long)
    texts = [
        ("MIT", f"MIT License\n\n{by}\n" + licenses.LICENSES["MIT"]), ("MIT", f"The MIT License (MIT)\n\n{by}\n" + licenses.LICENSES["MIT"]),
        ("ISC", f"ISC License\n\n{by}\n" + licenses.LICENSES["ISC"]), ("BSD-2-Clause", f"BSD 2-Clause License\n\n{by}All rights reserved.\n\n" + two),
        ("BSD-3-Clause", f"BSD 3-Clause License\n\n{by}\n" + two.replace("THIS SOFTWARE IS", clause + "THIS SOFTWARE IS", 1)),
        ("Apache-2.0", long["Apache-2.0"].replace("[yyyy] [name of copyright owner]", "2020 Some One")), ("Apache-2.0", long["Apache-2.0"].split("APPENDIX")[0]),
        *long.items(), (None, "MIT License"),
    ]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["license_id"] for r in licenses.scan_licenses(docs, licenses.known_licenses(spark)).collect()}
    assert [got[i] for i in range(len(texts))] == [k for k, _ in texts]


@pytest.mark.parametrize("most", [1000, 0])
def test_licences_wrapped_at_any_width(spark, most):
    """Paragraphs filled anew at all widths, behind a copyright line where the licence has none of its own."""
    import textwrap

    rows = []
    for name, text in licenses.published():
        text = text if name not in licenses.SHORT else text.replace("\n", "\n\n")
        for width in range(40, 121) if most else (40, 77, 120):
            paragraphs = ["\n".join(textwrap.wrap(p, width, break_long_words=False, break_on_hyphens=False)) for p in re.split(r"\n\s*\n", text)]
            by = "Copyright (c) 2019-2024, Some One <one@example.org>\n\n" if name in licenses.SHORT else ""
            rows.append((name, by + "\n\n".join(paragraphs)))
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r["license_id"] for r in licenses.scan_licenses(docs, licenses.known_licenses(spark), most=most).collect()}
    assert [(rows[i][0], i) for i in range(len(rows)) if got[i] != rows[i][0]] == []


def test_only_notices_are_dropped(spark):
    lines = ["copyright notice and this permission notice", "(c) you must retain", "copyright 2020 some one", "(c) 2020 some one", "© some one", "# all rights reserved.", "all rights reserved by law stay", "copyright (c) some one", "copyrighted material"]
    df = spark.createDataFrame([(i, f"a\n{x}\nb") for i, x in enumerate(lines)], "i int, t string")
    kept = {r["i"] for r in df.filter(licenses.without_notices(F.col("t"))== F.col("t")).collect()}
    assert kept == {0, 1, 6, 8}


def _sent(monkeypatch, module):
    """How many rows with a text are given to each counted join of a module."""
    sent = []
    joined = module.join_counted

    def join(rows, *args, **how):
        if "text" in rows.columns:
            sent.append(rows.count())
        return joined(rows, *args, **how)

    monkeypatch.setattr(module, "join_counted", join)
    return sent


def _few_copies():
    """1,000 texts of their own, and five pairs of near copies, a repeated row, a copy under another id, no words, no id."""
    rows = [(i, " ".join(f"t{i}w{k}" for k in range(30))) for i in range(1000)]
    near = [(2000 + i, rows[i][1] + " more") for i in range(5)]
    return rows + near + [rows[7], (3000, rows[8][1]), (None, rows[9][1]), (3001, None), (3001, " "), (3001, None)]


def test_only_texts_in_doubt_are_sent_to_be_compared(spark, monkeypatch):
    sent = _sent(monkeypatch, jaccard)
    docs = spark.createDataFrame(_few_copies(), "doc_id long, text string").repartition(3)
    got = {(r["doc_id"], r["n_links"]) for r in jaccard.join_similar(docs).collect()}
    assert {(i, 1) for i in (*range(5), *range(2000, 2005), 7, 8, 9, 3000, None)} | {(3001, 0), (5, 0), (6, 0)} <= got
    assert len(got) == 1008
    assert sent and max(sent) <= 100


def test_texts_that_stay_are_sent_nowhere(spark, monkeypatch):
    sent = _sent(monkeypatch, groups)
    docs = spark.createDataFrame([(*r, "en", "a", 1) for r in _few_copies()], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = sorted((r["doc_id"], r["text"] or "") for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect())
    assert got == sorted([(i, " ".join(f"t{i}w{k}" for k in range(30))) for i in range(1000)] + [(3001, ""), (3001, " "), (3001, "")])
    assert sent and max(sent) <= 100


def test_marked_rows_hold_all_keys(spark):
    work = Workspace(spark, "test")
    keyed = work.write(spark.range(0, 4000, 40).select(F.col("id").alias("a"), F.when(F.col("id") % 80 > 0, F.col("id")).alias("b")), "keyed")
    rows = spark.range(4000).select(F.col("id").alias("a"), F.when(F.col("id") % 80 > 0, F.col("id")).alias("b"))
    found = {r["a"] for r in groups.marked(rows, keyed, ["a", "b"], "there").filter("there").collect()}
    assert set(range(0, 4000, 40)) <= found and len(found) <= 100 + 4000 / 16
    assert groups.marked(rows, keyed.limit(0), ["a", "b"], "there").filter("there").isEmpty()
    assert groups.marked(rows, keyed, ["a", "b"], "there", most=1).count() == 4000
