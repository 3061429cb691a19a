"""Context-tree weighting, language identification and mixing: against brute force and invariants."""

import math
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from halocline.llm import ctw, langid, mixing
from halocline.llm.hashing import normalize


def brute_ctw(train: list[bytes], texts: list[bytes], depth: int) -> list[float]:
    """log10 probabilities by the recursion over whole trees."""
    counts = defaultdict(lambda: [0, 0])
    kids = defaultdict(set)

    def walk(body):
        padded = bytes(depth) + body
        for i, byte in enumerate(body):
            context, node = padded[i : i + depth], 1
            for k in range(7, -1, -1):
                bit = byte >> k & 1
                yield context, node, bit
                node = node * 2 + bit

    for body in train:
        for context, node, bit in walk(body):
            for d in range(depth + 1):
                counts[context[depth - d :], node][bit] += 1
                if d:
                    kids[context[depth - d + 1 :], node].add(context[depth - d :])
    lg = math.lgamma
    kt = lambda a, b: lg(a + 0.5) + lg(b + 0.5) - lg(a + b + 1) - math.log(math.pi) if a + b else 0.0
    memo = {}

    def weighted(s, node):
        if (s, node) not in memo:
            own = kt(*counts.get((s, node), (0, 0)))
            longer = sum(weighted(c, node)[0] for c in kids.get((s, node), ()))
            w = own if len(s) == depth else max(own, longer) + math.log1p(math.exp(-abs(own - longer))) - math.log(2)
            memo[s, node] = w, own, longer
        return memo[s, node]

    def p_zero(context, node, d):
        s = context[depth - d :]
        a, b = counts.get((s, node), (0, 0))
        own = (a + 0.5) / (a + b + 1)
        if d == depth:
            return own
        w, block, longer = weighted(s, node)
        share = math.exp(block + math.log(0.5) - w)
        return share * own + (1 - share) * p_zero(context, node, d + 1)

    out = []
    for body in texts:
        total = 0.0
        for context, node, bit in walk(body):
            p = p_zero(context, node, 0)
            total += math.log10(p if bit == 0 else 1 - p)
        out.append(total)
    return out


def test_scores_against_the_recursion(spark):
    rng = random.Random(3)
    words = ["the", "of", "Sea", "wave", "é", "tide", "x1"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 12)))) for i in range(40)] + [(99, None), (98, "unseen ZZ words"), (3, "the sea")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r["doc_id"], r["n_bytes"]): r for r in ctw.score(docs, F.col("doc_id") < 30, depth=3, block_bytes=200).collect()}
    bodies = [normalize(t) for _, t in rows]
    expected = brute_ctw([b for (i, _), b in zip(rows, bodies, strict=True) if i < 30], bodies, 3)
    for (i, _), body, score in zip(rows, bodies, expected, strict=True):
        assert got[i, len(body)]["score"] == pytest.approx(score, rel=1e-6)
    c, n = defaultdict(int), 0
    for i, t in rows:
        if i < 30:
            for w in [*normalize(t).split(), "end"]:
                c[w] += 1
                n += 1
    for (i, _), body in zip(rows, bodies, strict=True):
        tokens = [*body.split(), "end"]
        r = got[i, len(body)]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(c[w] > 0 for w in tokens), n)
        vocabulary = sum(v > 0 for v in c.values())
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (vocabulary + 1))) for w in tokens), rel=1e-6)


def test_scores_of_awkward_rows(messy, empty, clashing):
    for docs in (messy, clashing):
        got = ctw.score(docs, F.col("doc_id") > 1, depth=2).collect()
        assert len(got) == 9
        assert all(r["score"] < 0 for r in got)
    assert ctw.score(empty, F.lit(True), depth=2).count() == 0
    nothing = ctw.score(messy, F.lit(False), depth=2).collect()
    assert all(r["score"] == pytest.approx(8 * r["n_bytes"] * math.log10(0.5), rel=1e-6) for r in nothing)


LANGUAGES = {
    "en": "the of and to in is was for that with as his they be at one have this from or had by hot word but what some we can out other were all",
    "fr": "le de un être et à il avoir ne je son que se qui ce dans en du elle au pour pas vous par sur faire plus dire me on mon lui nous",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei",
}


def test_language_on_held_out_texts(spark):
    rng = random.Random(5)
    rows = [(i, lang, " ".join(rng.choices(LANGUAGES[lang].split(), k=rng.randint(5, 40)))) for i, lang in enumerate(rng.choices(list(LANGUAGES), k=400))]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    model = langid.fit(docs.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
    got = {r["doc_id"]: r["language"] for r in langid.predict(docs, model).collect()}
    right = [got[i]["lang"] == lang for i, lang, _ in rows if held(i)]
    assert sum(right) / len(right) > 0.98
    assert all(0 <= x["score"] <= 1 for x in got.values())


def test_language_masks_hold_every_learned_gram(spark):
    docs = spark.createDataFrame([("ab cd", "x")] * 5 + [("ef gh", "y")] * 5, "text string, lang string")
    model = langid.fit(docs, slots=1 << 10)
    share, there = model.shares(["ab cd", "ef gh", "zz", "", "!"])
    assert share[0, 0] == share[1, 1] == 1.0
    assert list(there) == [True, True, True, False, False]


def test_filter_against_exact_sets(spark):
    """Shares by the bit-sliced filter, less its false positives, are near those of sets of n-grams; predictions are equal."""
    rng = random.Random(9)
    train = [(" ".join(rng.choices(LANGUAGES[lang].split(), k=30)), lang) for lang in rng.choices(list(LANGUAGES), k=300)]
    model = langid.fit(spark.createDataFrame(train, "text string, lang string"), slots=1 << 13)

    def grams(text):
        words = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
        return [words[i : i + 4] for i in range(len(words) - 3)]

    counts = {lang: defaultdict(int) for lang in LANGUAGES}
    for text, lang in train:
        for g in grams(text):
            counts[lang][g] += 1
    total = {lang: sum(c.values()) for lang, c in counts.items()}
    rate = lambda lang, g: counts[lang][g] / total[lang]
    sets = {lang: {g for g in counts[lang] if counts[lang][g] and rate(lang, g) >= 0.1 * max(rate(o, g) for o in LANGUAGES)} for lang in LANGUAGES}
    texts = [" ".join(rng.choices([*LANGUAGES[lang].split(), "xyzzyx", "qwrtp"], k=12)) for lang in rng.choices(list(LANGUAGES), k=60)]
    share, _ = model.shares(texts)
    for text, got in zip(texts, share, strict=True):
        own = [sum(g in sets[lang] for g in grams(text)) / len(grams(text)) for lang in model.languages]
        assert got == pytest.approx(own, abs=0.12)
        assert got.argmax() == max(range(len(own)), key=own.__getitem__)


def test_a_language_with_one_text_keeps_its_grams(spark):
    model = langid.fit(spark.createDataFrame([("ab cd", "x")] * 50 + [("ef gh", "y")], "text string, lang string"))
    assert model.shares(["ef gh"])[0][0].tolist() == [0.0, 1.0]


@pytest.mark.parametrize("slots", [0, 1000, 1 << 21])
def test_slots_are_checked_first(spark, slots):
    with pytest.raises(ValueError, match="power of two"):
        langid.fit(spark.createDataFrame([], "text string, lang string"), slots=slots)


def test_language_of_awkward_rows(messy, empty, clashing):
    model = langid.fit(messy)
    for docs in (messy, clashing):
        got = langid.predict(docs, model).select("text", "language.*").collect()
        assert len(got) == 9
        assert all((r["lang"] == "und") == (not any(c.isalpha() for c in r["text"] or "")) for r in got)
    assert {r["lang"] for r in langid.predict(messy, langid.fit(empty)).select("language.lang").collect()} == {"und"}
    assert langid.predict(empty, model).count() == 0


def test_targets_fill_up_to_the_cap(spark):
    sizes = [("a", 100, 1), ("b", 10, 1), ("c", 500, 1), (None, 90, 1)]
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(sizes, "source string, source_size long, n_units long"), (5, 2, 1), 3.0).collect()}
    weight, size = {"a": 5, "b": 2, "c": 1, None: 5}, {s: n for s, n, _ in sizes}
    target, open_ = dict.fromkeys(size, 0.0), set(size)
    left = sum(size.values())
    while True:  # share, stop at the cap, share again
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        full = {s for s in open_ if share[s] > 3 * size[s]}
        if not full:
            target.update(share)
            break
        for s in full:
            target[s] = 3.0 * size[s]
            left -= target[s]
        open_ -= full
    assert got == {s: pytest.approx(t) for s, t in target.items()}


def test_mix_meets_targets(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "b", "c", None]), "w " * rng.choice([1, 3, 10, 40])) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix(docs, fan_in=50).collect()
    again = mixing.mix(docs.repartition(7), fan_in=50).collect()
    key = lambda r: r["doc_id"]
    assert [(r["doc_id"], r["copies"]) for r in sorted(got, key=key)] == [(r["doc_id"], r["copies"]) for r in sorted(again, key=key)]
    for source in ("a", "b", "c", None):
        mine = [r for r in got if r["source"] == source]
        assert abs(sum(r["copies"] * r["size"] for r in mine) - mine[0]["target"]) < 40
    assert all(0 <= r["copies"] <= 3 for r in got)


def test_repeated_rows_are_settled_one_by_one(spark):
    rows = [(1, "a", "w " * 10)] * 300 + [(i, "b", "w " * 7) for i in range(400)] + [(2, None, None)] * 5
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix(docs).collect()
    assert sum(r["n"] for r in got) == len(rows)
    for source, size in (("a", 10), ("b", 7)):
        mine = [r for r in got if r["source"] == source]
        assert abs(sum(r["n"] * r["copies"] * r["size"] for r in mine) - mine[0]["target"]) < size
    assert mixing.rows_of_mix(mixing.mix(docs), 7).count() == len(rows)


def test_settling_keeps_words_and_odds():
    import numpy as np

    rng = np.random.default_rng(0)
    words, share = np.array([5.0, 3.0, 8.0, 2.0, 6.0]), np.array([0.3, 0.9, 0.5, 0.2, 0.7])
    mean = np.zeros(5)
    for _ in range(4000):
        out = mixing.settle(words, share, rng.random(5))
        assert (words * out).sum() == pytest.approx((words * share).sum())
        assert ((out > 1e-9) & (out < 1 - 1e-9)).sum() <= 1
        mean += out / 4000
    assert mean == pytest.approx(share, abs=0.04)


def test_mix_of_awkward_rows(messy, empty, clashing):
    for docs in (messy, clashing):
        got = mixing.mix(docs).collect()
        assert sum(r["n"] for r in got) == 9
        assert mixing.rows_of_mix(mixing.mix(docs), 1).count() == 9
        assert all(r["copies"] <= 3 for r in got)
    assert mixing.mix(empty).count() == 0


def mix_by_hand(docs, weights, cap, fan_in):
    """The mix in plain Python: the same hash draws, everything else worked out anew."""
    key = mixing.KEY
    drawn = {(level, use): F.xxhash64(*key, F.lit(0), F.lit(level), F.lit(use)) for level in range(4) for use in range(3)}
    keyed = docs.select("doc_id", "source", mixing.count_words(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash"))
    units = keyed.groupBy(*key).count().select(*key, "count", F.xxhash64(*key, F.lit(0)).alias("deal"), *[c.alias(f"d{level}{use}") for (level, use), c in drawn.items()]).collect()
    by_source = defaultdict(list)
    for u in units:
        by_source[u["source"]].append(u)
    order = sorted(by_source, key=lambda s: (s is None, (s or "").encode()))
    size = {s: sum(u["size"] * u["count"] for u in by_source[s]) for s in order}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, free, rest = {}, list(order), float(sum(size.values()))
    while free:
        level = rest / sum(weight[s] for s in free)
        full = [s for s in free if weight[s] * level > cap * size[s]]
        if not full:
            target |= {s: weight[s] * level for s in free}
            break
        target |= {s: cap * size[s] for s in full}
        rest -= sum(target[s] for s in full)
        free = [s for s in free if s not in full]
    out, largest = defaultdict(int), max(map(len, by_source.values()))
    for s in order:
        ratio = target[s] / size[s] if size[s] else 0.0
        state = []
        for u in by_source[s]:
            share, whole = ratio - math.floor(ratio), math.floor(ratio)
            open_ = share > 0 and u["size"] > 0
            over = u["count"] * share if open_ else 0.0
            state.append({"u": u, "whole": whole, "more": math.floor(over), "share": over - math.floor(over), "chunk": u["deal"] % math.ceil(len(by_source[s]) / fan_in)})
        level, chunks = 0, max(1, math.ceil(largest / fan_in))
        while True:
            groups = defaultdict(list)
            for x in state:
                if 0 < x["share"] < 1:
                    groups[x["chunk"]].append(x)
            for group in groups.values():
                group.sort(key=lambda x: (-x["u"]["size"], x["u"][f"d{level}0"], x["u"]["text_hash"], x["u"][f"d{level}1"]))
                held = None
                for x in group:
                    if held is None:
                        held = x
                        continue
                    big, small = held["u"]["size"], x["u"]["size"]
                    a, b = held["share"] * big, x["share"] * small
                    up, down = min(big - a, b), min(a, small - b)  # what the held one can gain, and lose
                    draw = ((x["u"][f"d{level}1"] % 2**64) >> 11) / 2**53
                    move = up if draw < down / (up + down) else -down
                    for y, old, most in ((held, a + move, big), (x, b - move, small)):
                        y["share"] = 0.0 if old < 1e-9 else 1.0 if old > most - 1e-9 else old / most
                    held = held if 0 < held["share"] < 1 else x if 0 < x["share"] < 1 else None
            if chunks == 1:
                break
            level, chunks = level + 1, math.ceil(chunks / fan_in)
            for x in state:
                x["chunk"] %= chunks
        for x in state:
            u = x["u"]
            if 0 < x["share"] < 1:
                x["share"] = float(((u[f"d{level}2"] % 2**64) >> 11) / 2**53 < x["share"])
            taken = x["more"] + int(x["share"])
            for n, extra in ((u["count"] - taken, 0), (taken, 1)):
                if n:
                    out[(*[u[k] for k in key], x["whole"] + extra)] += n
    return dict(out), target


@pytest.mark.parametrize("fan_in", [1024, 8])
def test_mix_equals_one_worked_out_by_hand(spark, fan_in):
    """Repeated rows, rows without an id, a null source, texts without words, a source that its cap stops."""
    rng = random.Random(12)
    rows = []
    for i in range(300):
        source = rng.choice(["big", "big", "big", "mid", "Tiny" if i % 10 == 0 else "mid", None])
        rows += [(i if rng.random() < 0.9 else None, source, " ".join(["w"] * rng.randint(0, 90)))] * rng.choice([1, 1, 1, 4])
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    want, target = mix_by_hand(docs, (5, 2, 1), 3.0, fan_in)
    got = mixing.mix(docs, fan_in=fan_in).collect()
    assert {(*[r[k] for k in mixing.KEY], r["copies"]): r["n"] for r in got} == want
    assert {r["source"]: r["target"] for r in got} == {s: pytest.approx(t) for s, t in target.items()}
    words = defaultdict(int)
    for (_, source, size, _, copies), n in want.items():
        words[source] += size * copies * n
    assert all(abs(words[s] - target[s]) <= 90 for s in target)
