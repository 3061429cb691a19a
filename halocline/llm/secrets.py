"""Secret scan: known patterns, and strings whose characters are too evenly spread to be words.

DataFrame functions only. Where no base span and no word with a sample in it stands, a run of 20 or more key characters
is a candidate. Over each of its longest runs of a character class (hex digits, base64 letters) a window of 20
characters slides; the counts of the characters in the window are updated by the one that enters and the one that
leaves, and with them the Shannon entropy. A candidate is a secret if a window's entropy reaches its class's threshold,
unless the allow-list knows it. Every pattern is matched without a step back over a repeated group, in time and stack that do not
grow with what it repeats.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns.
ASSIGN = r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{12,}"  # as AKIA[A-Z0-9]+ of 16 or more: a shorter run holds no other match
HEX = r"[0-9a-f]{32,}"  # as [0-9a-f]+ of 32 or more
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ["assign", "access", "hex", "entropy"]

WINDOW = 20
#: class name, longest runs of it, entropy in bits a character that a window must reach
CLASSES = [("hex", r"[0-9a-fA-F]{20,}+", 3.0), ("base64", r"[A-Za-z0-9+/_=-]{20,}+", 3.8)]
#: What a run must have as well: digits alone are a number, letters alone a word.
MIXED = r"^(?=[0-9]*+[A-Za-z+/_=-])(?=[A-Za-z+/_=-]*+[0-9])"
#: Words with a sample in them are no secrets, and candidates end there. What stands beside them is judged on its own.
SAMPLE = "EXAMPLE|example|0123456789|abcdefghij"
SAMPLE_WORD = rf"(?<![A-Za-z0-9])(?=[A-Za-z0-9]*?(?:{SAMPLE}))[A-Za-z0-9]++"
#: Candidates that are no secrets: words, numbers, lines of signs, UUIDs, words joined by hyphens or slashes.
ALLOWED = [
    "^[A-Za-z_=+/-]*+$",
    "^[0-9_=+/-]*+$",
    "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "^[A-Za-z]++(?:[/_=-]++[A-Za-z0-9]{1,4}+)++$",
    "^(?:[A-Za-z]++|[0-9]++)(?:[/_=-]++(?:[A-Za-z]++|[0-9]++))*+$",
]
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CHUNK = 256  # spans whose positions are summed at once
BITS, PER_WORD = 5, 12  # of a count in a packed word; counts do not exceed WINDOW


def _running(lengths: Column) -> Column:
    """Sums of the items before each, by chunks, so that long arrays are not copied once an item."""
    zero = F.array().cast("array<long>")
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda acc, x: acc + x)

    def before(xs: Column, start: Column) -> Column:
        first = F.struct(start.alias("at"), zero.alias("out"))
        return F.aggregate(xs, first, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    starts = F.sequence(F.lit(1), F.size(lengths), F.lit(CHUNK))
    chunks = F.transform(starts, lambda i: F.slice(lengths, i, F.lit(CHUNK)))
    offsets = before(F.transform(chunks, total), F.lit(0).cast("long"))
    return F.flatten(F.zip_with(chunks, offsets, before))


def spans_of(text: Column, pattern: str, kind: int) -> Column:
    """array<struct<start, kind, end, match>> of all matches, in order. Code points, end exclusive."""
    span = "array<struct<start:int,kind:int,end:int,match:string>>"
    # between the matches lie the pieces that split() leaves: positions are running sums of both lengths
    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("matches"), F.split(text, pattern, -1).alias("pieces"))

    def placed(f: Column) -> Column:
        both = F.zip_with(f["matches"], F.slice(f["pieces"], F.lit(1), F.size(f["matches"])), lambda m, p: F.struct(m.alias("m"), F.length(p).cast("long").alias("p")))
        starts = _running(F.transform(both, lambda b: b["p"] + F.length(b["m"])))
        return F.zip_with(both, starts, lambda b, s: F.struct(
            (s + b["p"]).cast("int").alias("start"), F.lit(kind).alias("kind"), (s + b["p"] + F.length(b["m"])).cast("int").alias("end"), b["m"].alias("match")
        ))

    return F.when(text.rlike(pattern), F.element_at(F.transform(F.array(found), placed), 1)).otherwise(F.array()).cast(span)


def max_entropy(string: Column, window: int = WINDOW) -> Column:
    """The highest Shannon entropy, in bits a character, of the windows of ``string`` (of ALPHABET's characters).

    The counts are packed, PER_WORD of them in a long; a step changes one count for the character that leaves and one
    for the one that enters, and the sum of c log2 c by what these two change.
    """
    weight = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 1)])
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), -(-len(ALPHABET) // PER_WORD)).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))

    def counted(acc: Column, code: Column, by: int) -> tuple[Column, Column]:
        word, place = F.floor(code / PER_WORD).cast("int"), ((code % PER_WORD) * BITS).cast("int")
        now = F.call_function("shiftright", F.element_at(acc["counts"], word + 1), place).bitwiseAND(F.lit(31)).cast("int")
        change = F.call_function("shiftleft", F.lit(1).cast("long"), place) * by
        counts = F.transform(acc["counts"], lambda x, i: F.when(i == word, x + change).otherwise(x))
        return counts, acc["sum"] + F.element_at(weight, now + by + 1) - F.element_at(weight, now + 1)

    def slide(codes: Column) -> Column:
        def enter(acc: Column, i: Column) -> Column:
            counts, total = counted(acc, F.element_at(codes, i), 1)
            best = F.when(i >= window, F.greatest(acc["best"], F.lit(math.log2(window)) - total / window)).otherwise(acc["best"])
            return F.struct(counts.alias("counts"), total.alias("sum"), best.alias("best"))

        def step(acc: Column, i: Column) -> Column:
            # first the character that leaves, then the one that enters
            counts, total = counted(acc, F.element_at(codes, F.greatest(i - window, F.lit(1))), -1)
            left = F.when(i > window, F.struct(counts.alias("counts"), total.alias("sum"), acc["best"].alias("best"))).otherwise(acc)
            return F.aggregate(F.array(left), acc, lambda _, x: enter(x, i))

        return F.aggregate(F.sequence(F.lit(1), F.size(codes)), start, step, lambda acc: acc["best"])

    # a list of one, so that the codes are made once and not again at every step
    codes = F.transform(F.split(string, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    return F.element_at(F.transform(F.array(codes), slide), 1)


def _suspect(match: Column) -> Column:
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | match.rlike(pattern)


    def high(run: str, least: float) -> Column:
        runs = F.filter(F.regexp_extract_all(match, F.lit(run), F.lit(0)), lambda r: r.rlike(MIXED))
        return F.exists(runs, lambda r: max_entropy(r) >= least)

    found = F.lit(False)
    for _, run, least in CLASSES:
        found = found | high(run, least)
    return ~allowed & found


def find_secrets(docs: DataFrame, text: str = "text", out: str = "secret_spans") -> DataFrame:
    """Adds ``out``, array<struct<start, kind, end, match>> sorted by start, then kind, to every row.

    kind is an index of KINDS. Candidates are sought in what base spans and words with a sample leave of the text, so
    they touch none. A null text is as an empty one: no spans. Texts are scanned whole, whatever their length; repeated rows
    stay, each scanned alike; of spans that start together the base one comes first. An empty table gives no rows. A
    column named ``out`` is replaced; no other is touched.
    """
    t, s = F.coalesce(F.col(text), F.lit("")), F.col(out)
    hits = docs.withColumn(out, F.struct(spans_of(t, ASSIGN, 0).alias("assign"), spans_of(t, ACCESS, 1).alias("access"), spans_of(t, HEX, 2).alias("hex")))
    assign = F.filter(s["assign"], lambda x: F.length(F.regexp_extract(x["match"], ASSIGN, 2)) >= 8)
    base = hits.withColumn(out, F.array_sort(F.concat(assign, s["access"], s["hex"])))
    # what is blanked is as long as before, so that positions hold
    samples = F.when(t.rlike(SAMPLE), F.array_sort(F.concat(s, spans_of(t, SAMPLE_WORD, len(KINDS))))).otherwise(s)
    left = blanked(t, samples)
    rest = F.filter(spans_of(left, CANDIDATE, 3), lambda x: _suspect(x["match"]))
    return base.withColumn(out, F.array_sort(F.concat(s, rest)))


def blanked(text: Column, spans: Column) -> Column:
    """``text`` with spaces in place of ``spans``, sorted by start."""
    def step(acc: Column, x: Column) -> Column:
        start = F.greatest(acc["at"], x["start"])
        piece = F.concat(F.substring(text, acc["at"] + 1, start - acc["at"]), F.repeat(F.lit(" "), F.greatest(x["end"] - start, F.lit(0))))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.concat(acc["out"], F.array(piece)).alias("out"))

    return _rewritten(text, spans, step)


def redact(text: Column, spans: Column, mark: str = "<SECRET>") -> Column:
    """``text`` with each of ``spans`` replaced by ``mark``; overlapping spans become one mark."""
    def step(acc: Column, x: Column) -> Column:
        piece = F.when(x["start"] >= acc["at"], F.concat(F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit(mark))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.concat(acc["out"], F.array(piece)).alias("out"))

    return _rewritten(text, spans, step)


def _rewritten(text: Column, spans: Column, step) -> Column:
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    done = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, done)).otherwise(text)


def count_kind(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def digest_columns(spans: Column, kinds: list[str]) -> dict[str, Column]:
    name = F.array(*[F.lit(k) for k in kinds])
    joined = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", F.element_at(name, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")
    out = {f"n_{k}": count_kind(spans, i).alias(f"n_{k}") for i, k in enumerate(kinds)}
    return out | {"base_sha256": F.sha2(joined(F.filter(spans, lambda x: x["kind"] < 3)), 256), "spans": joined(spans)}
