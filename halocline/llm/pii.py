"""Personal data: regular expressions propose spans, checksums confirm them, words nearby adjust the score.

The scan of one text is a small helper inside a pandas UDF; Spark deals the rows out, and nothing is shuffled.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ["email", "ip", "card", "phone", "iban"]
BASE = 4  # the first so many kinds are the base

# The base patterns. A digit run that fails at its first digit fails at all: the look-behind spares those.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# An IBAN and what may follow it, with or without spaces between its characters; 15 to 34 of them.
IBAN = re.compile(r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Z0-9])")
#: Characters of an IBAN by country.
IBAN_LENGTH = {c: n for n, codes in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}.items() for c in codes.split()}

#: Score of a span without context; context words that raise it, and words that lower it, each by STEP.
PRIOR = {"email": 0.8, "ip": 0.5, "card": 0.6, "phone": 0.5, "iban": 0.8}
RAISE = {
    "email": ["mail", "email", "contact"],
    "ip": ["ip", "address", "server", "host"],
    "card": ["card", "visa", "credit", "payment"],
    "phone": ["phone", "telephone", "tel", "call", "mobile", "fax"],
    "iban": ["iban", "account", "bank", "transfer"],
}
LOWER = ["example", "version", "isbn", "order", "serial"]
STEP, CONTEXT = 0.2, 40
RAISING = {kind: re.compile(rf"\b(?:{'|'.join(words)})\b", re.ASCII) for kind, words in RAISE.items()}
LOWERING = re.compile(rf"\b(?:{'|'.join(LOWER)})\b", re.ASCII)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    rest = 0
    for c in iban[4:] + iban[:4]:
        rest = (rest * 10 + ord(c) - 48 if c.isdigit() else rest * 100 + ord(c) - 55) % 97
    return rest == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str):
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def _ips(text: str):
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            yield m.span()


def _cards(text: str):
    for m in CARD.finditer(text):
        if 13 <= len(m[0]) and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            yield m.span()


def _phones(text: str):
    for m in PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            yield m.span()


def _iban_end(run: str) -> int:
    """Where the IBAN that begins ``run`` ends, 0 if none does: at a word's end, after as many characters as its country
    has; of an unknown country at the last word's end that the checksum confirms."""
    ends = [i for i in range(15, len(run) + 1) if i == len(run) or run[i] == " "]
    for end in reversed(ends):
        iban = run[:end].replace(" ", "")
        if 15 <= len(iban) == IBAN_LENGTH.get(iban[:2], len(iban)) and mod97(iban):
            return end
    return 0


def _ibans(text: str):
    at = 0
    while m := IBAN.search(text, at):
        end = _iban_end(m[0])
        if end:
            yield m.start(), m.start() + end
        at = m.start() + (end or 1)


FIND = {"email": _emails, "ip": _ips, "card": _cards, "phone": _phones, "iban": _ibans}


def score(kind: str, text: str, start: int, end: int) -> float:
    """Prior of the kind, changed by the whole words within CONTEXT characters."""
    near = (text[max(0, start - CONTEXT) : start] + "\n" + text[end : end + CONTEXT]).lower()
    up, down = bool(RAISING[kind].search(near)), bool(LOWERING.search(near))
    return round(min(1.0, max(0.0, PRIOR[kind] + STEP * up - STEP * down)), 2)


def scan(text: str) -> list[dict]:
    out = []
    for k, kind in enumerate(KINDS):
        for start, end in FIND[kind](text):
            out.append({"kind": k, "start": start, "end": end, "match": text[start:end], "score": score(kind, text, start, end)})
    return out


SPANS = T.ArrayType(T.StructType([
    T.StructField("kind", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
    T.StructField("match", T.StringType()), T.StructField("score", T.DoubleType()),
]))


@F.pandas_udf(SPANS)
def pii_spans(text: pd.Series) -> pd.Series:
    return pd.Series([scan(t or "") for t in text], dtype=object)


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``pii_spans``, array<struct<kind, start, end, match, score>> sorted by kind, then start, to every row.

    kind is an index of KINDS; positions are code points, end exclusive. A null text is as an empty one: no spans.
    Whole texts are scanned; repeated rows stay, each scanned alike; spans of two kinds that start together both stay.
    An empty table gives no rows. A column named pii_spans is replaced. Python gets texts in batches that Spark bounds
    by spark.sql.execution.arrow.maxBytesPerBatch.
    """
    return docs.withColumn("pii_spans", pii_spans(F.col(text)))


def mask(text: Column, spans: Column, least: float = 0.5) -> Column:
    """``text`` with the spans of a score of ``least`` or more replaced by <KIND>; overlapping spans become one mark."""
    chosen = F.array_sort(F.transform(F.filter(spans, lambda x: x["score"] >= least), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))))
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])

    def step(acc: Column, x: Column) -> Column:
        piece = F.when(x["start"] >= acc["at"], F.concat(F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.element_at(names, x["kind"] + 1))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.concat(acc["out"], piece).alias("out"))

    done = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
    return F.when(F.size(chosen) > 0, F.aggregate(chosen, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, done)).otherwise(text)
