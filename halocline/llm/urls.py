"""URL filter: longest matching rule, else a Bloom filter cascade over the corpus's hosts.

DataFrame functions only. The cascade encodes ``listed`` keys: level 0 holds them, level 1 the keys of the corpus
that level 0 takes for listed, level 2 the listed keys that level 1 takes for those, and so on until a level errs
on no key. As the key universe is known (all host suffixes of the corpus), the answer is exact and a url is judged
from a few bits, without a join. A level's bits stand once in the plan.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halocline.llm.workspace import Workspace

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Rule:
    """``host`` and its subdomains, for paths that start with ``path``; verdict allow or block."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def suffixes(host: Column) -> Column:
    """The host and its parent domains: a.b.c, b.c, c."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else null; of equal length, the longer host, then the first by name."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), len(r.host), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def shift(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int"))


@dataclass
class Level:
    words: Column  # array<long>, a constant that the optimizer folds
    bits: int
    hashes: int
    level: int

    def positions(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(self.level), F.lit(i)), F.lit(self.bits)) for i in range(self.hashes)]

    def holds(self, key: Column) -> Column:
        def all_set(words: Column) -> Column:
            held = F.lit(True)
            for at in self.positions(key):
                word = F.element_at(words, (F.floor(at / 64) + 1).cast("int"))
                held = held & (word.bitwiseAND(shift(at % 64)) != 0)
            return held

        return F.exists(F.array(self.words), all_set)  # a list of one: all hashes look into the same words


class BloomCascade:
    """Exact membership of ``listed`` among the keys of ``universe`` (both: column key, distinct, not null).

    ``max_bits`` bounds what a level brings to the driver and sends with the plan; a longer list raises ValueError
    before anything is sent. ``bits_per_key`` is for the listed keys; later levels, which have few keys, take half.
    """

    def __init__(self, universe: DataFrame, listed: DataFrame, work: Workspace, bits_per_key: int = 10, max_bits: int = 1 << 25):
        self.levels: list[Level] = []
        self.false_positives: list[int] = []
        inside, outside = listed, universe.join(listed, "key", "left_anti")
        n = inside.count()
        while n:
            level = len(self.levels)
            per_key = bits_per_key if level == 0 else max(4, bits_per_key // 2)
            bits = max(64, math.ceil(n * per_key / 64) * 64)
            if bits > max_bits:
                raise ValueError(f"{n} keys need {bits} bits, more than max_bits, {max_bits}")
            self.levels.append(self._encode(inside, Level(F.lit(None), bits, max(1, round(per_key * math.log(2))), level)))
            # the keys that this level takes for its own are the next level's
            inside, outside = work.write(outside.filter(self.levels[-1].holds(F.col("key"))), f"level{level}"), inside
            n = inside.count()
            self.false_positives.append(n)

    @staticmethod
    def _encode(keys: DataFrame, level: Level) -> Level:
        words = (
            keys.select(F.explode(F.array(*level.positions(F.col("key")))).alias("at"))
            .groupBy(F.floor(F.col("at") / 64).alias("i"))
            .agg(F.bit_or(shift(F.col("at") % 64)).alias("word"))
        )
        every = [0] * (level.bits // 64)
        for r in words.collect():  # at most bits / 64 rows
            every[r["i"]] = r["word"]
        level.words = F.from_json(F.lit("[" + ",".join(map(str, every)) + "]"), "array<bigint>")
        return level

    def listed(self, key: Column) -> Column:
        """Whether ``key``, one of the universe, is listed: found at an even number of levels' ends."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels) - 1, -1, -1):
            answer = F.when(~self.levels[i].holds(key), F.lit(i % 2 == 1)).otherwise(answer)
        return answer


def judge_urls(pages: DataFrame, rules: list[Rule], listed: DataFrame, url: str = "url", max_bits: int = 1 << 25) -> DataFrame:
    """Adds host, path, rule, verdict and listed_host to every row of ``pages``.

    A url that no rule fits is blocked if its host or a parent domain is among the keys of ``listed`` (column key).
    A url that is null or has no ``://`` has an empty host and path and is allowed. Repeated rows stay, each judged
    alike; repeated or null keys of ``listed`` count once or not. Urls are read whole, whatever their length. Columns
    of these names in ``pages`` are replaced. An empty ``listed`` allows all that no rule blocks; empty ``pages`` give
    no rows. Keys that the corpus has no host for take no bits. If the others need more than ``max_bits`` (3 million
    keys at 10 bits), a ValueError says so: the caller sets a bound that the plan may carry.
    """
    work = Workspace(pages.sparkSession, "urls")
    own = ["host", "path", "rule", "verdict", "listed_host"]
    host, path = host_of(F.col(url)), path_of(F.col(url))
    with_host = pages.drop(*[c for c in own if c != url]).withColumns({"host": host, "path": path})
    hosts = pages.select(host.alias("host")).distinct()
    universe = work.write(hosts.select(F.explode(suffixes(F.col("host"))).alias("key")).distinct(), "universe")
    keys = universe.join(listed.select("key").filter(F.col("key").isNotNull()).distinct(), "key", "left_semi")
    cascade = BloomCascade(universe, work.write(keys, "listed"), work, max_bits=max_bits)
    work.keep()
    found = with_host.withColumn("listed_host", F.exists(suffixes(F.col("host")), cascade.listed) if cascade.levels else F.lit(False))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return found.withColumns({"rule": rule, "verdict": F.coalesce(verdict, F.when(F.col("listed_host"), "block").otherwise("allow"))})
