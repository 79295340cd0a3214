"""URL filtering by a Bloom filter cascade (DataFrame functions only).

Level 1 encodes the listed domains; level 2 the keys of the corpus that level 1 lets through wrongly; level 3 the listed keys that level 2 lets through, and so
on until a level lets nothing through wrongly. Over the complete universe of keys in the corpus the answer is exact, and asking it needs no join:
every level is a literal of bounded size in the plan.

Keys are the domain suffixes of a host with at most as many labels as the longest listed domain.

Defined results: a null url, or one without ://, has an empty host and path, fits no rule and is allowed; repeated rows get equal results; an
empty table gives an empty table; other columns do not matter.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from math import ceil, log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import small_or_not, stored

#: Production parameters: (verdict, host, path) of the path rules, and the listed domains.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
BLOCKED = tuple(f"{name}.example.{tld}" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for tld in ("com", "net", "org"))
#: Bits for each key of a level: few, as the next levels mend what they let through. The most bits that a level may have to be a literal of a plan (8 MB), enough for 13 million listed keys.
BITS_PER_KEY, MOST_BITS = 5, 1 << 26

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; both null if none fits."""
    rule = verdict = F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def keys_of(host: Column, labels: int) -> Column:
    """The domain suffixes of a host, without user and port, of up to so many labels."""
    bare = F.regexp_replace(host, r"^[\s\S]*@|:[0-9]*$", "")
    parts = F.slice(F.reverse(F.split(bare, r"\.")), 1, labels)
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.reverse(F.slice(parts, 1, n)), ".")))


@dataclass(frozen=True)
class Level:
    number: int
    bits: int
    hashes: int
    words: tuple[int, ...]

    def positions(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(self.number * 64 + i)), F.lit(self.bits)) for i in range(self.hashes)]

    def has(self, key: Column) -> Column:
        """Whether the filter lets key through. The words are a literal that the optimizer folds."""
        words = F.from_json(F.lit(json.dumps(self.words)), "array<bigint>")
        found = F.lit(True)
        for p in self.positions(key):
            found = found & (F.getbit(F.get(words, F.shiftright(p, 6).cast("int")), (p % 64).cast("int")) == 1)
        return found


def build_level(number: int, keys: DataFrame, count: int) -> Level:
    """keys: one string column, key. The bits are set by a map-side bitwise-or; the driver gets the words of the filter, bounded by MOST_BITS."""
    bits = 64 * max(1, ceil(count * BITS_PER_KEY / 64))
    if bits > MOST_BITS:
        raise OverflowError(f"a level of {bits} bits is over the bound of {MOST_BITS}")
    empty = Level(number, bits, max(1, round(BITS_PER_KEY * log(2))), ())
    rows = keys.select(F.explode(F.array(*empty.positions(F.col("key")))).alias("p")).groupBy(F.shiftright("p", 6).alias("i"))
    found = dict(rows.agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("w")).collect())
    return Level(number, bits, empty.hashes, tuple(found.get(i, 0) for i in range(bits // 64)))


def build_cascade(listed: DataFrame, universe: DataFrame) -> list[Level]:
    """listed, universe: one string column, key, without repeats. Raises OverflowError if a level is over its bound."""
    inside, outside, levels = listed, stored(universe.join(small_or_not(listed), "key", "left_anti"), "url-keys"), []
    count = inside.count()
    while count:
        levels.append(build_level(len(levels) + 1, inside, count))
        passed = stored(outside.where(levels[-1].has(F.col("key"))), "url-passed")
        inside, outside, count = passed, inside, passed.count()
    return levels


def member(levels: list[Level], key: Column) -> Column:
    """Whether key is listed, for a key of the universe: the first level that stops it tells."""
    answer = F.lit(len(levels) % 2 == 1)
    for level in reversed(levels):
        answer = F.when(level.has(key), answer).otherwise(F.lit(level.number % 2 == 0))
    return answer


def _listed_frame(spark: SparkSession, listed) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in sorted(set(listed))]).cast("array<string>")).alias("key"))


def judge_urls(pages: DataFrame, listed=BLOCKED, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict of each row of pages (page_id, url). listed: domains, or a table of them with the column key.

    Listed domains beyond the literal bound are looked up by a shuffled semi-join instead, with the same result.
    """
    table = listed.select("key").where("key is not null").distinct() if isinstance(listed, DataFrame) else _listed_frame(pages.sparkSession, listed)
    labels = table.agg(F.max(F.size(F.split("key", r"\.")))).first()[0] or 1
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    keys = keys_of(F.col("host"), labels)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    universe = rows.select("host").distinct().select(F.explode(keys).alias("key")).distinct()
    try:
        levels = build_cascade(table, universe)
        blocked = F.exists(keys, lambda k: member(levels, k))
    except OverflowError:
        hit = rows.select("host").distinct().select("host", F.explode(keys).alias("key")).join(table, "key", "left_semi").select(F.col("host").alias("h")).distinct()
        rows = rows.join(hit, F.col("host") == F.col("h"), "left")
        blocked = F.col("h").isNotNull()
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(blocked, "block").otherwise("allow")).alias("verdict"))
