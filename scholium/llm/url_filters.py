"""URL filters: prefix rules, then exact list membership by a cascade of Bloom filters.

Everything runs in DataFrame functions. The first filter holds the listed keys; keys of
the corpus that it takes in by mistake go into the second; listed keys that the second
takes in go into the third; and so on until a filter makes no mistake. As every key of
the corpus has been tried while building, walking the levels gives exact membership for
each of them, without a join with the list.

Keys are dealt to blocks by hash, and each block has a cascade of its own: a row of a
table with one small array of words for each level. So nothing grows with the list but
the number of rows, no filter passes through the driver, and a page needs the one row of
its block, which Catalyst broadcasts while the table is small.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholium.llm.common import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules as (verdict, host, path prefix).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Listed keys of a block, about.
BLOCK = 4096
#: The registered query lists hosts whose MD5 begins with one of these digits, a quarter of all.
LISTED_DIGITS = "0123"


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next /, ? or #, with A-Z lower-cased; else ''."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ? or #; '' if there is no ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_column(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule (host and path together) that fits, else NULL.

    A rule fits its host and all subdomains if the path starts with the rule's. Equal
    lengths: the rule that sorts first. Rules are looked up by the last labels of the
    host, as many as rules have, so their number doesn't matter much.
    """
    if not rules:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    by_host: dict[str, list] = {}
    for verdict, h, p in rules:
        by_host.setdefault(h, []).append(F.struct(F.lit(p).alias("path"), F.lit(-len(h + p)).alias("order"), F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict")))
    table = F.map_from_entries(F.array(*[F.struct(F.lit(h), F.array(*found)) for h, found in by_host.items()]))
    labels = F.split(host, r"\.")
    ends = F.array(*[
        F.when(F.size(labels) >= n, F.array_join(F.slice(labels, -n, n), ".")) for n in sorted({h.count(".") + 1 for h in by_host})
    ])
    found = F.flatten(F.transform(F.filter(ends, lambda x: F.map_contains_key(table, x)), lambda x: F.element_at(table, x)))
    fits = F.array_min(F.transform(F.filter(found, lambda x: F.startswith(path, x["path"])), lambda x: F.struct(x["order"], x["rule"], x["verdict"])))
    return F.when(fits.isNotNull(), F.struct(fits["rule"].alias("rule"), fits["verdict"].alias("verdict")))


def shape(inside: int, outside: int, level: int) -> tuple[float, int]:
    """Bits for each key and hashes of a level that holds ``inside`` keys and is asked for ``outside`` others.

    All levels together are smallest if the first lets through as many keys as it holds,
    over the root of two, and each later one about half of what it is asked for.
    """
    if level:
        return 1.5 + level / 16, 1  # a little more from level to level, so that every cascade ends
    bits = max(1.5, 1.44 * math.log2(1.41 * max(outside, 1) / inside))
    return bits, max(1, round(0.69 * bits))


def _has(words: Column, key: Column, level: int, hashes: int) -> Column:
    """Whether a level's words, 64 bits each and the least significant first, have all bits of a key; NULL has none."""
    bits = F.size(words) * 64
    hit = F.size(words) > 0
    for at in _places(key, bits, level, hashes):
        hit = hit & (F.getbit(F.get(words, F.shiftright(at, 6).cast("int")), F.pmod(at, F.lit(64)).cast("int")) == 1)
    return F.coalesce(hit, F.lit(False))


def _places(key: Column, bits: Column, level: int, hashes: int) -> list[Column]:
    """The bits of a key by double hashing; levels hash independently."""
    a, b = F.xxhash64(F.lit(2 * level), key), F.xxhash64(F.lit(2 * level + 1), key)
    return [F.pmod(F.pmod(a, bits) + i * F.pmod(b, bits), bits) for i in range(hashes)]


class Cascade:
    """Filters by block: a table (block, l0, l1, ...) with the words of each level, and how to read it."""

    def __init__(self, table: DataFrame, blocks: int, hashes: list[int]):
        self.table, self.blocks, self.hashes = table, blocks, hashes

    def block(self, key: Column) -> Column:
        return _block(key, self.blocks)

    def member(self, key: Column) -> Column:
        """Whether a key of the universe is listed, beside the row of its block: the number of levels passed is odd."""
        out = F.lit(len(self.hashes) % 2 == 1)
        for i in range(len(self.hashes) - 1, -1, -1):
            out = F.when(_has(F.col(f"l{i}"), key, i, self.hashes[i]), out).otherwise(F.lit(i % 2 == 1))
        return out

    def marked(self, rows: DataFrame, key: str, name: str) -> DataFrame:
        """rows with a column whether their key, a key of the universe, is listed; NULL is not."""
        filters = self.table.withColumnRenamed("block", "_block")
        joined = rows.join(filters, self.block(F.col(key)) == F.col("_block"), "left")
        return joined.withColumn(name, F.col(key).isNotNull() & self.member(F.col(key))).drop(*filters.columns)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(-1), key), F.lit(blocks)).cast("int")


def _level(keys: DataFrame, level: int, bits: float, hashes: int) -> DataFrame:
    """(block, words) of the filters of keys (key, block). Words are or-ed before the shuffle; a block's are one small array."""
    sizes = keys.groupBy("block").agg(F.greatest(F.lit(1), F.ceil(F.count("*") * F.lit(bits) / 64)).cast("int").alias("size"))
    at = keys.join(sizes, "block").select("block", "size", F.explode(F.array(*_places(F.col("key"), F.col("size") * 64, level, hashes))).alias("at"))
    words = at.groupBy("block", "size", F.shiftright("at", 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(at, 64) as int))")).alias("bits"))
    whole = words.groupBy("block", "size").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("m"))
    return whole.select("block", F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda i: F.coalesce(F.element_at("m", i), F.lit(0).cast("long"))).alias("words"))


def build_cascade(universe: DataFrame, listed: DataFrame, key: str = "key", block: int = BLOCK) -> Cascade:
    """The filters for exact membership of universe's keys in listed.

    Keys of either table may repeat; NULL is no key. Each level only reads what the one
    before mistook, so later levels are short. Listed keys that the corpus lacks need no place.
    """
    mine = listed.select(F.col(key).alias("key")).where("key is not null").distinct().withColumn("_in", F.lit(True))
    flagged = cut(
        universe.select(F.col(key).alias("key")).where("key is not null").distinct()
        .join(mine, "key", "left").select("key", F.col("_in").isNotNull().alias("is_listed"))
    )
    counts = {r["is_listed"]: r["count"] for r in flagged.groupBy("is_listed").count().collect()}
    n, others = counts.get(True, 0), counts.get(False, 0)
    blocks = max(1, -(-n // block))
    flagged = flagged.withColumn("block", _block(F.col("key"), blocks))
    inside, outside = flagged.where("is_listed").select("key", "block"), flagged.where("not is_listed").select("key", "block")
    table, hashes = None, []
    while n:
        bits, k = shape(n, others, len(hashes))
        level = cut(_level(inside, len(hashes), bits, k))
        hit = outside.join(level, "block").where(_has(F.col("words"), F.col("key"), len(hashes), k))
        mistaken = cut(hit.select("key", "block"))
        named = level.withColumnRenamed("words", f"l{len(hashes)}")
        table = named if table is None else table.join(named, "block", "left")
        hashes.append(k)
        n, others = mistaken.count(), n
        inside, outside = mistaken, inside
    if table is None:
        table = flagged.sparkSession.createDataFrame([], "block int")
    out = cut(table)
    return Cascade(out, blocks, hashes)


def judge(pages: DataFrame, listed: DataFrame, url: str = "url", rules=RULES, keep: list[str] | None = None) -> DataFrame:
    """host, path, rule and verdict (allow or block) of each page.

    The longest fitting rule decides; without one, pages of a listed host are blocked and
    all others allowed. NULL urls and urls without :// have an empty host and path and are
    allowed. Repeated rows stay, an empty table gives an empty result; other columns of
    the input than ``keep`` (default: page_id) aren't carried, and those travel under
    names of their own. ``listed`` has one column, host.
    """
    keep = keep or ["page_id"]
    parsed = pages.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    cascade = build_cascade(parsed.select(F.col("host").alias("key")), listed.select(F.col("host").alias("key")))
    judged = cascade.marked(parsed, "host", "listed")
    return judged.withColumn("found", rule_column(F.col("host"), F.col("path"), rules)).select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "host", "path", F.col("found.rule").alias("rule"),
        F.coalesce("found.verdict", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"),
    )


def listed_hosts(pages: DataFrame, url: str = "url", digits: str = LISTED_DIGITS) -> DataFrame:
    """A list to test with that grows with the corpus: the hosts, by a column host, that a hash picks."""
    hosts = pages.select(host_of(F.col(url)).alias("host")).where("host != ''").distinct()
    return hosts.where(F.substring(F.md5(F.col("host").cast("binary")), 1, 1).isin(*digits))
