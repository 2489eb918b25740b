"""URL filters: host and path rules, then a blocked Bloom filter before an exact hash join.

DataFrame functions only. The filter has a fixed greatest size, so broadcasting
it is safe at any size of the list. Pages that it does not pass are judged where
they are; only possible hits are dealt to the exact join, which removes what was
wrongly passed. The list is saved once and read three times.

Cases: a null url, or one without `://`, has an empty host and path, fits no
rule, has a null canonical form and is allowed. Repeated pages each get their
row; repeated list entries count once. Columns of the pages other than the id
and the url are not read, so clashing names do no harm. An empty list blocks
nothing.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nestra.llm.common import saved

UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """A verdict for a host, its subdomains and all paths that start with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the registered query.
RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)
#: Publishers of the registered query: pages whose footer credits one of them make up its list.
PUBLISHERS = ("spam-farm", "cheap-pills", "casino-win", "free-bets")


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; both empty for null or without `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + F.lit(3))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, SMALL)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """Host without `www.` or `m.`, and path without `.html` and closing slashes; null without a host."""
    short = F.regexp_replace(host, r"^(www|m)\.", "")
    return F.when(host != "", F.concat(short, F.regexp_replace(F.regexp_replace(path, r"\.html$", ""), "/+$", "")))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits, else nulls."""
    name = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):  # the longest is tried first, as the outermost
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name, verdict = F.when(fits, rule.name).otherwise(name), F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


@dataclass(frozen=True)
class BlockedBloom:
    """A Bloom filter in blocks of 512 bits: a key sets one bit in each of the 8 words of one block.

    `blocks` has a row (block, w0 .. w7) for each block in use: at most
    `max_blocks` rows of 72 bytes, whatever the size of the list.
    """

    blocks: DataFrame
    n_blocks: int

    @staticmethod
    def _slots(key: Column, n_blocks: int) -> tuple[Column, list[Column]]:
        block = F.pmod(F.xxhash64(key), F.lit(n_blocks)).cast("int")
        bits = F.xxhash64(key, F.lit("bits"))
        return block, [F.shiftright(bits, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(8)]

    @classmethod
    def build(cls, listed: DataFrame, key: str, max_blocks: int = 1 << 16, keys_per_block: int = 32) -> BlockedBloom:
        """From the distinct keys of `listed`; a count of them sets the number of blocks, up to max_blocks (5 MB)."""
        n = listed.count()
        n_blocks = min(max_blocks, max(1, 1 << max(0, -(-n // keys_per_block) - 1).bit_length()))
        block, bits = cls._slots(F.col(key), n_blocks)
        words = [F.expr(f"shiftleft(1L, b{i})") for i in range(8)]
        rows = listed.select(block.alias("block"), *[b.alias(f"b{i}") for i, b in enumerate(bits)])
        return cls(rows.groupBy("block").agg(*[F.bit_or(w).alias(f"w{i}") for i, w in enumerate(words)]), n_blocks)

    def tested(self, df: DataFrame, key: str, name: str) -> DataFrame:
        """df with a boolean: whether the key may be in the list. It is so for all that are, and few others; false for a null key."""
        block, bits = self._slots(F.col(key), self.n_blocks)
        rows = self.blocks.select(F.col("block").alias("__block"), *[F.col(f"w{i}").alias(f"__w{i}") for i in range(8)])
        joined = df.join(F.broadcast(rows), block == F.col("__block"), "left")
        passed = reduce(and_, [F.getbit(F.col(f"__w{i}"), bit) == 1 for i, bit in enumerate(bits)], F.col(key).isNotNull())
        return joined.select(*df.columns, F.coalesce(passed, F.lit(False)).alias(name))


def listed_urls(pages: DataFrame, publishers: tuple[str, ...] = PUBLISHERS) -> DataFrame:
    """Distinct canonical urls of the pages (url, html) whose footer credits a host with one of the publishers as a label: (canonical)."""
    host, path = parts(F.col("url"))
    credit = F.regexp_extract("html", r"<footer>&copy; ([^ <]*)", 1)
    named = F.arrays_overlap(F.split(credit, r"\."), F.array(*[F.lit(x) for x in publishers]))
    return pages.where(named).select(canonical(host, path).alias("canonical")).where(F.col("canonical").isNotNull()).distinct()


def filter_urls(pages: DataFrame, listed: DataFrame, rules: tuple[Rule, ...] = RULES, bloom: BlockedBloom | None = None) -> DataFrame:
    """Each page's host, path, rule and verdict.

    pages: (page_id, url); listed: (canonical), distinct. A rule's verdict goes
    first; without one, a page whose canonical url is listed is blocked.
    """
    host, path = parts(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = parsed.select("page_id", "host", "path", name.alias("rule"), verdict.alias("by_rule"), canonical(F.col("host"), F.col("path")).alias("canonical"))
    listed = saved(listed.select("canonical"), "listed")
    bloom = bloom or BlockedBloom.build(listed, "canonical")
    tested = bloom.tested(judged, "canonical", "possible")
    # Pages that a rule judges, or without a canonical form, need no look-up.
    asked = F.col("possible") & F.col("by_rule").isNull()
    hits = tested.where(asked).join(listed.withColumn("hit", F.lit(True)), "canonical", "left")
    both = hits.unionByName(tested.where(~asked).withColumn("hit", F.lit(None).cast("boolean")))
    return both.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("hit"), "block").otherwise("allow")).alias("verdict"), F.coalesce("hit", F.lit(False)).alias("listed"))
