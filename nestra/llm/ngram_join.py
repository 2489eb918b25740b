"""Exact self-join of documents whose word n-gram sets have a Jaccard similarity of at least a given one.

Sets of like size share a scheme: their universe of hashed n-grams is parted
into segments, more than similar sets can have differences, so some segments of
a similar pair are identical. A set's signatures are the hashes of its subsets
of the first segments, as many non-empty ones as its size calls for and a few to
spare (`SPARE`). A set with too few non-empty segments cannot rely on them; any
partner with which it shares none has too few as well, so only such sets also
index the one-deletion neighbourhoods of their segments, and, where even those
give no guarantee, a common mark. How many segments a scheme has is chosen by
cost: rows for sets that fall short against chance matches of small segments.

Of the sets that share signatures each is paired with one, a centre, and the
pair is verified on the whole sets. Components are formed from the links, and
signatures whose sets are in one component are done. Others get further centres.
At last, a linked pair that is still missing shares more open signatures than
either set has to spare. So each set leaves out as many as it has to spare, the
commonest ones by an order that all sets share; the pair still meets in the
rarest that it has in common. Signatures with the same sets meet as one. What is
counted by signature is saved before it is joined back, so that joins are of plain
tables and Spark splits common signatures between tasks. Where many sets still meet, as in a family of texts with some edits each, they are held
against one of them: a linked pair has many of its differences from that centre
in common, so it meets in one of the rarest of them, and sets with edits of
their own do not meet at all (`_around`). Pairs of fitting sizes are verified,
and nothing is left.

Cases: a document without words has an empty set and no links. One with fewer
words than n has one n-gram, all of its words. Equal sets are one node from the
start. Repeated rows and null doc_ids are documents of their own (a component's
name is its smallest doc_id that is not null). Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nestra.llm.common import Words, mix, saved, signed, text_bytes, text_chunks, tidied, workspace

N, PERCENT = 4, 85
#: Identical segments beyond the first that a set's signatures allow for, and so many more for each ten differences.
SPARE, EACH_TEN = 2, 1
#: Rounds of centres before the exact rest.
ROUNDS = 2
#: The largest group of sets of a signature whose pairs meet directly; larger ones meet around a centre.
DIRECT = 16
#: Texts of the sample that shows which signatures are common; one is with so many of them at least, and as a share of the
#: sample. Common ones, at most one in COMMON_LEAST of the sample's signatures, are dealt to so many tasks each.
COMMON_SAMPLE, COMMON_LEAST, COMMON_SHARE, COMMON_PARTS = 20_000, 64, 1 / 256, 64
#: Sets that a task remembers, to leave out copies; more begin anew.
REMEMBERED = 1 << 16
#: How often sets without possible partners are left out before the elements of the others are joined.
PRUNE_ROUNDS = 2
_GOLDEN = 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class Scheme:
    """Sizes low to high share the segments."""

    number: int
    low: int
    high: int
    segments: int


class Schemes:
    """Size bands for a similarity in percent, and how many signatures a set needs in each."""

    def __init__(self, percent: int = PERCENT, spare: int = SPARE, each_ten: int = EACH_TEN):
        self.percent, self.spare, self.each_ten = percent, spare, each_ten
        self.edges = [1]
        self._schemes: dict[int, Scheme] = {}

    def most(self, size: int) -> int:
        """The largest size of a partner."""
        return size * 100 // self.percent

    def differences(self, total: int) -> int:
        """Most elements in which two linked sets of that total size differ."""
        return total * (100 - self.percent) // (100 + self.percent)

    def band(self, size: int) -> int:
        while self.edges[-1] <= size:
            self.edges.append(max(self.edges[-1] + 1, self.edges[-1] * 10_000 // self.percent**2))
        return int(np.searchsorted(self.edges, size, side="right")) - 1

    def of(self, number: int) -> Scheme:
        self.band(self.edges[min(number, len(self.edges) - 1)])
        while len(self.edges) <= number + 1:
            self.band(self.edges[-1])
        if number not in self._schemes:
            self._schemes[number] = self._build(number)
        return self._schemes[number]

    def _build(self, number: int) -> Scheme:
        low, high = self.edges[number], self.edges[number + 1] - 1
        need = self.need(self.differences(high + self.most(high)))

        def cost(segments: int) -> float:
            filled = low / segments
            empty = exp(-filled)
            short = exp(-max(0.0, segments * (1 - empty) - need))  # about the share of sets that fall short
            return need * (1 + 50 * exp(-filled)) + short * segments * (1 + filled)

        choices = range(need, 2 * need + 8)
        return Scheme(number, low, high, min(choices, key=cost))

    def need(self, allow: int) -> int:
        """Segments to index for a number of differences."""
        return allow + 1 + self.spare + (allow * self.each_ten // 10 if self.spare else 0)

    def to_spare(self, number: int) -> int:
        """Segments beyond the first identical one that every set with enough of them indexes in a scheme."""
        least = self.differences(2 * self.of(number).low)
        return self.need(least) - least - 1

    def uses(self, size: int) -> list[tuple[int, int]]:
        """(scheme, differences to allow for) of a set: its own, and those of smaller partners."""
        own = self.band(size)
        least = -(-size * self.percent // 100)
        return [(c, self.differences(size + (self.most(size) if c == own else self.of(c).high))) for c in range(self.band(least), own + 1)]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = N) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's word n-grams."""
    words = Words(data, offsets, lower=True)
    grams = words.grams(n)
    out = []
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        if b - a >= n:
            own = np.sort(grams[a : b - n + 1])
            keep = np.ones(len(own), bool)
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            out.append(own[keep])
        elif b > a:
            holder = Words.__new__(Words)
            holder.hashes = words.hashes[a:b]
            out.append(holder.grams(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_hash(values: np.ndarray) -> int:
    return int(mix(np.array([mix(values).sum(dtype=np.uint64) + np.uint64(len(values))], np.uint64)).view(np.int64)[0])


def signatures(sets: list[np.ndarray], schemes: Schemes) -> tuple[np.ndarray, ...]:
    """(set, signature, slack, scheme) of non-empty sets.

    slack: how many fewer than the signatures that the set shares with any partner
    in the scheme are sure. The partner may index fewer segments, those of the
    scheme's smallest sets at least.
    """
    entries = [(i, c, allow) for i, s in enumerate(sets) if len(s) for c, allow in schemes.uses(len(s))]
    if not entries:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner, number, allow = (np.array(x, np.int64) for x in zip(*entries, strict=True))
    segments = np.array([schemes.of(c).segments for c in number], np.int64)
    sizes = np.array([len(sets[i]) for i in owner], np.int64)
    tokens = np.concatenate([sets[i] for i in owner])
    entry = np.repeat(np.arange(len(owner)), sizes)
    seeds = mix(number.astype(np.uint64) * np.uint64(_GOLDEN) + np.uint64(1))
    spread = mix(tokens ^ seeds[entry])
    base = np.r_[0, np.cumsum(segments)]
    slot = base[entry] + (spread % segments[entry].astype(np.uint64)).astype(np.int64)
    value = mix(tokens + np.uint64(_GOLDEN))
    total = int(base[-1])
    count = np.bincount(slot, minlength=total)
    low = np.bincount(slot, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), total).astype(np.uint64)
    high = np.bincount(slot, (value >> np.uint64(32)).astype(np.float64), total).astype(np.uint64)
    subset = low + (high << np.uint64(32))  # the sum of a segment's values, modulo 2 ** 64
    of_slot = np.repeat(np.arange(len(owner)), segments)
    local = np.arange(total) - base[of_slot]
    filled = count > 0
    rank = np.cumsum(filled)
    before = np.r_[0, rank][base[:-1]]
    rank = rank - before[of_slot]
    need = np.array([schemes.need(int(a)) for a in allow], np.int64)
    chosen = np.flatnonzero(filled & (rank <= need[of_slot]))
    own = of_slot[chosen]
    place = lambda at: mix(local[at].astype(np.uint64) + seeds[of_slot[at]])
    sig = mix(subset[chosen] ^ place(chosen))
    n_filled = np.bincount(of_slot[filled], minlength=len(owner))
    indexed = np.minimum(n_filled, need)
    slack = np.clip(indexed - allow - 1, 0, np.array([schemes.to_spare(int(c)) for c in number], np.int64))
    all_owner, all_sig, all_slack, all_number = [owner[own]], [sig], [slack[own]], [number[own]]
    short = n_filled < allow + 1
    if short.any():
        mark = np.uint64(0x5851F42D4C957F2D)
        t = np.flatnonzero(short[entry])
        for left, at in ((subset[slot[t]] - value[t], slot[t]), (subset[slot[t]], slot[t])):  # one deletion, and none
            all_owner.append(owner[of_slot[at]])
            all_sig.append(mix((left ^ place(at)) + mark))
            all_slack.append(np.zeros(len(at), np.int64))
            all_number.append(number[of_slot[at]])
        lost = np.flatnonzero(short & (allow >= 2 * n_filled))
        all_owner.append(owner[lost])
        all_sig.append(mix(seeds[lost] ^ mark))
        all_slack.append(np.zeros(len(lost), np.int64))
        all_number.append(number[lost])
    return tuple(np.concatenate(x) for x in (all_owner, all_sig, all_slack, all_number))


def nodes_of(docs: DataFrame, n: int = N) -> DataFrame:
    """(doc_id, key, n_shingles, node) of (doc_id, text); node: the hash of the set, null if it is empty; key: that of the text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            sets = shingle_sets(*text_bytes(batch.column(0)), n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).cast(pa.int64()), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_hash(s) if len(s) else None for s in sets], pa.int64())], ["doc_id", "key", "n_shingles", "node"]
            )

    return docs.select("text", "doc_id", F.xxhash64("text").alias("key")).mapInArrow(cut, "doc_id long, key long, n_shingles long, node long")


def signature_rows(docs: DataFrame, schemes: Schemes, n: int = N) -> DataFrame:
    """(sig, node, slack, scheme) of all documents; a task leaves out sets that it remembers."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        for batch in text_chunks(batches):
            sets = shingle_sets(*text_bytes(batch.column(0)), n)
            named = {set_hash(s): s for s in sets if len(s)}
            named = {h: s for h, s in named.items() if h not in known}
            if len(known) > REMEMBERED:
                known.clear()
            known.update(named)
            owner, sig, slack, scheme = signatures(list(named.values()), schemes)
            node = np.array(list(named), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(signed(sig)), pa.array(node[owner]), pa.array(slack.astype(np.int32)), pa.array(scheme.astype(np.int32))], ["sig", "node", "slack", "scheme"])

    return docs.select("text").mapInArrow(cut, "sig long, node long, slack int, scheme int")


def common_signatures(docs: DataFrame, schemes: Schemes, n: int = N) -> DataFrame:
    """(sig) that a good share of a bounded sample has. They are only dealt out otherwise; what is found does not depend on them."""
    size = docs.count()
    share = min(1.0, COMMON_SAMPLE / max(1, size))
    sample = docs if share == 1 else docs.where(F.rand(11) < share)
    least = max(COMMON_LEAST, COMMON_SHARE * share * size)
    return saved(signature_rows(sample, schemes, n).groupBy("sig").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("sig"), "common")


def shared_signatures(docs: DataFrame, schemes: Schemes, n: int = N) -> DataFrame:
    """(sig, node, slack, scheme) of the signatures that more than one set has, and of common ones.

    All signatures are dealt once. A common one is dealt in parts, by set, and kept whole.
    """
    common = common_signatures(docs, schemes, n).withColumn("__common", F.lit(True))
    part = F.when(F.col("__common"), F.pmod(F.xxhash64("node"), F.lit(COMMON_PARTS)).cast("int")).otherwise(-1)
    dealt = signature_rows(docs, schemes, n).join(F.broadcast(common), "sig", "left").select("sig", "node", "slack", "scheme", part.alias("part"))
    own = Window.partitionBy("sig", "part")
    held = dealt.withColumn("low", F.min("node").over(own)).withColumn("high", F.max("node").over(own)).where("low < high or part >= 0")
    return held.groupBy("sig", "part", "node", "scheme").agg(F.min("slack").alias("slack")).select("sig", "node", "slack", "scheme")


def whole_sets(docs: DataFrame, wanted: DataFrame, n: int = N) -> DataFrame:
    """(node, grams) of the nodes in (node, doc_id, key), which name one document for each."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            sets = shingle_sets(*text_bytes(batch.column(0)), n)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], ["node", "grams"])

    keyed = docs.select("text", F.coalesce("doc_id", F.lit(-1)).alias("doc"), F.xxhash64("text").alias("key"))
    picked = keyed.join(wanted.select("node", F.coalesce("doc_id", F.lit(-1)).alias("doc"), "key"), ["doc", "key"]).select("text", "node")
    return picked.mapInArrow(cut, "node long, grams binary").groupBy("node").agg(F.first("grams").alias("grams"))


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")
                if min(len(x), len(y)) * 100 < percent * max(len(x), len(y)):
                    keep.append(False)
                    continue
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("grams").alias("y")), "b")
    return joined.select("a", "b", "x", "y").mapInArrow(judge, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes in the links (a, b); component: the smallest node that links reach.

    Each round takes the smallest label among neighbours and then that label's own label.
    """
    both = saved(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    label = saved(both.groupBy("a").agg(F.min("b").alias("near")).select(F.col("a").alias("node"), F.least("a", "near").alias("component")), "labels")
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lower = label.join(near, "node").select("node", F.least("component", "near").alias("next"), F.col("component").alias("was"))
        jump = label.select(F.col("node").alias("next"), F.col("component").alias("far"))
        new = saved(lower.join(jump, "next").select("node", F.least("next", "far").alias("component"), "was"), "labels")
        label = new.select("node", "component")
        tidied(links.sparkSession)
        if new.where(F.col("component") != F.col("was")).isEmpty():
            return label


def _open(candidates: DataFrame, labels: DataFrame) -> DataFrame:
    """(sig, node, slack, scheme, component) of the signatures whose nodes are not all in one component."""
    known = candidates.join(labels, "node", "left").select("sig", "node", "slack", "scheme", F.coalesce("component", "node").alias("component"))
    mixed = known.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("sig")
    return saved(known.join(saved(mixed, "mixed"), "sig"), "open")


def _centred(rows: DataFrame) -> DataFrame:
    """(a, b): each node with the centre that most of its signatures have, of (node, centre)."""
    return rows.where("node <> centre").groupBy(F.col("node").alias("a")).agg(F.mode("centre", True).alias("b"))


def _rare(rows: DataFrame) -> DataFrame:
    """(sig, node) of (sig, node, slack, scheme): without each node's commonest signatures in each scheme, as many as it has to spare there."""
    # Signatures with the same nodes meet as one that counts for all of them.
    alike = rows.groupBy("sig", "scheme").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    kept = alike.where("n > 1").groupBy("n", "x", "y", "scheme").agg(F.min("sig").alias("sig"), F.count("*").alias("weight")).select("sig", "scheme", "weight", "n")
    own = Window.partitionBy("node", "scheme")
    common = own.orderBy(F.desc("n"), F.desc("sig")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = rows.join(kept, ["sig", "scheme"]).withColumn("least", F.min("slack").over(own)).withColumn("passed", F.sum("weight").over(common))
    return met.where("passed > least").select("sig", "node")


def _deltas(met: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, centre, size, its, apart, delta) of (node, centre): sizes of both sets, and the elements that only one of them has."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, its, delta = [], [], []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")
                size.append(len(x))
                its.append(len(y))
                delta.append(signed(np.setxor1d(x, y, assume_unique=True)))
            apart = [len(x) for x in delta]
            lists = pa.ListArray.from_arrays(np.r_[0, np.cumsum(apart)].astype(np.int32), np.concatenate(delta) if delta else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(its, pa.int64()), pa.array(apart, pa.int64()), lists], ["node", "centre", "size", "its", "apart", "delta"])

    joined = met.join(sets.select("node", F.col("grams").alias("x")), "node").join(sets.select(F.col("node").alias("centre"), F.col("grams").alias("y")), "centre")
    return joined.select("node", "centre", "x", "y").mapInArrow(cut, "node long, centre long, size long, its long, apart long, delta array<long>")


def _homes(crowd: DataFrame) -> DataFrame:
    """(node, centre) of the crowded signatures in (sig, node): for each signature of a set the centre that all its sets are held against.

    A signature's first centre is the set with most signatures. Twice, each set takes the centre that most of its
    signatures have, and each signature the one that most of its sets have, so that nearly all of a family agree on one.
    """
    weight = crowd.groupBy("node").agg(F.count("*").alias("weight"))
    centre = saved(crowd.join(weight, "node").groupBy("sig").agg(F.max(F.struct("weight", "node")).alias("x")).select("sig", F.col("x.node").alias("centre")), "centres")
    for _ in range(2):
        home = crowd.join(centre, "sig").groupBy("node").agg(F.mode("centre", True).alias("centre"))
        centre = saved(crowd.join(home, "node").groupBy("sig").agg(F.mode("centre", True).alias("centre")), "centres")
    return saved(crowd.join(centre, "sig").select("node", "centre").where("node <> centre").distinct(), "met")


def _around(crowd: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(links (a, b) of sets with their centres, pairs (a, b) that may be linked) of the crowded signatures in (sig, node).

    Sets x and y that meet in a signature are held against its centre c, any set. With
    D(x) for the elements that only one of x and c has, and
    excess(x) = (100 + percent) |D(x)| - (100 - percent) |x|, they are linked if and
    only if 2 (100 + percent) |D(x) & D(y)| >= excess(x) + excess(y). If the right
    side is not above 0, both are linked with c. Else D(x) and D(y) share so many
    elements that, in one order of all, x has one of them among its first
    |D(x)| - least + 1. Elements of sets near c alone stand first, then rare ones;
    y's excess is known by bucket. A set of whose elements too few are shared with
    any other set is left out before that, as it has no partner.
    """
    more, less = 100 + percent, 100 - percent
    excess = more * F.col("apart") - less * F.col("size")
    deltas = saved(_deltas(_homes(crowd), sets).withColumn("excess", excess).withColumn("wide", F.greatest(F.lit(1), F.floor(less * F.col("its") / 4))), "deltas")
    near = deltas.where(F.col("excess") <= less * F.col("its")).select(F.col("node").alias("a"), F.col("centre").alias("b"))
    # The least excess that a partner can have: with less, both are near the centre, or their sizes do not fit.
    floor = F.greatest(1 - F.col("excess"), F.col("excess") - F.floor(2 * less * F.col("size") * 100 / percent) - 1)
    far = F.col("excess") > less * F.col("its")
    for _ in range(PRUNE_ROUNDS):
        # Two sets near the centre are linked through it, so only elements that a set far from it has can matter to either.
        tokens = deltas.select("node", "centre", far.alias("far"), F.explode("delta").alias("token"))
        counts = tokens.groupBy("centre", "token").agg(F.count("*").alias("n"), F.max("far").alias("any"), F.min("node").alias("node"))
        lone = counts.where("n = 1").groupBy("node", "centre").agg(F.count("*").alias("lone"))
        left = deltas.join(lone, ["node", "centre"], "left").withColumn("lone", F.coalesce("lone", F.lit(0)))
        deltas = saved(left.where(2 * more * (F.col("apart") - F.col("lone")) - F.col("excess") >= floor).drop("lone"), "deltas")
    tokens = deltas.select("node", "centre", far.alias("far"), F.explode("delta").alias("token"))
    shared = tokens.groupBy("centre", "token").agg(F.count("*").alias("n"), F.max("far").alias("any")).where("n > 1 and any").drop("any")
    # The other elements come first in the order and meet nothing, so only their number counts.
    order = Window.partitionBy("node", "centre").orderBy("n", "token")
    ranked = tokens.join(shared, ["centre", "token"]).withColumn("rank", F.row_number().over(order)).withColumn("alike", F.count("*").over(Window.partitionBy("node", "centre")))
    about = deltas.drop("delta").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = ranked.select("node", "centre", "token", (F.col("alike") - F.col("rank")).alias("after")).join(about, ["node", "centre"])
    bucket = lambda x: F.floor(x / F.col("wide")).cast("long")
    # The place of the element bounds the other set's excess; and excesses of a linked pair are not far apart.
    low = bucket(floor)
    high = bucket(F.least(2 * more * (F.col("after") + 1) - F.col("excess"), F.col("excess") + 2 * less * F.col("size")))
    rows = placed.select("node", "centre", "token", "size", "component", bucket(F.col("excess")).alias("own"), low.alias("low"), high.alias("high")).where("low <= high")
    rows = saved(rows.withColumn("other", F.explode(F.sequence("low", "high"))).drop("low", "high"), "placed")
    x, y = rows.where("own <= other").alias("x"), rows.where("own >= other").alias("y")
    fits = (F.col("x.centre") == F.col("y.centre")) & (F.col("x.token") == F.col("y.token")) & (F.col("x.own") == F.col("y.other")) & (F.col("x.other") == F.col("y.own"))
    fits &= ((F.col("x.own") < F.col("y.own")) | (F.col("x.node") < F.col("y.node"))) & (F.col("x.component") != F.col("y.component"))
    fits &= 100 * F.least("x.size", "y.size") >= percent * F.greatest("x.size", "y.size")
    return near, x.join(y, fits).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))


def _rest(left: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) that may be linked and are not in one component, from the open signatures; or links that join those."""
    rows = saved(_rare(left.select("sig", "node", "slack", "scheme")), "rare")
    many = saved(rows.groupBy("sig").agg(F.count("*").alias("n")).where(F.col("n") > DIRECT).select("sig"), "many")
    near, far = _around(saved(rows.join(many, "sig"), "crowd"), labels, sets, percent)
    sizes = sets.select("node", (F.length("grams") / 8).cast("long").alias("size"))
    rows = rows.join(many, "sig", "left_anti").join(sizes, "node").join(labels, "node", "left").select("sig", "node", "size", F.coalesce("component", "node").alias("component"))
    rows = saved(rows, "rest")
    x, y = rows.alias("x"), rows.alias("y")
    fits = (F.col("x.sig") == F.col("y.sig")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.component") != F.col("y.component"))
    fits &= 100 * F.least("x.size", "y.size") >= percent * F.greatest("x.size", "y.size")
    return x.join(y, fits).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).unionByName(near).unionByName(far).distinct()


def _centres(left: DataFrame) -> DataFrame:
    """(a, b): nodes of the open signatures, each with a node of another component that shares more with others than most."""
    crowd = saved(left.groupBy("sig").agg(F.count("*").alias("n")), "crowds")
    weight = left.join(crowd, "sig").groupBy("node").agg(F.sum(F.log2("n")).alias("weight"))
    centre = saved(left.join(weight, "node").groupBy("sig").agg(F.max(F.struct("weight", "node", "component")).alias("x")).select("sig", F.col("x.node").alias("centre"), F.col("x.component").alias("its")), "centres")
    return _centred(left.join(centre, "sig").where(F.col("component") != F.col("its")))


def linked_nodes(docs: DataFrame, nodes: DataFrame, n: int = N, percent: int = PERCENT, spare: int = SPARE, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """((node, component), links (a, b)): all components of linked nodes, and the verified links that form them."""
    schemes = Schemes(percent, spare)
    candidates = saved(shared_signatures(docs, schemes, n), "candidates")
    shared = candidates.groupBy("sig").agg(F.min("node").alias("centre"), F.max("node").alias("top")).where("centre < top").select("sig", "centre")
    pairs = _centred(candidates.join(saved(shared, "shared"), "sig"))
    named = nodes.where(F.col("node").isNotNull()).groupBy("node").agg(F.min(F.struct("doc_id", "key")).alias("x")).select("node", "x.*")
    wanted = named.join(candidates.select("node").distinct(), "node", "left_semi")
    sets = saved(whole_sets(docs, wanted, n), "sets")
    links = saved(verified(pairs, sets, percent), "verified")
    labels = components(links)
    for number in range(rounds):
        left = _open(candidates, labels)
        tidied(docs.sparkSession)
        if left.isEmpty():
            return labels, links
        if number + 1 < rounds:
            pairs = _centres(left)
        else:
            pairs = _rest(left, labels, sets, percent)
        more = saved(verified(pairs, sets, percent), "verified")
        tidied(docs.sparkSession)
        if not more.isEmpty():
            links = links.unionByName(more)
            labels = components(links)
    return labels, links


def join_similar(docs: DataFrame, n: int = N, percent: int = PERCENT, spare: int = SPARE, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_spanning_links) of (doc_id, text).

    component_id: the smallest doc_id reachable by links. n_spanning_links:
    those links of the document's set to other sets that were verified to form the
    component; pairs within one component are not tested, so it is not their number.
    """
    docs = docs.select("doc_id", "text")
    nodes = saved(nodes_of(docs, n), "nodes")
    labels, links = linked_nodes(docs, nodes, n, percent, spare, rounds)
    ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("n_spanning_links"))
    first = nodes.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("first"))
    named = first.join(labels, "node", "left").select("node", "first", F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    place = named.join(least, "component").join(ends, "node", "left").select("node", "component_id", F.coalesce("n_spanning_links", F.lit(0)).alias("n_spanning_links"))
    return nodes.join(place, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_spanning_links", F.lit(0)).alias("n_spanning_links"))


def keep_one(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """One row of each component, with the smallest doc_id and a null one last, and all documents without words."""
    rows = docs.withColumn("__row", F.xxhash64("doc_id", "text"))
    with workspace(docs.sparkSession) as keep:
        joined = join_similar(rows.select(F.col("__row").alias("doc_id"), "text"), n, percent)
        found = keep(joined.select(F.col("doc_id").alias("__row"), "component_id", (F.col("n_shingles") > 0).alias("__words")).distinct(), "rows")
    tidied(docs.sparkSession)
    named = found.join(rows.select("__row", "doc_id").distinct(), "__row")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row", "__words")).alias("x")).select("x.__row", "x.__words")
    kept = rows.join(first, "__row").withColumn("__copy", F.when(~F.col("__words"), F.monotonically_increasing_id()))
    return kept.dropDuplicates(["__row", "__copy"]).select(docs.columns)
