"""Substring dedup: word sequences of a window's length that occur more than once are removed.

A sparse de Bruijn graph of words. Of the k-mers in each window the one with the
least hash is its anchor, the same wherever the window occurs. Runs of windows
with one anchor are stretches: each stretch is the path of word k-mers about
its anchor, compacted. An anchor that occurs once has no repeated window. Where
all occurrences of an anchor have the same stretch, the path does not branch and
all its windows are repeated. Anchors whose stretches differ branch (a repeat
begins or ends there): their windows are compared one by one, by two hashes of
64 bits, and joined back to their source coordinates.

So Spark counts about one row in fourteen words, and single windows only about
the ends of repeats. What is repeated is counted first and saved; joining it back
to the coordinates is then a join of two plain tables, whose large keys Spark
splits between tasks. A document's own rows meet in one place, no other group.

Two places count as equal where both hashes of 64 bits are, that of the anchor and
that of the stretch or window: among n windows two that differ do so by chance with
a probability of about n * n / 2 ** 129, 1e-13 for 1e13 windows.

Cases: null or empty texts have no words. A repeat within one document counts,
also one that overlaps itself. Repeated rows are occurrences of their own. Rows
are told apart by doc_id and a hash of the text, so a null or repeated doc_id
is no harm. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nestra.llm.common import Words, inverse, mix, powers, saved, signed, text_bytes, text_chunks

WINDOW, KMER = 35, 10
_STRETCH_BASE, _WINDOW_BASE = 0xE7037ED1A0B428DB | 1, 0x8EBC6AF09C88C6E3 | 1


def _prefix(hashes: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers(base, len(hashes)), out=out[1:])
    return out


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the least of each `width` neighbours, the first of equals."""
    place = np.arange(len(values))
    best, have = values, 1
    while have < width:
        step = min(have, width - have)
        other, other_place = best[step:], place[step:]
        best, place = best[: len(other)], place[: len(other)]
        take = other < best
        best, place = np.where(take, other, best), np.where(take, other_place, place)
        have += step
    return place


def stretches(words: Words, window: int = WINDOW, k: int = KMER) -> tuple[np.ndarray, ...]:
    """(text, first window, last window, anchor, stretch hash) of each run of windows with one anchor; windows count within the text."""
    at = words.inside(window)
    if not len(at):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    grams = words.grams(k)
    anchor = _least(grams, window - k + 1)[at]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (anchor[1:] != anchor[:-1])
    begins = np.flatnonzero(new)
    first, last = at[begins], at[np.append(begins[1:], len(at)) - 1]
    text = np.searchsorted(words.first, first, side="right") - 1
    total = _prefix(words.hashes, _STRETCH_BASE)
    size = (last + window - first).astype(np.uint64)
    stretch = mix((total[last + window] - total[first]) * powers(inverse(_STRETCH_BASE), len(words.hashes) + 1)[first] + mix(size))
    base = words.first[text]
    return text, first - base, last - base, grams[anchor[begins]], stretch


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(-1)).alias("doc"), F.xxhash64("doc_id", "text").alias("key"))


def occurrences(docs: DataFrame, window: int, k: int) -> DataFrame:
    """(doc, key, first, last, anchor, stretch): the graph's edges with their source coordinates."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            text, first, last, anchor, stretch = stretches(Words(*text_bytes(batch.column(0))), window, k)
            at = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).take(at), batch.column(2).take(at), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), pa.array(signed(anchor)), pa.array(signed(stretch))], ["doc", "key", "first", "last", "anchor", "stretch"]
            )

    return docs.select("text", "doc", "key").mapInArrow(cut, "doc long, key long, first int, last int, anchor long, stretch long")


MARKED = "doc_id long, doc long, key long, n_words long, n_removed long, kept_sha256 string, text string, begins array<int>, ends array<int>, anchors array<long>, windows array<long>, places array<int>"


def _finish(text: str, covered: np.ndarray, with_text: bool) -> tuple[int, str, str | None]:
    words = _split(text)
    kept = " ".join([w for w, gone in zip(words, covered, strict=True) if not gone] if covered.any() else words)
    return int(covered.sum()), hashlib.sha256(kept.encode()).hexdigest(), kept if with_text else None


_BLANK = str.maketrans(dict.fromkeys("\t\n\x0b\x0c\r", " "))


def _split(text: str) -> list[str]:
    return [w for w in text.translate(_BLANK).split(" ") if w]


def _cover(n: int, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, begins, 1)
    np.add.at(change, ends, -1)
    return np.cumsum(change[:-1]) > 0


def remove_repeats(docs: DataFrame, window: int = WINDOW, k: int = KMER, with_text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) of (doc_id, text); kept: the words left, joined by a space."""
    keyed = _keyed(docs)
    edges = occurrences(keyed, window, k)
    repeated = edges.groupBy("anchor").agg(F.count("*").alias("n"), F.min("stretch").alias("low"), F.max("stretch").alias("high")).where("n > 1").select("anchor", (F.col("low") != F.col("high")).alias("branches"))
    hits = edges.drop("stretch").join(saved(repeated, "repeated"), "anchor").groupBy("doc", "key").agg(F.collect_set(F.struct("first", "last", "anchor", "branches")).alias("hits"))
    joined = keyed.join(hits, ["doc", "key"], "left").select("text", "doc_id", "doc", "key", "hits.first", "hits.last", "hits.anchor", "hits.branches")
    width = window

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in MARKED.split(", ")] + ["kept"] * with_text
        kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.list_(pa.int32())] * 2 + [pa.list_(pa.int64())] * 2 + [pa.list_(pa.int32())] + [pa.string()] * with_text
        for batch in text_chunks(batches):
            words = Words(*text_bytes(batch.column(0)))
            total = _prefix(words.hashes, _WINDOW_BASE)
            back = powers(inverse(_WINDOW_BASE), len(words.hashes) + 1)
            rows = []
            for i in range(batch.num_rows):
                base, n = int(words.first[i]), int(words.first[i + 1] - words.first[i])
                text = batch.column(0)[i].as_py() or ""
                head = (batch.column(1)[i].as_py(), batch.column(2)[i].as_py(), batch.column(3)[i].as_py(), n)
                if not batch.column(4)[i].is_valid:
                    removed, digest, kept = _finish(text, np.zeros(n, bool), with_text)
                    rows.append((*head, removed, digest, None, None, None, None, None, None, kept)[: len(names)])
                    continue
                first, last, anchor, branches = (np.asarray(batch.column(c)[i].values.to_numpy(zero_copy_only=False)) for c in range(4, 8))
                branches = branches.astype(bool)
                begins, ends = first[~branches], last[~branches] + width
                if not branches.any():
                    removed, digest, kept = _finish(text, _cover(n, begins, ends), with_text)
                    rows.append((*head, removed, digest, None, None, None, None, None, None, kept)[: len(names)])
                    continue
                size = last[branches] - first[branches] + 1
                place = np.repeat(first[branches] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
                hashed = mix((total[base + place + width] - total[base + place]) * back[base + place])
                rows.append((*head, None, None, text, begins, ends, np.repeat(anchor[branches], size), signed(hashed), place.astype(np.int32), None)[: len(names)])
                if len(rows) >= 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    marked = saved(joined.mapInArrow(mark, MARKED + (", kept string" if with_text else "")), "marked")
    open_ = marked.where(F.col("kept_sha256").isNull())
    single = open_.select("doc", "key", F.explode(F.arrays_zip("anchors", "windows", "places")).alias("x")).select("doc", "key", F.col("x.anchors").alias("anchor"), F.col("x.windows").alias("window"), F.col("x.places").alias("place"))
    seen = single.groupBy("anchor", "window").agg(F.count("*").alias("n")).where("n > 1").select("anchor", "window")
    verified = single.join(saved(seen, "seen"), ["anchor", "window"]).groupBy("doc", "key").agg(F.collect_set("place").alias("places"))
    closing = open_.select("doc_id", "n_words", "text", "begins", "ends", "doc", "key").join(verified, ["doc", "key"], "left").select("text", "doc_id", "n_words", "begins", "ends", "places")
    result = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if with_text else "")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            rows = []
            for text, doc_id, n, begins, ends, places in zip(*(batch.column(i) for i in range(6)), strict=True):
                at = np.asarray(places.values.to_numpy(zero_copy_only=False)) if places.is_valid else np.zeros(0, np.int64)
                covered = _cover(n.as_py(), np.r_[begins.values.to_numpy(zero_copy_only=False), at].astype(np.int64), np.r_[ends.values.to_numpy(zero_copy_only=False), at + width].astype(np.int64))
                removed, digest, kept = _finish(text.as_py(), covered, with_text)
                rows.append((doc_id.as_py(), n.as_py(), removed, digest) + ((kept,) if with_text else ()))
            kinds = [pa.int64()] * 3 + [pa.string()] * (2 if with_text else 1)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in result.split(", ")])

    names = [x.split()[0] for x in result.split(", ")]
    return marked.where(F.col("kept_sha256").isNotNull()).select(names).unionByName(closing.mapInArrow(close, result))
