"""Benchmark decontamination: rare n-gram seeds join passages to test items, Smith-Waterman alignment scores them.

Words are lower-cased and without punctuation. A pair's score is that of its
best local alignment (match 2, mismatch and gap -1) as a part of the score of an
exact copy. Between two runs of equal words there is an edit at least, so an
alignment of a score s over an item of n words holds least_seeds(n, s) pairs of
neighbouring words of the item, within span(n, s) words of the text. Seeds are
such pairs. Of an item's, so many less one as an alignment must hold, those most
frequent in all documents, are not rare; an alignment still holds a rare one.
Stretches of a document with enough seeds of an item, a rare one among them, are
aligned with it. So nothing of MIN_SCORE or more is missed, whatever the edits.

The seeds are joined where the documents are: an index of at most INDEX_ROWS
seeds is broadcast, a larger benchmark is taken in several parts. Documents are
not moved. Long stretches are aligned in blocks that overlap by a span, and
blocks together up to a fixed number of cells.

Cases: null or empty texts and items have no words and match nothing. Items of
too few words for a seed to be sure (5 or fewer) count as exact copies only.
Repeated rows of documents give one row for each doc_id and item; a null doc_id
is a document too; of equal scores the first place counts. A text of any length
is read whole. Either table may be empty. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nestra.llm.common import Words, saved, signed, text_bytes, text_chunks

#: Least score of a contaminated pair, in parts of an exact copy's; over 0.5.
MIN_SCORE = 0.6
BITMAP_BITS = 1 << 25
#: Seeds of items that are broadcast at once (24 bytes each).
INDEX_ROWS = 500_000
MATCH, MISMATCH, GAP = 2, -1, -1
#: Pairs, and cells of a row of all their tables, that are aligned at once; items whose seeds are looked up at once.
ALIGN_PAIRS, ALIGN_CELLS, ITEM_BLOCK = 256, 1 << 18, 64
#: Seeds found at once; a block of items with more is halved.
HITS = 1 << 21


def least_seeds(n: int, min_score: float) -> int:
    """Pairs of neighbouring words that an alignment of that score with an item of n words holds; 0: it may hold none."""
    return max(0, math.ceil((2 * min_score - 1) * n - 1 - 1e-9))


def span(n: int, min_score: float) -> int:
    """Most words of the text in such an alignment: each that the item lacks costs 1."""
    return n + math.ceil(MATCH * (1 - min_score) * n)


def item_words(items: DataFrame) -> DataFrame:
    """(item_id, words) of (item_id, text): hashes of all words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            words = Words(*text_bytes(batch.column(1)), lower=True, marks=True)
            own = [words.hashes[a:b].astype("<u8").tobytes() for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(own, pa.binary())], ["item_id", "words"])

    return items.select("item_id", "text").mapInArrow(cut, "item_id long, words binary")


def _grams(hashes: np.ndarray, k: int) -> np.ndarray:
    holder = Words.__new__(Words)
    holder.hashes = hashes
    return holder.grams(k)


class Index:
    """The seeds of some items: sorted grams with the item and place of each, in blocks of items."""

    def __init__(self, ids: list, words: list[np.ndarray], counts: dict[int, int] | None, min_score: float):
        self.ids, self.words = ids, words
        sizes = np.array([len(w) for w in words], np.int64)
        self.least = np.array([least_seeds(n, min_score) for n in sizes], np.int64)
        self.span = np.array([span(n, min_score) for n in sizes], np.int64)
        self.bits = np.zeros(BITMAP_BITS // 64, np.uint64)
        self.lengths: set[int] = set()  # of items that are seeds as a whole
        self.blocks = []
        for at in range(0, len(words), ITEM_BLOCK):
            grams, owner, rare = [], [], []
            for i in range(at, min(len(words), at + ITEM_BLOCK)):  # places with one gram count as often as it stands there
                n, least = len(words[i]), self.least[i]
                if not n:
                    continue
                own = _grams(words[i], 2 if least else n)
                if not least:
                    self.lengths.add(n)
                kept = np.ones(len(own), bool)
                if counts is not None and least > 1:
                    often = np.array([counts.get(int(g), 0) for g in signed(own)])
                    kept[np.argsort(-often, kind="stable")[: least - 1]] = False
                own, at_own = np.unique(own, return_inverse=True)
                grams.append(own)
                owner.append(np.full(len(own), i))
                rare.append(np.bincount(at_own, kept) > 0)
            if grams:
                grams, owner, rare = np.concatenate(grams), np.concatenate(owner), np.concatenate(rare)
                order = np.argsort(grams, kind="stable")
                self.blocks.append((grams[order], owner[order], rare[order]))
                np.bitwise_or.at(self.bits, ((grams & np.uint64(BITMAP_BITS - 1)) >> np.uint64(6)).astype(np.int64), np.uint64(1) << (grams & np.uint64(63)))

    def possible(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word index, gram, length) of all in a chunk of texts that may be seeds."""
        found = []
        for k in sorted({2, *self.lengths}):
            g, at = words.grams(k), words.inside(k)
            slot = g[at] & np.uint64(BITMAP_BITS - 1)
            at = at[self.bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1) != 0]
            found.append((at, g[at], np.full(len(at), k)))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def candidates(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, begin, end) of the stretches, as word indexes of the chunk, that alignments may lie in."""
        where, grams, _ = self.possible(words)
        text = np.searchsorted(words.first, where, side="right") - 1
        out = []
        waiting = self.blocks[::-1]
        while waiting:
            keys, owner, rare = waiting.pop()
            low, high = np.searchsorted(keys, grams, "left"), np.searchsorted(keys, grams, "right")
            n = high - low
            hit = np.flatnonzero(n)
            if not len(hit):
                continue
            if n.sum() > HITS and owner.min() < owner.max():
                half = owner <= (owner.min() + owner.max()) // 2
                waiting += [tuple(x[~half] for x in (keys, owner, rare)), tuple(x[half] for x in (keys, owner, rare))]
                continue
            each = np.repeat(hit, n[hit])
            at = np.repeat(low[hit] - np.r_[0, np.cumsum(n[hit])[:-1]], n[hit]) + np.arange(len(each))
            item, place, doc, is_rare = owner[at], where[each], text[each], rare[at]
            order = np.lexsort((place, item, doc))
            item, place, doc, is_rare = item[order], place[order], doc[order], is_rare[order]
            # Each seed with those after it that stand within a span of the same item: are they enough, and one of them rare?
            group = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])])
            number = np.repeat(np.arange(len(group)), np.diff(np.r_[group, len(doc)]))
            apart = int(self.span.max()) + len(words.hashes) + 1  # further than any span: groups do not mix
            line = number * apart + place
            end = np.searchsorted(line, line + self.span[item] - 1)
            rares = np.r_[0, np.cumsum(is_rare)]
            enough = (end - np.arange(len(line)) >= np.maximum(1, self.least[item])) & (rares[end] > rares[:-1])
            starts = np.flatnonzero(enough)
            if not len(starts):
                continue
            # The words about them: an alignment begins and ends within a span of its seeds.
            first = np.maximum(words.first[doc[starts]], place[starts] - self.span[item[starts]])
            last = np.minimum(words.first[doc[starts] + 1], place[starts] + self.span[item[starts]])
            new = np.r_[True, (number[starts][1:] != number[starts][:-1]) | (first[1:] > np.maximum.accumulate(number[starts] * apart + last)[:-1] - number[starts][1:] * apart)]
            begin = np.flatnonzero(new)
            out.append((doc[starts][begin], item[starts][begin], first[begin], np.maximum.reduceat(last, begin)))
        if not out:
            return (np.zeros(0, np.int64),) * 4
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def align(items: list[np.ndarray], texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(score in parts of an exact copy's, end in the text) of the best local alignment of each pair."""
    n, most, longest = len(items), max(map(len, items)), max(map(len, texts))
    a, b = np.zeros((n, most), np.uint64), np.zeros((n, longest), np.uint64)
    in_a, in_b = np.zeros((n, most), bool), np.zeros((n, longest), bool)
    for i, (x, y) in enumerate(zip(items, texts, strict=True)):
        a[i, : len(x)], b[i, : len(y)], in_a[i, : len(x)], in_b[i, : len(y)] = x, y, True, True
    row = np.zeros((n, longest + 1), np.int32)
    slope = np.arange(longest, dtype=np.int32) * -GAP
    best, end = np.zeros(n, np.int32), np.zeros(n, np.int64)
    for i in range(most):
        same = (b == a[:, i : i + 1]) & in_b & in_a[:, i : i + 1]
        new = np.maximum(row[:, :-1] + np.where(same, MATCH, MISMATCH), row[:, 1:] + GAP)
        np.maximum(new, 0, out=new)
        row[:, 1:] = np.maximum.accumulate(new + slope, axis=1) - slope
        at = row.argmax(1)
        top = row[np.arange(n), at]
        end = np.where(top > best, at, end)
        best = np.maximum(best, top)
    return best / (MATCH * np.array([max(1, len(x)) for x in items])), end


def _scores(index: Index, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, item, score, end word in the text) of the best alignment of each stretch or block of one."""
    parts = []
    for text, item, begin, end in zip(*index.candidates(words), strict=True):
        wide = int(index.span[item])
        step = max(4 * wide, 256)
        for at in range(begin, max(begin + 1, end - wide), step):  # blocks overlap by a span
            parts.append((text, item, at, min(end, at + step + wide)))
    parts.sort(key=lambda p: p[3] - p[2])  # those of like size are aligned together
    scores, ends, at = np.zeros(len(parts)), np.zeros(len(parts), np.int64), 0
    while at < len(parts):
        n = 1
        while n < ALIGN_PAIRS and at + n < len(parts) and (n + 1) * (parts[at + n][3] - parts[at + n][2]) <= ALIGN_CELLS:
            n += 1
        some = parts[at : at + n]
        scores[at : at + n], end = align([index.words[i] for _, i, _, _ in some], [words.hashes[a:b] for _, _, a, b in some])
        ends[at : at + n] = end + [a - words.first[t] for t, _, a, _ in some]
        at += n
    text, item = (np.array([p[i] for p in parts], np.int64) for i in (0, 1))
    short = index.least[item] == 0
    scores[short & (scores < 1)] = 0
    return text, item, scores, ends


def gram_counts(docs: DataFrame, index: Index) -> DataFrame:
    """(gram, n): how often what may be a seed of the index stands in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            _, grams, _ = shared.value.possible(Words(*text_bytes(batch.column(0)), lower=True, marks=True))
            grams, n = np.unique(grams, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(signed(grams)), pa.array(n.astype(np.int64))], ["gram", "n"])

    return docs.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _indexes(docs: DataFrame, items: DataFrame, min_score: float, index_rows: int) -> Iterator[Index]:
    """The seeds of all items, in parts with a bounded number of words each."""
    if min_score <= 0.5:
        raise ValueError("seeds are sure for scores over 0.5 only")
    cut = saved(item_words(items), "items")
    size = cut.agg(F.coalesce(F.sum(F.length("words") / 8), F.lit(0))).first()[0]
    n_parts = max(1, -(-int(size) // index_rows))
    for part in range(n_parts):
        rows = cut.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(n_parts)) == part).collect()
        ids, words = [r.item_id for r in rows], [np.frombuffer(r.words, "<u8") for r in rows]
        grams = cut.sparkSession.createDataFrame([(int(g),) for w in words for g in signed(_grams(w, 2))] if rows else [], "gram long").distinct()
        counts = gram_counts(docs, Index(ids, words, None, min_score)).join(F.broadcast(grams), "gram", "left_semi")  # no more than the part has
        yield Index(ids, words, {r.gram: r.n for r in counts.collect()}, min_score)


def decontaminate(docs: DataFrame, items: DataFrame, min_score: float = MIN_SCORE, index_rows: int = INDEX_ROWS) -> DataFrame:
    """(doc_id, item_id, score, end_word) of contaminated pairs of (doc_id, text) and (item_id, text).

    One row for a pair; end_word counts the document's words up to the end of the best match.
    """

    def found(index: Index) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in text_chunks(batches):
                text, item, scores, ends = _scores(shared.value, Words(*text_bytes(batch.column(1)), lower=True, marks=True))
                kept = np.flatnonzero(scores >= min_score)
                item_ids = pa.array([shared.value.ids[i] for i in item[kept]], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()).take(pa.array(text[kept])), item_ids, pa.array(scores[kept]), pa.array(ends[kept])], ["doc_id", "item_id", "score", "end_word"])

        return docs.select("doc_id", "text").mapInArrow(score, "doc_id long, item_id long, score double, end_word long")

    each = reduce(DataFrame.unionByName, [found(x) for x in _indexes(docs, items, min_score, index_rows)])
    best = each.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", (-F.col("end_word")).alias("before"))).alias("x"))
    return best.select("doc_id", "item_id", F.col("x.score").alias("score"), (-F.col("x.before")).alias("end_word"))


def keep_clean(docs: DataFrame, items: DataFrame, min_score: float = MIN_SCORE, index_rows: int = INDEX_ROWS) -> DataFrame:
    """The documents that no test item contaminates; each row is judged where it is, by its own text, whatever its doc_id."""

    def clean(df: DataFrame, index: Index) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in text_chunks(batches):
                text, _, scores, _ = _scores(shared.value, Words(*text_bytes(batch.column(batch.schema.get_field_index("text"))), lower=True, marks=True))
                left = np.ones(batch.num_rows, bool)
                left[text[scores >= min_score]] = False
                yield batch.filter(pa.array(left))

        return df.mapInArrow(keep, docs.schema)

    return reduce(clean, _indexes(docs, items, min_score, index_rows), docs)
