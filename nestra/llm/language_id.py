"""Language identification by prediction by partial matching over bytes.

For each language a context tree of up to ORDER bytes is counted on a bounded
sample of labelled texts and frozen. A node gives a seen byte count / (n + d)
and passes the escape probability d / (n + d) to its shorter context, whose
seen bytes are excluded (method C); below the root all 256 bytes are equal. The
trees of all languages are laid out as one table with a row for each context and
a column for each byte of the sample, so that the exact code length of a text
under every language is one gather and one sum. Bytes that the sample lacks are
equal to one another in every context and share a column. The shortest code wins,
of equal ones the language whose name is first.

Nothing of the sample is left out: every context and byte that it has counts. Its
bound is SAMPLE_BYTES of text for each language, as an expected number.

Cases: a null text, or one without a letter, is `und` with score 0. Texts that
repeat get equal answers. A very long text is coded whole, in one step. With no
labelled text at all every text is `und`; an empty table gives no rows. In the
sample a row without doc_id, or with a repeated one, counts for itself. Only text
is read for a prediction; other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nestra.llm.common import text_bytes, text_chunks

#: Most bytes of a context.
ORDER = 3
#: Bytes of labelled texts counted for each language, as an expected number.
SAMPLE_BYTES = 800_000
#: Contexts whose code lengths are worked out in one step.
BLOCK = 256
#: Bits that score lets count for each bit of code length, as neighbouring bytes are not independent.
TEMPER = 0.1


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    symbol: np.ndarray  # of each byte: 0 for all that the sample lacks, else from 1; `n_symbols` stands before a text
    n_symbols: int
    context: np.ndarray  # row of the longest known context, for ORDER symbols
    bits: np.ndarray  # code length: context row, symbol, language

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length in bits of each text under each language."""
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        if not len(data) or not self.languages:
            return out
        s = self.symbol[data]
        code = np.zeros(len(s), np.int32)
        for back in range(ORDER, 0, -1):
            before = np.full(len(s), self.n_symbols, np.int32)
            before[back:] = s[:-back]
            for i in range(back):  # what lies before a text
                at = offsets[:-1] + i
                before[at[at < offsets[1:]]] = self.n_symbols
            code = code * (self.n_symbols + 1) + before
        bits = self.bits[self.context[code], s]
        full = np.flatnonzero(np.diff(offsets))
        out[full] = np.add.reduceat(bits, offsets[:-1][full], axis=0, dtype=np.float64)
        return out


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def labelled_sample(docs: DataFrame, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(lang, text) of labelled documents that are not held out, about `sample_bytes` for each language, by a hash of doc_id and text."""
    known = docs.where(~F.coalesce(is_held_out(F.col("doc_id")), F.lit(False)) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    sizes = known.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n"))
    share = sizes.select(F.col("lang").alias("__lang"), F.least(F.lit(1.0), sample_bytes / F.greatest(F.col("n"), F.lit(1))).alias("__share"))
    chosen = known.join(F.broadcast(share), F.col("lang") == F.col("__lang"))  # a row for each language
    return chosen.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < F.col("__share") * (1 << 20)).select("lang", "text")


def gram_counts(sample: DataFrame) -> pa.Table:
    """(language, place and bytes as a number, count), summed in Spark: the byte and three before it, and how many of these lie before the text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            for lang in sorted(set(langs)):
                rows = batch.filter(pa.array(langs == lang))
                data, offsets = text_bytes(rows.column(1))
                code = data.astype(np.int64)
                for back in range(1, ORDER + 1):
                    code[back:] |= data[:-back].astype(np.int64) << 8 * back
                place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
                early = np.maximum(ORDER - place, 0)
                code &= (np.int64(1) << (8 * (ORDER + 1 - early))) - 1  # no byte of the text before
                code |= early << 8 * (ORDER + 1)
                grams, n = np.unique(code, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    rows = sample.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    return rows.toArrow()


def fit(docs: DataFrame, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """The frozen trees, from (doc_id, lang, text)."""
    counted = gram_counts(labelled_sample(docs, sample_bytes))
    names = counted["lang"].combine_chunks().dictionary_encode()
    languages = tuple(sorted(names.dictionary.to_pylist()))
    lang = np.array([languages.index(x) for x in names.dictionary.to_pylist()], np.int64)[names.indices.to_numpy()]
    gram = counted["gram"].to_numpy()
    n = counted["n"].to_numpy().astype(np.float64)
    symbol = np.zeros(256, np.int32)
    here = np.unique(gram & 255)
    symbol[here] = np.arange(1, len(here) + 1)
    size = len(here) + 1  # and START, as a context only
    if not languages:
        return Model((), symbol, 1, np.zeros(1 << ORDER, np.int32), np.zeros((1, 1, 0), np.float32))
    lacking = 256 - len(here)
    early = gram >> 8 * (ORDER + 1)
    s0 = symbol[gram & 255]
    contexts = [np.zeros(len(gram), np.int64)]
    for order in range(1, ORDER + 1):
        before = np.where(early > ORDER - order, size, symbol[gram >> 8 * order & 255])
        contexts.append(contexts[-1] + before * (size + 1) ** (order - 1))

    known = [np.unique(c) for c in contexts]  # every context of the sample, by order
    row_of: list[dict] = [dict() for _ in known]
    probability = np.zeros((sum(map(len, known[:-1])), size, len(languages)))  # of contexts that others fall back to
    bits = np.zeros((sum(map(len, known)), size, len(languages)), np.float32)
    start = 0
    for order, ids in enumerate(known):
        place = np.searchsorted(ids, contexts[order])
        by_place = np.argsort(place, kind="stable")
        for low in range(0, len(ids), BLOCK):
            own = ids[low : low + BLOCK]
            at = by_place[slice(*np.searchsorted(place, (low, low + len(own)), sorter=by_place))]
            table = np.zeros((len(own), size, len(languages)))
            np.add.at(table, (place[at] - low, s0[at], lang[at]), n[at])
            if order == 0:
                shorter = np.full((1, size, len(languages)), 1 / 256)
                shorter[:, 0] = lacking / 256
            else:
                shorter = probability[[_longest(row_of, int(i) % (size + 1) ** (order - 1), order - 1, size) for i in own]]
            seen = table > 0
            total, distinct = table.sum(1, keepdims=True), seen.sum(1, keepdims=True)
            rest = np.where(seen, 0, shorter).sum(1, keepdims=True)
            escape = np.where(total > 0, distinct / np.maximum(total + distinct, 1), 1.0)
            mixed = np.where(seen, table / np.maximum(total + distinct, 1), escape * shorter / np.maximum(rest, 1e-300))
            rows = slice(start + low, start + low + len(own))
            if order < ORDER:
                probability[rows] = mixed
            mixed = -np.log2(np.maximum(mixed, 1e-300))
            mixed[:, 0] += np.log2(max(1, lacking))  # one of those that share the column
            bits[rows] = mixed
        row_of[order].update({int(i): start + k for k, i in enumerate(ids)})
        start += len(ids)

    context = np.zeros((size + 1) ** ORDER, np.int32)
    for order, ids in enumerate(known):
        step = (size + 1) ** order
        for i, row in row_of[order].items():
            context[i::step] = row
    return Model(languages, symbol, size, context, bits)


def _longest(row_of: list[dict], context: int, order: int, size: int) -> int:
    """Row of the longest known suffix of a context."""
    while context not in row_of[order]:
        order -= 1
        context %= (size + 1) ** order
    return row_of[order][context]


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred, score (share of the best language, 0 to 1) and bits_per_byte of the best code."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    keys = [c for c in docs.columns if c != "text"]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.languages, "und"], dtype=object)
        for batch in text_chunks(batches):
            text = batch.column(0)
            data, offsets = text_bytes(text)
            bits = model.lengths(data, offsets)
            sizes = np.maximum(np.diff(offsets), 1)
            if len(model.languages):
                best = bits.argmin(1)
                least = bits[np.arange(len(bits)), best]
                score = 1 / np.exp2(-TEMPER * (bits - least[:, None])).sum(1)
            else:
                best, least, score = np.zeros(len(bits), int), np.zeros(len(bits)), np.zeros(len(bits))
            best = np.where(np.array(batch.column(1).to_pylist(), bool), best, len(model.languages))
            score = np.where(best == len(model.languages), 0.0, score)
            columns = [batch.column(i) for i in range(batch.num_columns) if i != 1]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(names[best], pa.string()), pa.array(score), pa.array(least / sizes)], [f"c{i}" for i in range(len(columns))] + ["lang_pred", "score", "bits_per_byte"])

    with_letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    given = docs.select("text", with_letter.alias("__letter"), *[F.col(k) for k in keys])
    types = dict(docs.dtypes)
    out = given.select("text", "__letter", *[F.col(k).alias(f"c{i + 1}") for i, k in enumerate(keys)])
    schema = ", ".join([f"c0 {types['text']}", *[f"c{i + 1} {types[k]}" for i, k in enumerate(keys)]])
    done = out.mapInArrow(predict, f"{schema}, lang_pred string, score double, bits_per_byte double")
    place = {"text": "c0"} | {k: f"c{i + 1}" for i, k in enumerate(keys)}
    return done.select(*[F.col(place[c]).alias(c) for c in docs.columns], "lang_pred", "score", "bits_per_byte")


def keep_identified(docs: DataFrame, max_bits_per_byte: float = 7.0) -> DataFrame:
    """The documents that have a language: some letter, and a code that is no longer than that of noise."""
    found = identify(docs, fit(docs))
    return found.where((F.col("lang_pred") != "und") & (F.col("bits_per_byte") <= max_bits_per_byte)).select(docs.columns)
