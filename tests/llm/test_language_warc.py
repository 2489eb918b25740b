import hashlib
import math
import tracemalloc
import zlib
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from nestra.llm import language_id, warc
from nestra.llm import queries as q
from nestra.llm.common import scratch, table


def brute_bits(texts, text):
    """Code length of a text by the definition: count, escape, exclude, one byte after another."""
    counts = {}
    for t in texts:
        raw = [None] * 3 + list(t.encode())
        for i in range(3, len(raw)):
            for order in range(4):
                own = counts.setdefault(tuple(raw[i - order : i]), {})
                own[raw[i]] = own.get(raw[i], 0) + 1

    @lru_cache(maxsize=None)
    def p(context, s):
        lower = (lambda x: p(context[1:], x)) if context else (lambda x: 1 / 256)
        seen = counts.get(context, {})
        if not seen:
            return lower(s)
        n, d = sum(seen.values()), len(seen)
        if s in seen:
            return seen[s] / (n + d)
        return d / (n + d) * lower(s) / sum(lower(x) for x in range(256) if x not in seen)

    raw = [None] * 3 + list(text.encode())
    return sum(-math.log2(p(tuple(raw[i - 3 : i]), raw[i])) for i in range(3, len(raw)))


def test_the_trees_take_little_more_memory_than_the_model(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tracemalloc.start()
    try:
        model = language_id.fit(docs)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 5 * (model.bits.nbytes + model.context.nbytes)


def test_code_lengths_are_exact(spark):
    rows = [(i, lang, text) for i, (lang, text) in enumerate([("a", "abcab cab abba"), ("b", "zyx zzy xyz é"), ("a", "abab"), ("b", "yy"), ("a", "cacao"), ("b", "zyzzyx"), ("b", "")] * 4)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = language_id.fit(docs)
    learnt = {lang: [t for i, x, t in rows if x == lang and zlib.crc32(str(i).encode()) % 4 != 2] for lang in "ab"}
    assert model.languages == ("a", "b")
    for text in ("abba", "xyz", "é?", "a", "zyxabc", "QQ\0\x01a", "aé"):
        data = np.frombuffer(text.encode(), np.uint8)
        got = model.lengths(data, np.array([0, len(data)]))[0]
        for i, lang in enumerate(model.languages):
            assert got[i] == pytest.approx(brute_bits(learnt[lang], text), rel=1e-4)
    together = model.lengths(np.frombuffer(b"abbaaxyz", np.uint8), np.array([0, 4, 4, 5, 8]))
    assert together[1].tolist() == [0, 0]
    assert together[3] == pytest.approx(model.lengths(np.frombuffer(b"xyz", np.uint8), np.array([0, 3]))[0])


def test_language_query_against_brute_force(spark, sf_dir):
    """Which rows are held out, and what is predicted for each, by its own code lengths."""
    docs = table(spark, sf_dir, "documents").collect()
    learnt = {}
    for r in docs:
        if r.lang is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            learnt.setdefault(r.lang, []).append(r.text)
    assert all(sum(len(t.encode()) for t in x) <= language_id.SAMPLE_BYTES for x in learnt.values())  # so all of them count
    got = {r.doc_id: r for r in q.op2_language_id(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    short = [r for r in docs if len(r.text or "") < 300][:25]
    for r in docs:
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= got[r.doc_id].score <= 1
    for r in short:
        bits = {lang: brute_bits(tuple(x), r.text or "") for lang, x in learnt.items()}
        best = min(sorted(bits), key=bits.get)
        assert got[r.doc_id].lang_pred == (best if any(c.isalpha() for c in r.text or "") else "und")
        if got[r.doc_id].lang_pred != "und":
            assert got[r.doc_id].bits_per_byte == pytest.approx(bits[best] / len(r.text.encode()), rel=1e-3)


def test_held_out_accuracy(spark, sf_dir):
    docs = table(spark, sf_dir.replace("sf0.001", "sf0.01"), "documents")
    found = language_id.identify(docs.select("doc_id", "text"), language_id.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id")
    held = found.where(language_id.is_held_out(F.col("doc_id"))).collect()
    assert len(held) > 200 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in held)
    assert language_id.keep_identified(docs).count() == docs.count()


def test_language_cases(spark):
    docs = spark.createDataFrame([(1, "en", "the words of the text", 7), (2, None, None, 7), (3, "en", "", 7), (4, "fr", "123 ... !", 7), (5, None, "the words " * 30000, 7), (None, "en", "the text", 7), (7, "fr", "les mots du texte", 7)], "doc_id long, lang string, text string, c0 int")
    rows = {r.doc_id: r for r in language_id.identify(docs, language_id.fit(docs)).collect()}
    assert len(rows) == 7 and all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in (2, 3, 4))
    assert rows[5].lang_pred == "en" and rows[7].c0 == 7
    unknown = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_id.identify(docs, language_id.fit(unknown)).collect()} == {"und"}
    assert language_id.identify(docs.limit(0), language_id.fit(docs)).collect() == []


def test_warc_round_trip(spark):
    long = "é" * 600
    pages = [(1, "http://a.b/c", long), (2, "http://a.b/d\r\nX: y", long), (3, None, None), (4, "u", ""), (5, "http://x/" + "p" * 5000, "small"), (6, "", "small"), (7, "v", long + "x"), (7, "v", long + "x"), (None, "n", long), (9, "w", "\r\n\r\nWARC/1.1\r\n" * 90000)]
    df = spark.createDataFrame([(*p, "k") for p in pages], "page_id long, url string, html string, digest string")
    for broadcast_rows in (10, 0):
        folder = scratch(spark, "warc")
        assert warc.write_archives(df.repartition(3), folder, archive_bytes=2000, broadcast_rows=broadcast_rows) == len(pages)
        rows = warc.read_captures(spark, folder).collect()
        assert len(rows) == len(pages)
        ids = [r.record_id for r in warc.read_records(spark, folder, with_payload=False).collect()]
        assert len(set(ids)) == len(ids) == 3 * len(pages)
        raw_files = [bytes(r.content) for r in spark.read.format("binaryFile").load(folder).collect()]
        heads = [dict(x.split(": ", 1) for x in m.partition(b"\r\n\r\n")[0].decode().split("\r\n")[1:]) for f in raw_files for m in warc.members(f)]
        refers = {h["WARC-Record-ID"]: h.get("WARC-Refers-To") for h in heads}
        for r in rows:
            own = [p for p in pages if p[0] == r.page_id]
            raw = (own[0][2] or "").encode()
            assert (r.response.payload_bytes, r.response.payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
            revisit = r.page_id in (1, None)
            assert (r.response.kind, r.response.refers_to) == (("revisit", 2) if revisit else ("response", None))
            assert r.response.payload is None if revisit else bytes(r.response.payload) == raw
            assert r.request.fields.startswith("GET /") and r.metadata.fields == f"payload-bytes: {len(raw)}"
            if revisit:
                assert refers[r.response.id] in ids
            if r.page_id == 2:
                assert r.url == "http://a.b/d%0D%0AX:%20y"
            else:
                assert r.url == own[0][1]


def test_revisits_of_a_page_that_is_there_twice(spark):
    text = "long " * 300
    df = spark.createDataFrame([(5, "a", text), (5, "b", text), (1, None, text), (None, "c", text)], "page_id long, url string, html string")
    folder = scratch(spark, "warc")
    warc.write_archives(df, folder)
    rows = warc.read_captures(spark, folder).collect()
    assert sorted((str(r.page_id), r.response.kind, str(r.response.refers_to)) for r in rows) == [("1", "revisit", "5"), ("5", "response", "None"), ("5", "response", "None"), ("None", "revisit", "5")]


def test_warc_faults(spark):
    folder = scratch(spark, "warc")
    assert warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), folder) == 0
    data = warc.capture("0-0", 1, "u", b"payload", hashlib.sha1(b"payload").hexdigest())
    assert [warc.parse(m, True)[0] for m in warc.members(data)] == ["request", "response", "metadata"]
    with pytest.raises((ValueError, zlib.error)):
        list(warc.members(data[:-9]))
    bad = warc.capture("0-0", 1, "u", b"payload", "0" * 40)
    with pytest.raises(ValueError):
        [warc.parse(m, True) for m in warc.members(bad)]
