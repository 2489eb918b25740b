import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from nestra.llm import media_ts, packing, token_counts, token_ids, url_filter
from nestra.llm import queries as q
from nestra.llm.common import filesystem, put_in_place, scratch, table

TEXTS = [(1, "A short text."), (2, None), (3, ""), (4, "words of a long text " * 900), (5, "Ünïcode — 日本語 🙂 text"), (6, "A short text."), (7, "x" * 30000)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", t) for i, t in TEXTS], "doc_id long, text string, ids string, file string")


def brute_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    for i, c in enumerate(rest):
        if c in "/?#":
            host, rest = rest[:i], rest[i:]
            break
    else:
        host, rest = rest, ""
    path = rest.split("?")[0].split("#")[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def brute_rule(host, path):
    best = None
    for r in url_filter.RULES:
        if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path) and (best is None or len(r.name) > len(best.name)):
            best = r
    return best


URLS = [None, "", "no scheme", "http://", "http://A.Example.COM/en/7?x#y", "https://example.com/en/8", "ftp://b.net/de/8", "http://x.example.net/de/81", "http://a.org/es/#q", "http://notexample.com/en/7",
        "http://www.spam-farm.org/fr/1.html", "http://spam-farm.org/fr/1/", "http://m.spam-farm.org/fr/1?u=http://z", "http://other.org/fr/1", "http://É.org/es", "://h/p", "a://b://c/d"]


def test_url_filter(spark):
    pages = spark.createDataFrame([(i, u, "", "") for i, u in enumerate(URLS)], "page_id long, url string, block string, w0 string")
    listed = spark.createDataFrame([("spam-farm.org/fr/1",)], "canonical string")
    rows = {r.page_id: r for r in url_filter.filter_urls(pages, listed).collect()}
    assert len(rows) == len(URLS)
    for i, url in enumerate(URLS):
        host, path = brute_url(url)
        best = brute_rule(host, path)
        assert (rows[i].host, rows[i].path, rows[i].rule) == (host, path, best and best.name)
        assert rows[i].verdict == (best.verdict if best else "block" if i in (10, 11, 12) else "allow")
    empty = spark.createDataFrame([], "canonical string")
    assert all(r.verdict == (brute_rule(r.host, r.path).verdict if r.rule else "allow") for r in url_filter.filter_urls(pages, empty).collect())
    assert url_filter.filter_urls(pages.limit(0), listed).collect() == []


def test_bloom_passes_all_members(spark):
    keys = spark.range(5000).selectExpr("concat('key', id) as canonical")
    passed = lambda bloom, df: bloom.tested(df, "canonical", "p").where("p").count()
    bloom = url_filter.BlockedBloom.build(keys, "canonical")
    assert passed(bloom, keys) == 5000
    others = spark.range(5000).selectExpr("concat('other', id) as canonical")
    assert passed(bloom, others) < 500 and bloom.tested(others, "canonical", "p").count() == 5000
    assert passed(bloom, spark.sql("SELECT cast(null as string) canonical")) == 0
    tiny = url_filter.BlockedBloom.build(keys, "canonical", max_blocks=4)  # saturated: all pass, and the join decides
    assert tiny.n_blocks == 4 and passed(tiny, keys) == 5000
    pages = keys.union(others).selectExpr("hash(canonical) page_id", "concat('http://', canonical) url")
    assert url_filter.filter_urls(pages, keys, bloom=tiny).where("listed").count() == 5000


def test_a_hot_url_and_repeated_pages(spark):
    listed = spark.createDataFrame([("h/p",)], "canonical string")
    pages = spark.range(2000).selectExpr("id % 1500 page_id", "if(id % 3 = 0, 'http://www.h/p.html', if(id % 3 = 1, null, 'http://h/p2')) url")
    rows = url_filter.filter_urls(pages, listed).collect()
    assert len(rows) == 2000 and sum(r.verdict == "block" for r in rows) == 667 == sum(r.listed for r in rows)


def test_the_list_comes_from_footers(spark):
    pages = spark.createDataFrame([("http://a/1/", "<footer>&copy; www.free-bets.example.com &middot;"), ("http://m.a/1.html", "<footer>&copy; free-bets.x"), ("http://b/2", "free-bets"), (None, "<footer>&copy; free-bets.x"), ("http://c/3", None)], "url string, html string")
    assert [r.canonical for r in url_filter.listed_urls(pages).collect()] == ["a/1"]


def test_token_ids_are_those_of_the_tokenizers_library():
    import tokenizers

    path = token_ids.default_vocabulary()
    whole = tokenizers.Tokenizer.from_file(path)
    rng = np.random.default_rng(1)
    texts = [t for _, t in TEXTS if t] + ["".join(chr(c) for c in rng.choice([*range(9, 0x250), *range(0x3000, 0x3100), 0x1F600], 80)) for _ in range(200)]
    for t in [*texts, "a<|endoftext|>b", "<|endoftext|>"]:
        assert token_ids.encode(t, path).tolist() == whole.encode(t, add_special_tokens=False).ids


def n_ids(text):
    return len(token_ids.encode(text or "", token_ids.default_vocabulary()))


def test_token_counts(spark, docs):
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs).collect()}
    assert got == {i: n_ids(t) for i, t in TEXTS}
    assert token_counts.count_tokens(docs.limit(0)).collect() == []


def test_stitching_across_small_blocks(spark):
    rng = np.random.default_rng(2)
    folder = scratch(spark, "files")
    fs, root = token_counts.filesystem(folder)
    fs.create_dir(root)
    expected = {}
    for name, ids in {"a": rng.integers(0, 4, 5000), "b": np.full(1000, 1), "c": np.zeros(40, int), "d": np.array([], int), "e": np.r_[np.full(900, 2), 0, 3]}.items():
        with fs.open_output_stream(f"{root}/{name}") as f:
            f.write(ids.astype("<u2").tobytes())
        seps = np.flatnonzero(ids == 0)
        expected |= {(name, i): int(n) for i, n in enumerate(np.diff(np.r_[-1, seps]) - 1)}
    blocks = token_counts.blocks_of(spark, folder, block_bytes=64)
    got = token_counts.document_lengths(token_counts.scan_blocks(blocks, folder, end_id=0), run_blocks=7)
    assert {(r.file, r.ordinal): r.n_tokens for r in got.collect()} == expected
    with fs.open_output_stream(f"{root}/odd") as f:
        f.write(b"abc")
    with pytest.raises(Exception, match="not whole ids"):
        token_counts.blocks_of(spark, folder).collect()
    assert token_counts.blocks_of(spark, scratch(spark, "nothing")).collect() == []


@pytest.mark.parametrize("size", [576, 160, 161, 162, 163, 175, 176, 345, 346, 5760, 5760 * 3, 5760 * 8, 5760 * 20 + 576, 7, 1])
def test_transport_stream_round_trip(size):
    payload = np.random.default_rng(size).integers(0, 256, size).astype(np.uint8).tobytes()
    media = media_ts.mux(payload)
    d = media_ts.demux(media)
    assert d.payload == payload and d.discontinuities == 0 and len(media) % 188 == 0
    assert d.pts.tolist() == [3600 * i for i in range(-(-size // 5760))]
    assert d.random_access.tolist() == d.pts[::8].tolist()


def test_transport_stream_faults():
    media = media_ts.mux(bytes(5760 * 3))
    without = media[: 188 * 5] + media[188 * 6 :]
    lacking = media_ts.demux(without)
    assert (lacking.discontinuities, lacking.damaged, lacking.doubled) == (1, 1, 0)
    twice = media[: 188 * 6] + media[188 * 5 : 188 * 9] + media[188 * 8 :]
    whole = media_ts.demux(twice)
    assert whole.payload == bytes(5760 * 3) and (whole.discontinuities, whole.damaged, whole.doubled, whole.packets) == (0, 0, 2, len(media) // 188 + 2)
    long = media_ts.mux(bytes(5760 * 9))  # its tables come twice, the second copy damaged
    second = long.index(long[:4][:3], 188 * 3)
    with pytest.raises(ValueError):
        media_ts.demux(long[: second + 20] + bytes([long[second + 20] ^ 1]) + long[second + 21 :])
    for broken in (b"", media[:-1], b"\0" + media[1:], media[188:], media[:10] + bytes([media[10] ^ 1]) + media[11:]):
        with pytest.raises(ValueError):
            media_ts.demux(broken)


def test_media_table(docs):
    rows = {r.doc_id: r for r in media_ts.read_media(media_ts.media_table(docs)).collect()}
    for i, text in TEXTS:
        raw = (text or "").encode()
        padded = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (rows[i].n_bytes, bytes(rows[i].payload), rows[i].payload_bytes) == (len(raw), padded, len(padded))
        assert rows[i].payload_sha256 == hashlib.sha256(padded).hexdigest() and rows[i].tail_crc32 == zlib.crc32(padded[-32:])
        assert (rows[i].doubled, rows[i].damaged, rows[i].discontinuities) == (0, 0, 0)
    assert rows[1].media_sha256 == rows[6].media_sha256
    assert media_ts.read_media(media_ts.media_table(docs.limit(0))).collect() == []


def test_media_query_against_brute_force(spark, sf_dir):
    """Every column of the registered query, the feature too."""
    texts = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    rows = q.op9_media_columns(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        media = media_ts.mux(payload)
        units = -(-len(payload) // 5760)
        feature = f"units={units};pts=0-{3600 * (units - 1)};random_access={','.join(str(3600 * i) for i in range(0, units, 8))};packets={len(media) // 188};discontinuities=0"
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(media), hashlib.sha256(media).hexdigest(), feature)


def test_very_long_runs_through_the_queries_operators(spark):
    texts = [(1, " " * 2_000_000), (2, "a" + "\n" * 2_000_000 + "b"), (3, "x" * 300_000), (4, None)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(2)
    expected = {i: n_ids(t) for i, t in texts}
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(df).collect()} == expected
    lengths = packing.pack(df).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).collect()
    assert {r.doc_id: (r.n, r["all"]) for r in lengths} == {i: (n + 1, n + 1) for i, n in expected.items()}


def test_counting_and_packing_queries_against_brute_force(spark, sf_dir):
    texts = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    vocabulary = token_ids.default_vocabulary()
    ids = {i: [*token_ids.encode(t or "", vocabulary).tolist(), 0] for i, t in texts.items()}
    assert {r.doc_id: r.n_tokens for r in q.op5_token_counts(spark, sf_dir).collect()} == {i: len(token_ids.encode(t or "", vocabulary, special=False)) for i, t in texts.items()}
    seen, sequences = {}, {}
    for r in q.op10_packing(spark, sf_dir).collect():
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert len(own) == r.length and r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.asarray(own, "<u4").tobytes())
        seen[r.doc_id] = seen.get(r.doc_id, 0) + r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert seen == {i: len(x) for i, x in ids.items()}
    for pieces in sequences.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:j]) for j in range(len(pieces))] and sum(n for _, n in pieces) <= 1024


def test_a_file_that_is_there_is_left(tmp_path):
    fs, root = filesystem(str(tmp_path))
    for text in (b"first", b"again"):
        with fs.open_output_stream(f"{root}/_draft") as f:
            f.write(text)
        put_in_place(fs, f"{root}/_draft", f"{root}/whole")
    assert (tmp_path / "whole").read_bytes() == b"first" and not (tmp_path / "_draft").exists()


def test_packing(spark, docs):
    vocabulary = token_ids.default_vocabulary()
    rows = packing.pack(docs.repartition(2), with_ids=True).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
        assert zlib.crc32(np.asarray(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
    for i, text in TEXTS:
        pieces = sorted(by_doc[i], key=lambda r: r.start)
        assert sum((p.ids for p in pieces), []) == [*token_ids.encode(text or "", vocabulary).tolist(), 0]
        assert all(p.start == sum(x.length for x in pieces[:j]) and p.doc_tokens == n_ids(text) + 1 for j, p in enumerate(pieces))
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        assert all(p.offset == sum(x.length for x in pieces[:j]) for j, p in enumerate(pieces))
        total = sum(p.length for p in pieces)
        assert total <= 1024 and total & (total - 1) == 0
    assert packing.pack(docs.limit(0)).collect() == []


def test_packer_tiers_and_groups():
    rng = np.random.default_rng(3)
    packer = packing.Packer(0, buffer_tokens=8192)
    lengths = rng.integers(1, 3000, 600)
    for i, n in enumerate(lengths):
        packer.add(i, np.full(n, i, np.uint32))
    packer.finish()
    assert sum(r[2] for r in packer.out) == lengths.sum()
    groups = {}
    for r in packer.out:
        groups.setdefault(r[8], []).append(r)
    full = [sum(r[2] for r in g) for g in groups.values() if g[0][7] == 1024]
    assert full.count(packing.STEP_TOKENS) >= len(full) - 2
    short = sum(r[2] for r in packer.out if r[7] < 128)
    assert short < 128
