import hashlib
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from nestra.llm import ngram_join, pii, substring_dedup
from nestra.llm.common import filesystem, saved, scratch, table, tidied, workspace

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def jvm_mb(spark):
    """Of the driver's JVM, without mapped files and without its heap, which lies under 32 GB."""
    pid = spark.sparkContext._jvm.java.lang.ProcessHandle.current().pid()
    parts = re.findall(r"^([0-9a-f]+)-[0-9a-f]+ (?:.*\n)*?Anonymous:\s+(\d+)", Path(f"/proc/{pid}/smaps").read_text(), re.M)
    return sum(int(kb) for at, kb in parts if int(at, 16) >> 35) / 1024


def freed_outside_the_heap(spark):
    """Buffers of zlib in the driver's JVM, nine of ten freed: the C library keeps what lies between. Gives those that stay."""
    jvm = spark.sparkContext._jvm
    buffers = [jvm.java.util.zip.Deflater() for _ in range(2400)]
    for i, buffer in enumerate(buffers):
        if i % 10:
            buffer.end()
    return buffers[::10]


@pytest.mark.parametrize("step", [tidied, lambda spark: saved(spark.range(10).toDF("a"), "small")])
def test_the_driver_gives_back_what_it_freed_outside_of_its_heap(spark, step):
    step(spark)
    spark.sparkContext._jvm.System.gc()
    stay, before = freed_outside_the_heap(spark), jvm_mb(spark)
    step(spark)
    after = jvm_mb(spark)
    for buffer in stay:
        buffer.end()
    assert after < before - 50


def brute_sets(text, n):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute_components(docs, n, percent):
    sets = [(i, brute_sets(t, n)) for i, t in docs]
    label = {i: i for i, _ in docs}
    changed = True
    pairs = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[:k] if x and y and 100 * len(x & y) >= percent * len(x | y)]
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return {i: (len(s), label[i]) for i, s in sets}


def texts_with_copies(seed, n_docs, sizes, vocabulary=300):
    rng = np.random.default_rng(seed)
    say = lambda n: [f"w{x}" for x in rng.integers(0, vocabulary, n)]
    common, docs = say(40), []
    for _ in range(n_docs):
        if docs and rng.random() < 0.6:
            words = list(docs[int(rng.integers(len(docs)))])
            for _ in range(int(rng.integers(0, 1 + max(1, len(words) // 25)))):
                words[int(rng.integers(len(words)))] = f"e{rng.integers(1000)}"
            words += say(int(rng.integers(0, 4)))
        else:
            words = say(int(rng.choice(sizes)))
            if rng.random() < 0.5:
                words += common
        docs.append(words)
    return [" ".join(w) for w in docs]


@pytest.mark.parametrize(("n", "percent", "spare", "rounds", "sizes"), [(4, 85, 2, 3, [1, 3, 4, 8, 15, 40, 120, 400]), (4, 85, 0, 1, [5, 9, 12, 20, 30, 60]), (5, 80, 2, 2, [6, 12, 25, 70])])
def test_join_is_exact(spark, n, percent, spare, rounds, sizes):
    docs = list(enumerate([*texts_with_copies(percent + rounds, 220, sizes), None, "", " \t", "One Two", "one two", "one two three"]))
    df = spark.createDataFrame([(i, t, 5) for i, t in docs], "doc_id long, text string, component_id int").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join_similar(df, n, percent, spare, rounds).collect()}
    assert got == brute_components(docs, n, percent)


@pytest.mark.parametrize("each_ten", [ngram_join.EACH_TEN, 25])
def test_every_linked_pair_shares_enough_signatures(each_ten):
    """Also of sets that fall short of segments, which few real texts are: in some scheme, more than either has to spare."""
    schemes = ngram_join.Schemes(each_ten=each_ten)
    rng = np.random.default_rng(9)
    for trial in range(3000):
        size = int(rng.integers(1, 40 if trial % 5 else 400))
        a = np.unique(rng.integers(1, 1 << 62, size).astype(np.uint64))
        b = a[rng.random(len(a)) > 0.05] if trial % 2 else a
        b = np.unique(np.r_[b, rng.integers(1, 1 << 62, int(rng.integers(0, 1 + size // 8))).astype(np.uint64)])
        common = len(np.intersect1d(a, b))
        if not len(b) or 100 * common < 85 * (len(a) + len(b) - common):
            continue
        owner, sig, slack, scheme = ngram_join.signatures([a, b], schemes)
        enough = []
        for c in set(scheme[owner == 0].tolist()) & set(scheme[owner == 1].tolist()):
            own = [(owner == i) & (scheme == c) for i in (0, 1)]
            shared = set(sig[own[0]].tolist()) & set(sig[own[1]].tolist())
            enough.append(len(shared) > max(int(slack[o].min()) for o in own))
        assert any(enough)
    tight = ngram_join.Schemes()
    tight._build = lambda number: ngram_join.Scheme(number, tight.edges[number], tight.edges[number + 1] - 1, 2)  # two segments: nearly all fall short
    for _ in range(500):
        a = np.unique(rng.integers(1, 1 << 62, 40).astype(np.uint64))
        b = np.unique(np.r_[a[int(rng.integers(0, 3)) :], rng.integers(1, 1 << 62, int(rng.integers(0, 4))).astype(np.uint64)])
        owner, sig, *_ = ngram_join.signatures([a, b], tight)
        assert set(sig[owner == 0].tolist()) & set(sig[owner == 1].tolist())


@pytest.mark.parametrize(("direct", "edits"), [(2, 3), (2, 9), (16, 5)])
def test_join_is_exact_in_families(spark, monkeypatch, direct, edits):
    """Families of near copies with edits of their own, whose first text is not among them, so that few of many are linked."""
    monkeypatch.setattr(ngram_join, "DIRECT", direct)
    if edits == 9:
        monkeypatch.setattr(ngram_join, "COMMON_LEAST", 3)  # most signatures are dealt in parts
    rng = np.random.default_rng(direct + edits)
    texts = []
    for family in range(4):
        bases = [[f"w{x}" for x in rng.integers(0, 5000, int(rng.choice([30, 80, 150])))]]
        bases.append([*bases[0][:-20], *[f"v{x}" for x in rng.integers(0, 5000, 20)]])  # a family within it
        for _ in range(45):
            words = list(bases[int(rng.integers(2))])
            for _ in range(int(rng.integers(1, edits))):
                words[int(rng.integers(len(words)))] = f"e{rng.integers(20 if family % 2 else 100000)}"
            texts.append(" ".join(words))
    docs = list(enumerate(texts))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for percent in (85, 80):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join_similar(df, 4, percent).collect()}
        assert got == brute_components(docs, 4, percent)


def test_join_of_repeated_and_empty_rows(spark):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (2, "a b c d e"), (None, None), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in ngram_join.join_similar(df).collect())
    assert got == sorted([("1", 2, "1")] * 2 + [("None", 2, "1"), ("2", 2, "1"), ("None", 0, "None"), ("3", 0, "3")])
    assert ngram_join.join_similar(df.limit(0)).collect() == []
    assert ngram_join.keep_one(df.limit(0)).collect() == []


def brute_repeats(docs, window):
    words = [WORD.findall(t or "") for _, t in docs]
    seen = {}
    for w in words:
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            seen[key] = seen.get(key, 0) + 1
    out = []
    for (i, _), w in zip(docs, words, strict=True):
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if seen[tuple(w[p : p + window])] > 1:
                gone[p : p + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((str(i), len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out)


@pytest.mark.parametrize(("window", "k"), [(35, 10), (8, 3), (6, 6)])
def test_repeats_are_exact(spark, window, k):
    rng = np.random.default_rng(window)
    texts = texts_with_copies(window, 120, [5, 20, 34, 35, 36, 80, 300], vocabulary=40 if window < 10 else 300)
    texts += ["x " * 90, "ab cd " * 60, "\t".join(texts[3].split()), None, "", texts[0], "é ü " * 40]
    long = " ".join(f"w{x}" for x in rng.integers(0, 300, 4000))
    texts += [long, long[500:9000], long[:3000] + " z " + long[3000:]]
    docs = [*enumerate(texts), (0, texts[0]), (None, texts[5]), (None, texts[9])]
    df = spark.createDataFrame([(i, t, "k") for i, t in docs], "doc_id long, text string, key string").repartition(3)
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in substring_dedup.remove_repeats(df, window, k).collect())
    assert got == brute_repeats(docs, window)


def test_repeats_of_an_empty_table(spark):
    assert substring_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_pipeline_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").unionByName(spark.createDataFrame([(900001, "123 456 !!", "en", "s", 10), (900002, "", "en", "s", 0)], table(spark, sf_dir, "documents").schema))
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, sf_dir).cache()
        if name != "packing":
            assert docs.columns == columns
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "language":
            assert {r.doc_id for r in before.collect()} - kept[name] == {900001, 900002}
        if name == "near_duplicates":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            assert kept[name] == {i for i, (_, c) in brute_components(rows, 5, 80).items() if i == c}
        if name == "decontamination":
            plain = lambda t: re.sub(r"\W+", " ", t.lower())
            items = [plain(r.text).strip() for r in table(spark, sf_dir, "benchmark").collect()]
            copies = {r.doc_id for r in before.collect() if any(x in plain(r.text) for x in items)}
            assert copies and copies.isdisjoint(kept[name]) and kept["near_duplicates"] - copies == kept[name]
        if name == "personal_data":
            assert kept[name] == kept["decontamination"]
            assert not any(base for r in docs.collect() for *_, base in pii.proposals(r.text))
    assert kept["packing"] == kept["personal_data"]
    assert docs.agg(F.sum("length")).first()[0] == docs.select("doc_id", "doc_tokens").distinct().agg(F.sum("doc_tokens")).first()[0]


def test_keep_one_keeps_one_row_of_each_group(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (1, a), (None, a), (2, a + " more"), (1, b), (None, c), (None, c), (None, c + " more"), (None, None), (None, None), (3, "")]
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, source string")
    got = ngram_join.keep_one(df)
    assert got.columns == df.columns
    kept = sorted((str(r.doc_id), str(r.text).split(" more")[0]) for r in got.collect())
    assert kept == sorted([("1", a), ("1", b), ("None", c), ("None", "None"), ("None", "None"), ("3", "")])


def test_a_workspace_goes_and_leaves_what_is_kept(spark):
    with workspace(spark) as keep:
        inner = scratch(spark, "x")
        lost, kept = saved(spark.range(3), "lost"), keep(spark.range(4), "kept")
        with workspace(spark) as keep_within:
            deeper = keep_within(spark.range(5), "deeper")
        assert lost.count() == 3 and deeper.count() == 5
    assert kept.count() == 4
    fs, root = filesystem(inner.rpartition("/")[0])
    assert fs.get_file_info(root).type.name == "NotFound" and "/work-" not in scratch(spark, "y")
    with workspace(spark):
        pass


def test_very_long_texts_link(spark):
    words = [f"w{i * i % 99991}" for i in range(60_000)]
    texts = [" ".join(words), " ".join([*words[:-900], *[f"x{i}" for i in range(900)]]), " ".join(words[: 60_000 * 8 // 10]), "a b c d e"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.join_similar(df).collect()}
    assert got == {i: c for i, (_, c) in brute_components(list(enumerate(texts)), 4, 85).items()} and got[1] == 0


def test_link_counts_are_named_for_what_they_count(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (2, "f g h i j")], "doc_id long, text string")
    assert ngram_join.join_similar(df).columns == ["doc_id", "n_shingles", "component_id", "n_spanning_links"]
