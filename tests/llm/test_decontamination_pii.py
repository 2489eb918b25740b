import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest

from nestra.llm import boosting, decontamination, pii
from nestra.llm import queries as q
from nestra.llm.common import table


def brute_score(item, text):
    words = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", "".join(c.lower() if c < "\x80" else c for c in t))
    a, b = words(item), words(text)
    row, best = [0] * (len(b) + 1), 0
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(max(0, row[j - 1] + (2 if x == y else -1), row[j] - 1, new[-1] - 1))
        row, best = new, max(best, *new)
    return best / (2 * max(1, len(a)))


def contaminated(docs, items):
    """{(doc, item): score} by all pairs; items of 5 words or fewer count as exact copies."""
    pairs = {(d, i): (s := brute_score(" ".join(w), t)) for d, t in docs.items() for i, w in items.items() if t and w}
    return {(d, i): s for (d, i), s in pairs.items() if s >= (0.6 if len(items[i]) > 5 else 1)}


def test_decontamination_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    vocabulary = [f"w{i}" for i in range(400)] + ["the", "of"] * 40
    say = lambda n: [str(w) for w in rng.choice(vocabulary, n)]
    items = {i: say(int(rng.integers(6, 60))) for i in range(12)} | {20: ["two", "words"], 21: [], 22: ["the"] * 8, 23: ["alone"]}
    docs = {}
    for i in range(60):
        body, own = say(int(rng.integers(20, 400))), list(items[i % 12])
        if i % 3 == 0:
            for _ in range(len(own) // 7):  # edits
                at = int(rng.integers(len(own)))
                own[at : at + int(rng.integers(0, 2))] = [f"x{rng.integers(99)}"]
        if i % 5 == 1:
            own = [w for j, x in enumerate(own) for w in ([x] if j % (2 + i % 2) else [x, f"y{j}"])]  # a word more after each second or third
        if i % 5 == 2:
            own = [x if j % 4 else f"z{j}" for j, x in enumerate(own)]
        if i % 4 != 3:
            body[10:10] = own
        docs[i] = " ".join(body) if i % 2 else ", ".join(w.upper() for w in body)
    docs |= {70: "Some two, WORDS here", 71: None, 72: "", 73: "the the the the of the the the the", 74: "all alone", 75: "two other words"}
    df = spark.createDataFrame([(i, t, 1) for i, t in docs.items()], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in items.items()] + [(24, None)], "item_id long, text string")
    expected = contaminated(docs, items)
    assert {(70, 20), (73, 22), (74, 23)} <= set(expected)
    for rows in (500_000, 100):
        assert {(r.doc_id, r.item_id): r.score for r in decontamination.decontaminate(df, bench, index_rows=rows).collect()} == pytest.approx(expected)
    assert {r.doc_id for r in decontamination.keep_clean(df, bench).collect()} >= {71, 72}
    assert decontamination.decontaminate(df.limit(0), bench).collect() == []
    assert decontamination.decontaminate(df, bench.limit(0)).collect() == []


def test_items_that_many_documents_hold_in_part(spark):
    word = lambda i, n: [f"i{i}w{j}" for j in range(n)]
    third = lambda ws: [w if j % 3 != 2 else f"x{j}" for j, w in enumerate(ws)]
    items = {1: word(1, 20), 2: word(2, 40), 3: word(3, 59), 4: word(4, 30), 5: word(5, 20)}
    docs = {i: "a b c " + " ".join(items[i % 3 + 1][: (13, 25, 37)[i % 3]]) + f" d{i} e{i}" for i in range(90)}  # a passage that most documents share
    docs |= {100 + i: "a b c " + " ".join(items[i][:half] + third(items[i][half:])) + " d e" for i, half in ((1, 11), (2, 20), (3, 30))}
    docs[110] = "q " * 50 + " ".join(f"{w} y{j}" if j < 21 else w for j, w in enumerate(items[4])) + " z" * 50
    docs[111] = "q " * 200 + " ".join(items[5][:4]) + " z" * 100 + " " + " ".join(items[5][:9]) + " z" * 300  # too little of an item, twice
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in items.items()], "item_id long, text string")
    expected = contaminated(docs, items)
    assert len(expected) == 94
    assert {(r.doc_id, r.item_id): r.score for r in decontamination.decontaminate(df, bench).collect()} == pytest.approx(expected)


def test_a_long_document_full_of_seeds(spark, monkeypatch):
    """One text of 200,000 words, all of them seeds: it is aligned in blocks, also with few hits held at once."""
    items = {i: [f"i{i}w{j % 11}" for j in range(20 + 10 * i)] for i in range(3)}
    tail = " ".join(items[2][:15] + ["x"] + items[2][16:])
    text = " ".join(f"i0w{j % 7} i1w{j % 5}" for j in range(100_000)) + " " + tail
    df = spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in items.items()], "item_id long, text string")
    expected = contaminated({1: tail}, items)
    assert list(expected) == [(1, 2)]
    rows = decontamination.decontaminate(df, bench).collect()
    assert {(r.doc_id, r.item_id): r.score for r in rows} == pytest.approx(expected) and len(rows) == 1
    assert rows[0].end_word == 200_040
    words = decontamination.Words(*decontamination.text_bytes(pa.array([text])), lower=True, marks=True)
    hashes = [decontamination.Words(*decontamination.text_bytes(pa.array([" ".join(t)])), lower=True, marks=True).hashes for t in items.values()]
    index = decontamination.Index(list(items), hashes, {}, 0.6)
    whole = [x.tolist() for x in index.candidates(words)]
    monkeypatch.setattr(decontamination, "HITS", 1000)
    assert [x.tolist() for x in index.candidates(words)] == whole


def test_all_pairs_of_the_tables(spark, sf_dir):
    """The registered query against all pairs of documents and test items."""
    docs, bench = table(spark, sf_dir, "documents").collect(), table(spark, sf_dir, "benchmark").collect()
    cut = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", "".join(c.lower() if c < "\x80" else c for c in t))
    texts, items = {r.doc_id: cut(r.text or "") for r in docs}, {r.item_id: cut(r.text or "") for r in bench}
    code = {w: i + 1 for i, w in enumerate({w for t in [*texts.values(), *items.values()] for w in t})}
    expected = {}
    for i, words in items.items():
        order = sorted((d for d in texts if texts[d]), key=lambda d: len(texts[d]))
        for at in range(0, len(order), 50):
            some = order[at : at + 50]
            scores, _ = decontamination.align([np.array([code[w] for w in words], np.uint64)] * len(some), [np.array([code[w] for w in texts[d]], np.uint64) for d in some])
            expected |= {(d, i): s for d, s in zip(some, scores, strict=True) if s >= 0.6}
    assert {(r.doc_id, r.item_id): r.score for r in q.op6_decontamination(spark, sf_dir).collect()} == pytest.approx(expected)


def brute_pii(text):
    """The base spans by the patterns as they are stated."""
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x if x < 5 else 2 * x - 9) for i, x in enumerate(d[::-1])) % 10 == 0:
            found.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append(("phone", *m.span()))
    return sorted(found, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def pii_texts():
    rng = np.random.default_rng(4)
    pieces = ["a@b.c", "@d.e", "x.y%z+1@ho-st.co.uk", "@", ".", "1.2.3.4", "256.1.1.1", "0255.00.1.9", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+12", "++", " ", "é", "🙂", "12345678901234567890", "00000000000000", "word", "-", "5", "7.8", "call 555-123-4567", "bob (at) host (dot) org"]
    return ["".join(rng.choice(pieces, int(rng.integers(1, 14)))) for _ in range(1500)] + ["", "1" * 60000, "a" * 60000 + "@", "1." * 40000, "+1" + " " * 50000, "@a.b" * 20000]


def test_base_spans_are_the_stated_patterns():
    for text in pii_texts()[:-4]:
        own = sorted(((k, a, b) for k, a, b, base in pii.proposals(text) if base), key=lambda s: (s[1], pii.KINDS.index(s[0])))
        assert own == brute_pii(text)
    for text in pii_texts()[-4:]:
        list(pii.proposals(text))


def test_pii_query_and_added_spans(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in q.op8_pii(spark, sf_dir).collect():
        base = brute_pii(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS[:4]] == [sum(s[0] == k for s in base) for k in pii.KINDS[:4]]
        assert r.n_spans == len(r.spans.split(",")) if r.spans else r.n_spans == 0
        assert r.n_added == r.n_spans - len(base)
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r.spans.split(","))
    model = pii.fit(docs)
    added = lambda t: [t[a:b] for _, a, b, base in pii.spans_of(t, model) if not base]
    assert added("please email jane.doe (at) mailhost (dot) org for more") == ["jane.doe (at) mailhost (dot) org"]
    assert added("call 555-123-4567 today") == ["555-123-4567"]
    assert added("we look at stones dot and the 12 of 13") == []
    assert added('then token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" and') == ["24be64439e3e49cf46b2d7c90f3602a3d0b907ff"]
    assert added("commit: 24be64439e3e49cf46b2d7c90f3602a3d0b907ff and part 555-123-4567 at 12:30:45") == []
    assert pii.redacted("mail a@b.cc now 1.2.3.4!", pii.spans_of("mail a@b.cc now 1.2.3.4!", model)) == "mail [EMAIL] now [IP]!"
    odd = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (3, "x@y.zz", "k"), (3, "x@y.zz", "k")], "doc_id long, text string, spans string")
    rows = pii.find_pii(odd, model, redact=True).collect()
    assert [(r.doc_id, r.redacted) for r in sorted(rows, key=lambda r: r.doc_id)] == [(1, None), (2, ""), (3, "[EMAIL]"), (3, "[EMAIL]")]
    assert pii.find_pii(odd.limit(0), pii.fit(odd.limit(0))).collect() == []


def test_added_spans_on_held_out_texts(spark, sf_dir):
    """Precision and recall of each kind on forms in texts that neither trees nor thresholds have seen."""
    texts = [r.text or "" for r in table(spark, sf_dir, "documents").collect()]
    rows = [(i, tuple(x), y) for i, t in enumerate(texts * 4) for x, y in pii.examples(t, i)]
    model = pii.learned([r for r in rows if r[0] % 5])
    x, y = np.array([r[1] for r in rows if r[0] % 5 == 0]), np.array([r[2] for r in rows if r[0] % 5 == 0])
    p = model.trees.probability(x)
    for i, kind in enumerate(pii.KINDS):
        own = x[:, 0] == i
        if kind == "card":  # no generator beyond the format
            assert not own.any() and model.thresholds[kind] > 1
            continue
        chosen = p[own] >= model.thresholds[kind]
        assert 0.5 <= model.thresholds[kind] <= 1 and y[own].sum() > 30
        assert y[own][chosen].mean() > 0.95 and (chosen & (y[own] == 1)).sum() > 0.9 * y[own].sum()


def test_thresholds():
    p, y = np.array([0.9, 0.8, 0.8, 0.7, 0.6]), np.array([1, 1, 1, 0, 1])
    assert boosting.calibrated_threshold(p, y, 0.98, 2) == 0.8
    assert boosting.calibrated_threshold(p, y, 0.7, 2) == 0.6
    assert boosting.calibrated_threshold(p, y, 0.7, 2, floor=0.75) == 0.75
    assert boosting.calibrated_threshold(p, y, 0.98, 4) > 1 and boosting.calibrated_threshold(p[:0], y[:0], 0.9, 1) > 1


def test_keep_clean_judges_each_row(spark):
    item, clean = " ".join(f"t{i}" for i in range(20)), " ".join(f"c{i}" for i in range(30))
    rows = [(None, item), (None, clean), (7, item), (7, clean), (7, None), (None, None), (8, clean)]
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, source string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = decontamination.keep_clean(df, bench)
    assert got.columns == df.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in got.collect()) == sorted((str(i), str(t)) for i, t in rows if t != item)
