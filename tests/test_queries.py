"""Each query of the library against its SQL in DuckDB, and the recorder's own rules."""

import decimal

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F, types as T

from nestra.functions import scalars
from nestra.operators import nested, registry
from nestra.plans import catalog, contract
from nestra.plans.draft import by_name, draft, pick, planned
from nestra.sources import frames
from nestra.sources.shared import numbered

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.9g}"
    return "" if v is None else str(v)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_its_sql(spark, sf_dir, name):
    df = registry.queries()[name](spark, sf_dir)
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    answer = db.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in answer.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    expected = sorted(tuple(plain(r[columns.index(c)]) for c in order) for r in answer.fetchall())
    assert sorted(tuple(plain(r[c]) for c in order) for r in df.collect()) == expected


def edge_embeddings(tmp_path) -> str:
    """A folder whose embeddings stand about hundredths and thousandths, or are null, empty, zero or partly null."""
    thousandths = np.float32([k / 1000 for k in range(-600, 600)])
    about = np.stack([np.nextafter(thousandths, np.float32(-1)), thousandths, np.nextafter(thousandths, np.float32(1))]).T.ravel().tolist()
    rows = [None, [], [None], [0.0], [-0.0], [None] * 40, [0.5, None, 0.0] * 20, [0.25] * 33, *(about[i : i + 40] for i in range(0, len(about), 40))]
    columns = {"vec_id": pa.array(range(len(rows)), pa.int64()), "embedding": pa.array(rows, pa.list_(pa.float32())), "label": pa.nulls(len(rows), pa.int32())}
    pq.write_table(pa.table(columns), tmp_path / "embeddings.parquet")
    return str(tmp_path)


def equals_its_sql_on_embeddings(spark, folder: str, name: str) -> None:
    db = duckdb.connect()
    db.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    answer = db.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in answer.description]
    expected = sorted(answer.fetchall(), key=lambda r: r[0])
    assert [tuple(r[c] for c in columns) for r in registry.queries()[name](spark, folder).orderBy("vec_id").collect()] == expected


def test_prim_list_steps_equals_its_sql_at_edges(spark, tmp_path):
    equals_its_sql_on_embeddings(spark, edge_embeddings(tmp_path), "prim_list_steps")


def test_list_preview_equals_its_sql_at_edges(spark, tmp_path):
    equals_its_sql_on_embeddings(spark, edge_embeddings(tmp_path), "list_preview")


def test_tolerant_codecs_equals_its_sql_at_edges(spark, tmp_path):
    """Null, empty and blank texts, such as look like a prefix, and characters cut off where the first bytes end."""
    texts = [None, "", " \r\n", "\0", "0x", "-_+/", "\ufeff", *("a" * n + c for n in range(60, 66) for c in ("é", "€", "😀" * 2)), "é" * 300_000]
    pq.write_table(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())}), tmp_path / "documents.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    answer = db.execute(registry.oracle_sql()["tolerant_codecs"])
    columns = [c[0] for c in answer.description]
    made = registry.queries()["tolerant_codecs"](spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [tuple(r[c] for c in columns) for r in made] == sorted(answer.fetchall())


def test_texts_are_packed_in_bounded_pieces(spark):
    assert [len(x) for x in frames._pieces(pa.array(["a" * 300_000, None, "b" * 300_000, "c" * 900_000, "", "d"]))] == [2, 1, 1, 2]
    assert [x.to_pylist() for x in frames._pieces(pa.array(["z", "é", None]).slice(1))] == [["é", None]]
    texts = ["é" * 400_000, None, "", *(str(i) for i in range(50))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").coalesce(1)
    rows = df.select("i", frames.regained("text").alias("a"), frames.extracted(frames.embedded("text")).alias("b")).orderBy("i").collect()
    assert [r.a for r in rows] == texts == [r.b for r in rows]


def test_lists_read_only_what_callbacks_touch(spark, sf_dir, tmp_path):
    path = str(tmp_path / "nested")
    nested.orders_nested(spark, sf_dir).write.parquet(path)
    df = draft(spark.read.parquet(path), lambda o: {"k": o.o_orderkey, "x": o["items"].filter(lambda i: i.returned).map(lambda i: {"p": i.l_partkey})})
    plan = df._jdf.queryExecution().executedPlan().toString()
    schema = plan[plan.index("ReadSchema") :].split("\n")[0]
    assert "l_partkey" in schema and "returned" in schema and "l_tax" not in schema and "o_totalprice" not in schema


def test_slices_and_unknown_fields(spark):
    df = spark.sql("SELECT 1 id, array(named_struct('a', 1, 'b', 'x'), named_struct('a', 2, 'b', ''), named_struct('a', 3, 'b', 'z')) xs")
    take = lambda *s: [x for x in draft(df, lambda r: r.xs.map(lambda i: i.a).slice(*s)).first().value]
    assert (take(0, 0), take(0, 9), take(5, 9), take(-2), take(1, -1), take(2, 1)) == ([], [1, 2, 3], [], [2, 3], [2], [])
    with pytest.raises(AttributeError):
        draft(df, lambda r: r.xs.map(lambda i: i.nothing))
    with pytest.raises(ValueError):
        pick(df, "nothing")
    assert draft(df.where("id = 2"), lambda r: r.xs.size()).collect() == []


def test_truth_and_names(spark):
    row = spark.sql("SELECT 0 i, double('nan') d, '' s, array() a, 'aB-c d' n, 'http://u:p@h/x?api_key=1&b=2' u, '🙂a' e")
    kinds = {f.name: f.dataType for f in row.schema}
    got = row.select(*[scalars.truthy(F.col(c), kinds[c]).alias(c) for c in "idsa"], scalars.snake_case(F.col("n")).alias("n"), scalars.masked_url(F.col("u")).alias("u"), scalars.utf16_length(F.col("e")).alias("e"), scalars.pascal_case(F.col("n")).alias("p")).first()
    assert (got.i, got.d, got.s, got.a, got.n, got.u, got.e, got.p) == (False, False, False, True, "a_b_c_d", "http://***@h/x?api_key=***&b=2", 3, "ABCD")


def test_closure_runs_to_a_fixed_point(spark):
    edges = [(i, i + 1) for i in range(9)] + [(20, 21), (21, 20), (None, 30), (30, 30), (30, None)]
    df = spark.createDataFrame(edges, "source long, target long")
    expected = {(i, j) for i in range(10) for j in range(i + 1, 10)} | {(i, j) for i in (20, 21) for j in (20, 21)} | {(None, 30), (None, None), (30, 30), (30, None)}
    pairs = contract.closure(df).collect()
    assert {(r.source, r.target) for r in pairs} == expected and len(pairs) == len(expected)
    assert {(r.source, r.target) for r in contract.closure(df, depth=2).where("source < 10").collect()} == {(i, j) for i, j in expected if i is not None and i < 10 and j - i <= 2}
    assert contract.closure(df.limit(0)).collect() == []


def test_lock_recognises_members_and_goes_on_from_its_maximum(spark):
    lock = spark.createDataFrame([("a", 1, 7), (None, 2, 3)], "name string, id int, ordinal long")
    members = spark.createDataFrame([("a", 1), (None, 2), ("b", 4), ("c", 3)], "name string, id int")
    extend = lambda old: {(r.name, r.id): r.ordinal for r in contract.extend_lock(old, members, order="id").collect()}
    assert extend(lock) == {("a", 1): 7, (None, 2): 3, ("c", 3): 8, ("b", 4): 9}
    assert extend(lock.limit(0)) == {("a", 1): 0, (None, 2): 1, ("c", 3): 2, ("b", 4): 3}


def test_whole_urls_are_masked_and_all_statuses_judged(spark, sf_dir):
    rows = registry.queries()["scalar_names_all"](spark, sf_dir).collect()
    assert {(r.page_id % 7, r.retry) for r in rows} == {(0, False), (1, False), (2, True), (3, True), (4, True), (5, False), (6, True)}
    assert all(r.masked.endswith("api_key=***") and "pw@" not in r.masked and len(r.name) <= 64 for r in rows)
    assert max(len(r.name) for r in rows) > 40


def test_filters_take_any_type_and_lists_of_plain_values(spark):
    df = spark.sql("""SELECT 1 id, array(0, 1, null, -2) ints, array(double('nan'), 0D, 0.5D) doubles, array('', 'a', null) texts, array(array(1, 2), array()) nested,
     array(named_struct('n', 0, 's', 'x', 'd', double('nan'), 't', named_struct('k', 1)), named_struct('n', 2, 's', '', 'd', 1D, 't', null)) rows""")
    one = lambda fn: draft(df, fn).first().value
    assert one(lambda r: r.ints.filter(lambda x: x)) == [1, -2]
    assert one(lambda r: r.doubles.filter(lambda x: x)) == [0.5]
    assert one(lambda r: r.texts.filter(lambda x: x)) == ["a"]
    assert one(lambda r: r.nested.filter(lambda x: x).map(lambda x: x.size())) == [2, 0]  # lists are true, also empty ones
    assert one(lambda r: r.nested.map(lambda x: x.map(lambda y: y + 1))) == [[2, 3], []]
    assert one(lambda r: r.ints.map(lambda x: F.coalesce(x, F.lit(9))).slice(1, 3)) == [1, 9]
    assert one(lambda r: r.ints.at(3)) == -2 and one(lambda r: r.ints.at(7)) is None
    for name, kept in (("n", [2]), ("s", [0]), ("d", [2]), ("t", [0])):
        assert one(lambda r, name=name: r.rows.filter(lambda i: i[name]).map(lambda i: i.n)) == kept
    assert one(lambda r: r.rows.filter(lambda i: i.n + 1).map(lambda i: i.n)) == [0, 2]
    assert one(lambda r: r.rows.filter(lambda i: i.n > r.id).map(lambda i: i.n)) == [2]  # with what lies outside, a boolean
    assert one(lambda r: r.rows.filter(lambda i: True).size()) == 2
    assert one(lambda r: r.rows.map(lambda i: i.t.k)) == [1, None]


def test_names_look_up_the_first(spark):
    df = spark.sql("SELECT array(named_struct('key', 'a', 'value', 1), named_struct('key', 'a', 'value', 2), named_struct('key', null, 'value', 3)) p")
    found = by_name(F.col("p"), "a", "b")
    assert tuple(df.select(found["a"], found["b"]).first()) == (1, None)
    with pytest.raises(ValueError):
        by_name(F.col("p"), *map(str, range(257)))


def test_the_diff_shuffles_and_sorts_its_facts_once(spark, sf_dir, monkeypatch):
    plans = []

    def keep(df, name):
        if name == "facts":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    monkeypatch.setattr(catalog, "saved", keep)
    facts = [spark.createDataFrame([("field", "a.b", "a", "type", "int"), ("field", None, None, "type", "int")], "entity string, path string, owner string, fact string, value string") for _ in range(2)]
    assert catalog.diff(*facts).where("path is not null").collect() == []
    assert plans[0].count("Exchange hashpartitioning") == 1 and plans[0].count("Sort [") == 1


def test_every_rule_of_the_diff(spark):
    thing = "entity string, path string, owner string, fact string, value string"
    old, new, expected = [], [], set()
    for i, ((entity, fact), code) in enumerate(catalog.FACT_CHANGES.items()):
        here = (entity, f"t{i}", None, "present", None)
        old += [here, (entity, f"t{i}", None, fact, "false")]
        new += [here, (entity, f"t{i}", None, fact, "true")]
        expected.add((code, f"t{i}", fact != "nullable"))
    back = [(e, p.replace("t", "u"), o, f, v) for e, p, o, f, v in new if f in ("nullable", "required")], [(e, p.replace("t", "u"), o, f, v) for e, p, o, f, v in old if f in ("nullable", "required")]
    old += back[0]
    new += back[1]
    expected |= {(catalog.FACT_CHANGES[e, f], p, f == "nullable") for e, p, _, f, _ in back[0]}
    for entity in ("struct", "interface", "restApi", "field", "method", "operation", "param", "schema", "property", "enumValue"):
        names = catalog.NAMED_CHANGES.get(entity, (f"{entity}.removed", f"{entity}.added"))
        old += [(entity, f"gone {entity}", "top", "present", None), (entity, f"gone {entity}", "top", "type", "x"), ("field", f"in gone {entity}", f"gone {entity}", "present", None)]
        new += [(entity, f"new {entity}", "top", "present", "true"), (entity, f"soft {entity}", None, "present", "false")]
        expected |= {(names[0], f"gone {entity}", True), (names[1], f"new {entity}", entity in catalog.ADDED_REQUIRED), (names[1], f"soft {entity}", False)}
    same = [("schema", "s", None, "present", None), ("schema", "s", None, "type", None), ("schema", None, None, "present", None)] * 2
    frame = lambda rows: spark.createDataFrame(rows, thing)
    found = catalog.diff(frame(old + same[:2]), frame(new + same[:2] * 2))
    assert {(r.change, r.path, r.breaking) for r in found.collect()} == expected and found.count() == len(expected)
    summary = contract.summarise(found).first()
    assert (summary.total, summary.breaking, summary.compatible) == (len(expected), sum(b for *_, b in expected), False)
    assert catalog.diff(frame(old), frame(old)).collect() == [] and catalog.diff(frame([]), frame([])).collect() == []
    assert contract.summarise(catalog.diff(frame([]), frame([]))).first().compatible


def test_locks_keep_tombstones_and_follow_renames(spark):
    lock = spark.createDataFrame([("s", "a", "T", 0), ("s", "b", "U", 1), ("s", "c", None, 5), (None, "x", "T", 2), ("gone", "y", "T", 0)], "scope string, name string, signature string, ordinal long")
    members = spark.createDataFrame([("s", "b", "V", 0), ("s", "a2", "T", 1), ("s", "d", "W", 2), (None, "x2", "T", 1), (None, None, "Q", 0), ("new", "k", None, 7), ("new", "j", None, 3)], "scope string, name string, signature string, place long")
    rows = lambda detect: {(r.scope, r.name): (r.signature, r.ordinal, r.state, r.was) for r in contract.update_lock(lock, members, detect).collect()}
    assert rows(True) == {
        ("s", "b"): ("V", 1, "unchanged", None), ("s", "a2"): ("T", 0, "renamed", "a"), ("s", "c"): (None, 5, "removed", None), ("s", "d"): ("W", 6, "added", None),
        (None, "x2"): ("T", 2, "renamed", "x"), (None, None): ("Q", 3, "added", None), ("gone", "y"): ("T", 0, "removed", None), ("new", "j"): (None, 0, "added", None), ("new", "k"): (None, 1, "added", None),
    }
    plain_rows = rows(False)
    assert plain_rows[("s", "a")] == ("T", 0, "removed", None) and plain_rows[("s", "a2")] == ("T", 6, "added", None) and plain_rows[("s", "d")] == ("W", 7, "added", None)
    assert contract.update_lock(lock.limit(0), members.limit(0), True).collect() == []


def test_frames(spark):
    parts = [b"", b"a", b"\0" * 16 + b"\4\0x", b"\0" * 16 + b"\5\0y", b"z" * 300]
    df = spark.createDataFrame([(1, parts), (2, []), (3, None)], "id int, frames array<binary>")
    back = df.select("id", frames.split(frames.joined(F.col("frames"))).alias("x"), frames.without_kinds(F.col("frames")).alias("kept")).orderBy("id").collect()
    assert [[bytes(f) for f in r.x.frames] if r.x.frames is not None else None for r in back] == [parts, [], None] and all(r.x.error is None for r in back)
    assert [None if r.kept is None else len(r.kept) for r in back] == [4, None, None]
    bad = spark.createDataFrame([(1, b"\1\0\0\0a\1\0"), (2, b"\2\0\0\0a")], "id int, batch binary")
    assert [(r.id, r.error, r.frame and bytes(r.frame)) for r in frames.exploded_frames(bad, "batch").orderBy("id").collect()] == [(1, "truncated length prefix", b"a"), (2, "truncated frame", None)]
    with pytest.raises(Exception, match="truncated"):
        frames.exploded_frames(bad, "batch", strict=True).collect()
    short = spark.createDataFrame([(b"",), (b"1234567",), (b"123456789",), (None,)], "m binary")
    assert [r[0] for r in short.select(frames.framing_code(F.col("m"))).collect()] == [1, 1, 2, None]
    texts = ['["undefined"]', '["inf"]', '["error","TypeError","no"]', '[[1,["bigint","7"]]]', '{"a":[["x"]]}', '["import",1]', "no json", "null", None, '["bytes","AAE="]']
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(frames.typed_json("t").alias("x")).collect()
    assert [(r.x.type, r.x.value) for r in got] == [("undefined", None), ("number", "Infinity"), ("error", "TypeError: no"), ("array", '[1,{"type":"bigint","value":"7"}]'), ("object", '{"a":["x"]}'), ("reference", '["import",1]'), (None, None), ("null", None), (None, None), ("bytes", "AAE=")]


def test_scalars_at_their_edges(spark):
    import math
    import struct

    doubles = [0.0, -0.0, 1.5, -2.25, 5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, math.inf, -math.inf]
    rows = spark.createDataFrame([(x, struct.unpack("<q", struct.pack("<d", x))[0]) for x in doubles], "x double, b long").select("x", "b", scalars.double_of_bits(F.col("b")).alias("back"), scalars.bits_of_double(F.col("x")).alias("bits")).collect()
    assert all(r.back == r.x and math.copysign(1, r.back) == math.copysign(1, r.x) and r.bits == r.b for r in rows)
    singles = [1.5, -0.5, 1e-45, 3.4028234663852886e38, math.inf]
    assert [r[0] for r in spark.createDataFrame([(struct.unpack("<i", struct.pack("<f", x))[0],) for x in singles], "b long").select(scalars.float_of_bits(F.col("b"))).collect()] == [struct.unpack("<f", struct.pack("<f", x))[0] for x in singles]
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    lit = F.lit
    assert [one(scalars.sign_extended(lit(x), 8)) for x in (127, 128, 255, -1)] == [127, -128, -1, -1]
    assert one(scalars.unsigned(lit(-1), 64)) == 2**64 - 1 and one(scalars.unsigned(lit(-1), 32)) == 2**32 - 1
    assert one(scalars.composed(lit(-1), lit(-1))) == -1 and one(scalars.xor_default(lit(None), 5)) == 5
    assert one(scalars.filled("/a/{x}/b", x=lit("ü /~!"))) == "/a/%C3%BC%20%2F~!/b"
    for params in ({}, {"x": lit(None).cast("string")}):
        with pytest.raises(Exception, match="missing path parameter"):
            one(scalars.filled("/a/{x}", **params))
    assert one(scalars.with_query(lit("http://h/p?a=1#f"), {}, b=lit("x y"), c=lit(None).cast("string"))) == "http://h/p?a=1&b=x+y#f"
    joins = [("http://h/", "/p"), ("http://h", "p"), ("http://h", "ftp://x"), ("", "p"), ("b", ""), ("b/", "p")]
    assert [one(scalars.joined_url(lit(a), lit(b))) for a, b in joins] == ["http://h/p", "http://h/p", "ftp://x", "p", "b", "b/p"]
    assert (one(scalars.kebab_to_camel(lit("x-request-id"))), one(scalars.camel_case(lit("get user"))), one(scalars.identifier(lit("1 a-b")))) == ("xRequestId", "getUser", "_1_a_b")
    assert [one(scalars.jittered_ms(lit(a), linear=x)) for a, x in ((3, False), (20, False), (3, True))] == [800, 10_000, 400] and one(scalars.backoff_ms(lit(1))) == 200
    assert [one(scalars.of_hex(lit(t))) for t in ("0x0A, ff", "abc", "", "zz")] == [bytearray(b"\n\xff"), None, None, None]
    assert bytes(one(scalars.of_base64(lit("-_8 \n=")))) == b"\xfb\xff"
    assert one(scalars.hex_preview(lit(b"\x01" * 40))).endswith("01  …(+8 more)") and one(scalars.hex_preview(lit(b"ab"))) == "61 62"
    tests = [(b"a" * 63 + "é".encode(), True), (b"\xff", False), ("é" * 60).encode(), (b"a" * 70 + b"\xff", True), (b"", True)]
    tests = [t if isinstance(t, tuple) else (t, True) for t in tests]
    assert [one(scalars.probably_utf8(lit(b))) for b, _ in tests] == [t for _, t in tests]
    assert one(scalars.canonical(lit('{"b": [{"z": 1, "a": "é"}], "a": null}'))) == '{"a":null,"b":[{"a":"é","z":1}]}' and one(scalars.canonical(lit("x"))) is None
    assert one(scalars.with_defaults(lit(None).cast("array<int>"), T.ArrayType(T.IntegerType()))) == []


def test_numbers_within_large_groups(spark):
    df = spark.range(3000).selectExpr("id", "if(id % 10 < 9, 'hot', null) g", "id % 7 v")
    rows = numbered(df, "n", ["v", "id"], ["g"]).collect()
    for g in ("hot", None):
        own = sorted((r.v, r.id, r.n) for r in rows if r.g == g)
        assert [r[2] for r in own] == list(range(len(own)))
    assert numbered(df.limit(0), "n", ["v"]).collect() == []


def test_recorded_callbacks_and_names_of_fields(spark):
    calls = []

    def fn(r):
        calls.append(list(r))
        return {"has": F.lit("a" in r), "not": F.lit("z" in r), "a": r["a"]}

    df = spark.sql("SELECT 1 a, 2 b")
    assert [tuple(planned(x, fn).first()) for x in (df, df.where("a > 0"), spark.sql("SELECT 5 a, 2 b"))] == [(True, False, 1), (True, False, 1), (True, False, 5)]
    planned(spark.sql("SELECT 'x' a"), fn)
    assert calls == [["a", "b"], ["a"]]


def test_schemas_manifests_and_checks(spark):
    kind = catalog.define_schema({"id": "UInt64", "tags": ["Text"], "meta": {"at": "Int64", "parts": [{"n": "Float32"}]}})
    assert kind.simpleString() == "struct<id:decimal(20,0),tags:array<string>,meta:struct<at:bigint,parts:array<struct<n:float>>>>"
    for bad in ({}, {"a b": "Text"}, {"a": "Words"}, {"a": ["Text", "Text"]}):
        with pytest.raises(ValueError):
            catalog.define_schema(bad)
    later = catalog.define_schema({"id": "UInt64", "name": "Text", "meta": {"at": "Text", "parts": [{"n": "Float32", "m": "Bool"}]}})
    changes = catalog.diff(catalog.manifest(spark, {"S": kind}), catalog.manifest(spark, {"S": later}))
    assert {(r.change, r.path, r.breaking) for r in changes.collect()} == {("field.removed", "S.tags", True), ("field.added", "S.name", False), ("field.typeChanged", "S.meta.at", True), ("field.added", "S.meta.parts.m", False)}
    df = spark.sql("SELECT 1 a, 2 b")
    assert catalog.validated(df, catalog.only_columns("a", "b")) is df
    with pytest.raises(catalog.Refused, match="'b'"):
        catalog.validated(df, catalog.only_columns("a"))
    assert spark.sql("SELECT ' a ' t").select(scalars.not_blank(F.col("t"))).first()[0] == "a"
    with pytest.raises(Exception, match="blank"):
        spark.sql("SELECT '  ' t").select(scalars.not_blank(F.col("t"))).collect()
