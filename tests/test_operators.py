"""Operators on small inline tables: edge cases and properties."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsync import functions as fn
from docsync.operators import apply, checks, diff, extract, journal, outcome, schema
from docsync.operators.checks import GateFailed
from docsync.sources import documents, exchange, synth


def col(df, name="id"):
    return sorted(r[name] for r in df.collect())


def ids(spark, values):
    return spark.createDataFrame([(v,) for v in values], "id string")


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


# ---- functions ------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "text, other, equal",
    [
        ('{"a":1,"b":[1,2]}', '{"b":[1,2],"a":1.0}', True),
        ('{"a":1e2}', '{"a":100}', True),
        ('{"a":"1e2 10.0"}', '{"a":"1e2 10"}', False),
        ('{"a":null}', "{}", False),
        ('{"a":[1,2]}', '{"a":[2,1]}', False),
        ('{"a":true}', '{"a":1}', False),
        ('{"a":{"y":1,"x":2}}', '{"a":{"x":2,"y":1}}', True),
        ("not json", "not json", True),
        ('{"a":"q\\" 5.0, e1"}', '{"a":"q\\" 5, e1"}', False),
    ],
)
def test_canonical_json(spark, text, other, equal):
    a, b = one(spark, fn.canonical_json(F.lit(text))), one(spark, fn.canonical_json(F.lit(other)))
    assert (a == b) is equal


def test_parse_date(spark):
    want = dt.datetime(2024, 5, 6, 7, 8, 9)
    for text in ("2024-05-06T07:08:09Z", "1714979289000", "2024-05-06T09:08:09+02:00"):
        assert one(spark, fn.parse_date(F.lit(text))) == want
    for text in ("soon", "", "2024-13-01"):
        assert one(spark, fn.parse_date(F.lit(text))) is None


def test_small_scalars(spark):
    assert one(spark, fn.id_suffix(F.lit("doc-17"))) == 17
    assert one(spark, fn.id_suffix(F.lit("doc"))) == -1
    assert one(spark, fn.id_suffix(F.lit("doc-x"))) == -1
    assert one(spark, fn.zero_pad(F.lit(42), 4)) == "0042"
    assert one(spark, fn.zero_pad(F.lit(123456), 4)) == "123456"
    assert one(spark, fn.byte_len(F.lit("é"))) == 2
    assert one(spark, fn.collapse_ws(F.lit(" a \n\t b "), 2)) == "a "
    assert one(spark, documents.is_ip(F.lit("10.0.0.255"))) and not one(spark, documents.is_ip(F.lit("10.0.0.256")))


def test_fingerprint_ignores_order_not_position(spark):
    a = spark.sql("select 1 id, map('x', 1, 'y', 2) m, named_struct('p', 0.0D, 'q', 2) s, 'v' c, cast(null as string) d")
    b = spark.sql("select 1 id, cast(null as string) d, map('y', 2, 'x', 1) m, named_struct('q', 2, 'p', -0.0D) s, 'v' c")
    c = spark.sql("select 1 id, map('x', 1, 'y', 2) m, named_struct('p', 0.0D, 'q', 2) s, cast(null as string) c, 'v' d")
    assert diff.diff(a, b).first()["status"] == "same"
    assert diff.diff(a, c).first()["status"] == "changed"


def test_microseconds_count(spark):
    a = spark.sql("select 1 id, timestamp'2024-01-01 00:00:00.000001' t")
    b = spark.sql("select 1 id, timestamp'2024-01-01 00:00:00.000002' t")
    assert diff.diff(a, b).first()["status"] == "changed"


# ---- extract and diff -------------------------------------------------------------------------


def test_bytewise_id_order(spark):
    values = ["é", "doc1", "doc-9", "doc-10", "Doc"]
    ordered = [r["id"] for r in extract.sorted_ids(ids(spark, values + ["doc1"])).collect()]
    assert ordered == ["Doc", "doc-10", "doc-9", "doc1", "é"]


def test_delta_bounds_and_null_timestamps(spark):
    df = spark.sql("select * from values (1, timestamp'2024-01-01'), (2, timestamp'2024-01-02'), (3, null) t(id, ts)")
    bound = dt.datetime(2024, 1, 1)
    assert col(extract.delta(df, "ts", bound)) == [2]
    assert col(extract.delta(df, "ts", bound, "gte")) == [1, 2]
    assert col(extract.delta(df, None)) == [1, 2, 3]
    with pytest.raises(ValueError):
        extract.delta(df, "ts", bound, "lt")


def test_clean_ids(spark):
    assert col(extract.clean_ids(ids(spark, ["a\r", "", "\r", "b", None]))) == ["a", "b"]


def test_pages_cover_everything_once(spark):
    df = spark.range(50).select(F.col("id"), F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, cast(id div 7 as int))").alias("ts"))
    seen, after = [], None
    while rows := extract.page(df, "ts", after, 8).collect():
        seen += [r["id"] for r in rows]
        after = (rows[-1]["ts"], rows[-1]["id"])
    assert seen == list(range(50))


def test_equal_counts_different_sets(spark):
    a, b = ids(spark, ["a", "b"]), ids(spark, ["b", "c"])
    found = {(r["id"], r["side"]) for r in diff.set_mismatch(a, b).collect()}
    assert found == {("a", "extra"), ("c", "missing")}
    assert col(diff.only_in(a, b)) == ["a"]


def test_hot_id_does_not_multiply(spark):
    hot = spark.range(1000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("id"), F.lit(1).alias("v"))
    both = diff.diff(hot, hot)
    assert both.count() == hot.select("id").distinct().count()
    assert both.where("status <> 'same'").count() == 0
    bad = {(r["id"], r["reason"]) for r in checks.bad_keys(hot).collect()}
    assert bad == {("hot", "duplicate")}


# ---- apply, journal, undo ---------------------------------------------------------------------


def random_pair(spark, seed):
    rnd = random.Random(seed)
    tgt = [(f"d{i}", rnd.randint(0, 3), f"t{i}") for i in range(40) if rnd.random() < 0.8]
    chg = [(f"d{i}", rnd.randint(4, 9), f"n{i}") for i in range(60) if rnd.random() < 0.3]
    shape = "id string, n int, t string"
    return spark.createDataFrame(tgt, shape), spark.createDataFrame(chg, shape)


@pytest.mark.parametrize("seed", range(3))
def test_apply_is_idempotent_and_undo_is_inverse(spark, seed):
    tgt, chg = random_pair(spark, seed)
    once = apply.apply_upserts(tgt, chg)
    twice = apply.apply_upserts(once, chg)
    assert sorted(once.collect()) == sorted(twice.collect())
    rows = journal.preimage(journal.number(chg.select("id")), tgt, "delta")
    assert sorted(journal.undo(once, rows).collect()) == sorted(tgt.collect())
    replay = rows.unionByName(journal.preimage(journal.number(chg.select("id"), 1000), once, "delta"))
    assert sorted(journal.undo(once, replay).collect()) == sorted(tgt.collect())
    halves = chg.where("n % 2 = 0"), chg.where("n % 2 = 1")
    split = apply.apply_upserts(apply.apply_upserts(tgt, halves[0]), halves[1])
    assert sorted(split.collect()) == sorted(once.collect())


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_numbers_do_not_depend_on_partitions(spark, parts):
    df = spark.range(500).select(F.concat(F.lit("x"), F.col("id").cast("string")).alias("id"))
    got = {r["id"]: r["seq"] for r in journal.number(df.repartition(parts), 10).collect()}
    want = {r["id"]: r["seq"] for r in journal.number(df, 10).collect()}
    assert got == want and sorted(got.values()) == list(range(11, 511))


def test_undo_restores_nested_rows_exactly(spark):
    docs = synth.generate_documents(spark, 30)
    changed = docs.where("stock % 2 = 0").withColumn("title", F.lit("x")).withColumn("tags", F.array())
    rows = journal.preimage(journal.number(changed.select("id")), docs, "delta")
    back = journal.undo(apply.apply_upserts(docs, changed), rows)
    assert diff.diff(docs, back).where("status <> 'same'").count() == 0


def test_routing_travels_through_the_journal(spark):
    shape = "id string, v int, routing string"
    tgt = spark.createDataFrame([("a", 1, "r1"), ("b", 2, None)], shape)
    chg = spark.createDataFrame([("a", 9, "r2"), ("c", 9, "r3")], shape)
    rows = journal.preimage(journal.number(chg.select("id")), tgt, "delta", routing="routing")
    assert {r["id"]: r["routing"] for r in rows.collect()} == {"a": "r1", "c": None}
    assert sorted(journal.undo(apply.apply_upserts(tgt, chg), rows, "routing").collect(), key=lambda r: r["id"]) == sorted(tgt.collect(), key=lambda r: r["id"])


def test_deleting_absent_id_is_success(spark):
    tgt, _ = random_pair(spark, 1)
    assert apply.apply_deletes(tgt, ids(spark, ["nope"])).count() == tgt.count()


def test_merge_keeps_what_the_patch_leaves_out(spark):
    tgt = spark.sql("select 'a' id, 1 n, named_struct('x', 1, 'y', 2) s, map('k', 'v') m, 'keep' t")
    patch = spark.sql("select * from values ('a', named_struct('y', 9), map('l', 'w')), ('b', named_struct('y', 3), null) p(id, s, m)")
    got = {r["id"]: r for r in apply.apply_merge(tgt, patch).collect()}
    assert got["a"]["s"].asDict() == {"x": 1, "y": 9} and got["a"]["m"] == {"k": "v", "l": "w"}
    assert (got["a"]["n"], got["a"]["t"]) == (1, "keep")
    assert got["b"]["s"].asDict() == {"x": None, "y": 3} and got["b"]["n"] is None


def test_merge_can_set_null_with_listed_fields(spark):
    tgt = spark.sql("select 'a' id, 1 n, 'old' t")
    patch = spark.sql("select 'a' id, cast(null as int) n, 'new' t, array('n') fields")
    row = apply.apply_merge(tgt, patch, set_fields="fields").first()
    assert (row["n"], row["t"]) == (None, "old")


# ---- schema ----------------------------------------------------------------------------------


def test_remove_fields(spark):
    df = spark.sql("select 1 id, 2 modified_at, named_struct('b', named_struct('c', 1), 'd', 2) a, array(named_struct('x', 1)) arr, map('k', 1) m")
    assert schema.remove_fields(df, "").columns == df.columns
    assert "modified_at" not in schema.remove_fields(df, " modified_at ,, gone.x").columns
    out = schema.remove_fields(df, "a.d, a.nope, a.b.nope, arr.x, m.k, id.z")
    assert out.schema["a"].dataType.names == ["b"] and out.schema["arr"] == df.schema["arr"]
    assert out.first()["m"] == {}
    emptied = schema.remove_fields(df, "a.b.c")
    assert emptied.first()["a"]["b"] == {} and emptied.first()["a"]["d"] == 2


def test_align(spark):
    df = spark.sql("select '7' n, 'x' bad, array(named_struct('q', '1')) l, 'more' extra")
    want = T.StructType.fromDDL("n int, bad int, l array<struct<q int, r string>>, none double")
    row = schema.align(df, want).first()
    assert (row["n"], row["bad"], row["l"][0].asDict(), row["none"]) == (7, None, {"q": 1, "r": None}, None)
    with pytest.raises(ValueError, match="extra"):
        schema.align(df, want, "error")
    assert df.select(schema.misfit(df, want)).first()[0] == "mapper_parsing_exception"
    fine = df.drop("bad")
    assert fine.select(schema.misfit(fine, want, False)).first()[0] is None
    assert fine.select(schema.misfit(fine, want, True)).first()[0] == "strict_dynamic_mapping_exception"


def test_nested_unknown_keys_under_strict(spark):
    lines = spark.createDataFrame(
        [(1, '{"a":{"b":1}}'), (2, '{"a":{"z":1}}'), (3, '{"l":[{"b":1},{"y":2}]}'), (4, '{"a":{"b":"t"}}'), (5, "[]x")],
        "id int, j string",
    )
    want = T.StructType.fromDDL("a struct<b int>, l array<struct<b int>>")
    ok, dead = outcome.conform(lines, "j", want, strict=True)
    assert col(ok) == [1]
    types = {r["_id"]: r["error"]["type"].split("_")[0] for r in dead.collect()}
    assert types == {"2": "strict", "3": "strict", "4": "mapper", "5": "mapper"}


# ---- outcomes --------------------------------------------------------------------------------


def test_classify_cases(spark):
    rows = [
        ("index", 200, None, "ok"), ("delete", 404, None, "ok"), ("index", 404, None, "fatal"),
        ("index", 429, None, "retry"), ("index", 502, None, "retry"), ("index", 503, None, "retry"),
        ("index", 504, None, "retry"), ("index", 400, "mapper_parsing_exception", "fatal"),
        ("index", 403, "cluster_block_exception", "retry"), ("index", None, None, "ok"),
    ]
    df = spark.createDataFrame([(o, s, (t, "r") if t else None, v) for o, s, t, v in rows],
                               "op string, status int, error struct<type string, reason string>, want string")
    assert outcome.classify(df).where("verdict <> want").count() == 0
    last = outcome.classify(df, final=True)
    assert {r["want"] for r in last.where("verdict = 'exhausted'").collect()} == {"retry"}


def test_summary_skips_bad_lines_and_cuts_reasons(spark):
    good = '{"_id":"a","tag":"delta","status":400,"error":{"type":"t","reason":"%s"}}' % ("x  " * 100)
    lines = spark.createDataFrame([(good,), ("{broken",), ("",), ('{"_id":"b"}',)], "value string")
    got = outcome.summarise(outcome.parse_dead_letters(lines)).collect()
    assert {(r["tag"], r["status"], r["type"], r["n"]) for r in got} == {("delta", "400", "t", 1), ("?", "?", "-", 1)}
    assert max(len(r["reason"]) for r in got) == 120


# ---- checks ----------------------------------------------------------------------------------


def test_gates():
    checks.gate(10, 10, 0)
    checks.gate(11, 10, 3, allow_partial=True)
    with pytest.raises(GateFailed):
        checks.gate(9, 10, 0, allow_partial=True)
    with pytest.raises(GateFailed):
        checks.gate(10, 10, 1)
    checks.delete_ratio(10, 100)
    checks.delete_ratio(5, 0)
    checks.delete_ratio(99, 100, assume_yes=True)
    with pytest.raises(GateFailed):
        checks.delete_ratio(11, 100)


def test_lower_bound(spark):
    now = dt.datetime(2024, 1, 2, tzinfo=dt.timezone.utc)
    assert checks.lower_bound("2024-01-01T00:10:00Z", 300, now) == dt.datetime(2024, 1, 1, 0, 5, tzinfo=dt.timezone.utc)
    for bad in ("garbage", None, "2024-01-03T00:00:00Z"):
        with pytest.raises(GateFailed):
            checks.lower_bound(bad, 300, now)
    at = F.lit(now.replace(tzinfo=None))
    assert one(spark, checks.usable_bound(F.lit("2024-01-01T00:10:00Z"), 300, at)) == dt.datetime(2024, 1, 1, 0, 5)
    assert one(spark, checks.usable_bound(F.lit("2024-01-03T00:00:00Z"), 300, at)) is None
    assert one(spark, checks.usable_bound(F.lit("soon"), 300, at)) is None


@pytest.mark.parametrize("parts", [1, 5])
def test_sample_is_stable(spark, parts):
    df = spark.range(200).repartition(parts)
    assert col(checks.sample(df, 20)) == col(checks.sample(spark.range(200), 20))


def test_bad_keys(spark):
    found = {(r["id"], r["reason"]) for r in checks.bad_keys(ids(spark, ["a", "a", "", None, None, "b"])).collect()}
    assert found == {("a", "duplicate"), ("", "empty"), (None, "null")}
    row = checks.completeness(ids(spark, ["a", "a", "b", None])).first()
    assert (row["counted"], row["exported"], row["complete"]) == (4, 2, False)


# ---- generators and files -----------------------------------------------------------------------


def test_documents_are_deterministic_and_in_range(spark):
    docs = synth.generate_documents(spark, 400)
    again = synth.documents_for(spark.range(400).repartition(7), column="id")
    assert diff.diff(docs, again).where("status <> 'same'").count() == 0
    bad = docs.where(
        "price not between 1 and 5000 or size(reviews) > 3 or size(variants) not between 1 and 4 "
        "or size(tags) not between 1 and 4 or size(tags) <> size(array_distinct(tags)) "
        "or size(attributes) not between 3 and 6 or size(shipping.regions) not between 1 and 3 "
        "or length(barcode) <> 13 or year(created_at) <> 2023 or not variants[0].is_default "
        "or exists(slice(variants, 2, 9), v -> v.is_default) or location.lat not between -90 and 90"
    )
    assert bad.count() == 0
    spreads = docs.agg(*[F.count_distinct(F.size(c)).alias(c) for c in ("reviews", "variants", "price_history")]).first()
    assert tuple(spreads) == (4, 4, 4)
    share = docs.agg(F.avg(F.col("is_active").cast("int"))).first()[0]
    assert 0.6 < share < 0.8


def test_mutation_counts_and_disjoint_sets(spark):
    docs = synth.generate_documents(spark, 333).select("id")
    got = synth.mutate(docs, 0.10)
    assert {r["op"]: r["count"] for r in got.groupBy("op").count().collect()} == {"create": 3, "update": 24, "delete": 6}
    assert got.select("id").distinct().count() == 33
    assert col(got.where("op = 'create'")) == ["doc-333", "doc-334", "doc-335"]
    assert {r["op"]: r["count"] for r in synth.mutate(docs).groupBy("op").count().collect()} == {"create": 3, "update": 3, "delete": 2}


def test_pack_matches_the_greedy_rule(spark):
    sizes = [3, 4, 5, 20, 1, 9, 1, 10, 10, 2]
    df = spark.createDataFrame(list(enumerate(sizes)), "id int, size int").coalesce(1)
    parts, filled, want = 0, 0, []
    for n in sizes:
        if filled > 0 and filled + n > 10:
            parts, filled = parts + 1, 0
        filled += n
        want.append(parts)
    got = [r["part_no"] for r in exchange.pack(df, 10).orderBy("id").collect()]
    assert [g - got[0] for g in got] == want


def test_two_line_files_keep_pairs(spark, home):
    rows = [("index", "a", "r", '{"delete":{"_id":"x"}}'), ("delete", "b", None, None), ("index", "c", None, '{"t":"l\\n"}')]
    changes = spark.createDataFrame(rows, "op string, id string, routing string, doc string")
    exchange.write_ndjson(changes, f"{home}/two", two_lines=True)
    back = exchange.read_ndjson(spark, f"{home}/two", two_lines=True)
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    exchange.write_parts(changes, f"{home}/parts", cap=10)
    assert sorted(map(tuple, exchange.read_ndjson(spark, f"{home}/parts", two_lines=True).collect())) == sorted(rows)


@pytest.mark.parametrize("parts", [1, 6])
def test_running_bytes_of_one_hot_part(spark, parts):
    df = spark.range(300).select(
        "id", F.when(F.col("id") % 10 < 8, "hot").otherwise("cold").alias("part"), (F.col("id") % 7).alias("size")
    )
    got = {r["id"]: r["running"] for r in exchange.running_bytes(df.repartition(parts), "part").collect()}
    totals, want = {"hot": 0, "cold": 0}, {}
    for i in range(300):
        part = "hot" if i % 10 < 8 else "cold"
        totals[part] += i % 7
        want[i] = totals[part]
    assert got == want
