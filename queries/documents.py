"""Queries on single documents: schema, scalars, generation, interchange files."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsync import functions as fn
from docsync.functions.types import struct_of
from docsync.operators import schema
from docsync.operators.extract import clean_ids
from docsync.session import fresh_dir, materialize, spread
from docsync.sources import documents, exchange, journal_store, synth
from queries import compare
from queries import fixtures as fx
from queries.fixtures import pair_sql


def q_align(spark, sf):
    """Lineitems to a target with other types, a missing and a surplus column."""
    wanted = T.StructType([
        T.StructField("orderkey", T.StringType()),
        T.StructField("l_linenumber", T.LongType()),
        T.StructField("l_quantity", T.IntegerType()),
        T.StructField("l_returnflag", T.IntegerType()),
        T.StructField("info", struct_of(mode="string", flag="string")),
        T.StructField("absent", T.DoubleType()),
    ])
    lines = spread(fx.table(spark, sf, "lineitem")).select(
        F.col("l_orderkey").alias("orderkey"), "l_linenumber", "l_quantity", "l_returnflag", "l_tax",
        F.struct(F.col("l_linestatus").alias("flag"), F.col("l_suppkey").alias("supp")).alias("info"),
    )
    out = schema.align(lines, wanted)
    return out.select("orderkey", "l_linenumber", "l_quantity", "l_returnflag", "info.mode", "info.flag", "absent")


def q_misfit(spark, sf):
    """How many lineitem rows a stricter target would reject, and why."""
    wanted = struct_of(l_orderkey="bigint", l_linenumber="bigint", flag="int", l_tax="double")
    lines = fx.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.when(F.col("l_linenumber") == 3, F.col("l_returnflag")).otherwise("7").alias("flag"),
        F.when(F.col("l_linenumber") == 5, F.col("l_tax")).alias("surplus"),
    )
    reasons = lines.withColumn("reason", F.coalesce(schema.misfit(lines, wanted, True), F.lit("fits")))
    return reasons.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def q_drop_columns(spark, sf):
    events = fx.table(spark, sf, "events").select(
        "event_id", "event_type", F.col("ts").alias("@timestamp"), F.lit("1").alias("@version")
    )
    left = schema.drop_columns(events)
    return left.withColumn("width", F.lit(len(left.columns)))


def q_stamp(spark, sf):
    rows = fx.source(spark, sf).select("id", F.col("ts").alias("modified_at"))
    return schema.stamp(rows, "modified_at", fx.ntz(fx.CUTOVER))


def q_clean_ids(spark, sf):
    n = F.col("event_id")
    text = F.concat(F.lit("doc-"), n.cast("string"))
    lines = fx.table(spark, sf, "events").select(
        F.when(n % 10 == 0, F.concat(text, F.lit("\r"))).when(n % 10 == 1, "").when(n % 10 == 2, "\r").otherwise(text).alias("id")
    )
    return clean_ids(lines)


def q_dates(spark, sf):
    n, ts = F.col("event_id"), F.col("ts")
    millis = F.unix_millis(ts.cast("timestamp")).cast("string")
    text = (
        F.when(n % 4 == 0, F.date_format(ts, fn.scalars.ISO_FORMAT))
        .when(n % 4 == 1, millis)
        .when(n % 12 == 2, F.date_format(ts, "yyyy-MM-dd"))
        .when(n % 12 == 6, F.date_format(ts, "yyyy"))
        .when(n % 12 == 10, F.date_format(ts, "yyyy-MM"))
        .when(n % 12 == 3, F.date_format(ts, "HH:mm"))
        .when(n % 12 == 7, F.lit("2024-1-5"))
        .otherwise("yesterday")
    )
    parsed = fx.table(spark, sf, "events").select(n, text.alias("text")).withColumn("at", fn.parse_date(F.col("text")))
    return parsed.select(
        "event_id", F.col("at").cast("timestamp_ntz").alias("moment"), fn.iso(F.col("at")).alias("iso"),
        fn.epoch(F.col("at")).alias("epoch"), fn.run_id(F.col("at")).alias("run_id"),
        fn.minus_seconds(F.col("at"), 300).cast("timestamp_ntz").alias("earlier"),
    )


def q_canonical_json(spark, sf):
    n = F.regexp_extract("props", r"(\d+)", 1)
    text = F.concat(F.lit('{ "z":1.0, "k":'), n, F.lit('e0,"a":{"y":null,"x":[3,1,"b \\" 2.0,"]},"s":"1.0"}'))
    return spread(fx.table(spark, sf, "events").select("event_id", "props", "event_type")).select(
        "event_id", fn.canonical_json(text).alias("json"), fn.canonical_json(F.col("event_type")).alias("raw")
    )


def q_strings(spark, sf):
    docs = fx.table(spark, sf, "documents")
    return docs.select(
        "doc_id", fn.byte_len(F.col("text")).alias("bytes"),
        fn.collapse_ws(F.col("text"), 120).alias("head"),
        fn.zero_pad(F.col("doc_id"), 8).alias("padded"),
        F.col("text").rlike("cluster_block|[0-9]{3}").alias("hit"),
    )


def q_id_suffix(spark, sf):
    names = fx.table(spark, sf, "customer").select(
        "c_custkey", F.when(F.col("c_custkey") % 5 == 0, F.col("c_name")).otherwise(F.concat(F.lit("doc-"), F.col("c_custkey").cast("string"))).alias("id")
    )
    return names.select("c_custkey", fn.id_suffix(F.col("id")).alias("suffix"))


def _product_text(doc):
    cents = lambda c: F.round(c * 100).cast("bigint").cast("string")
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    join = lambda col, f: F.array_join(F.transform(col, f), ";")
    return doc.select(
        "id", "sku", "title", "description", "category", "sub_category", "brand", "status", "country_code",
        "currency", "price", F.col("discount").cast("double").alias("discount"),
        F.col("rating").cast("double").alias("rating"), "views", "stock", "sold_count",
        F.col("weight_kg").cast("double").alias("weight_kg"), F.col("width_cm").cast("double").alias("width_cm"),
        F.col("height_cm").cast("double").alias("height_cm"), F.col("depth_cm").cast("double").alias("depth_cm"),
        "is_active", "is_featured", "in_stock",
        *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("created_at", "updated_at", "published_at")],
        "client_ip", F.col("location.lat").alias("lat"), F.col("location.lon").alias("lon"), "seller_id",
        "seller_name", "warehouse_code", "supplier_id", "barcode", "color", "size", "material", "rank", "score",
        join("reviews", lambda r: F.concat_ws(":", r.author, r.rating.cast("string"), r.comment)).alias("reviews"),
        join("variants", lambda v: F.concat_ws(":", v.sku, v.color, v.size, cents(v.price), v.stock.cast("string"), v.is_default.cast("string"))).alias("variants"),
        join("price_history", lambda h: F.concat_ws(":", day(h.changed_at), cents(h.old_price), cents(h.new_price), h.reason)).alias("price_history"),
        F.array_join("tags", ";").alias("tags"),
        F.array_join(F.array_sort(F.transform(F.map_entries("attributes"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";").alias("attributes"),
        F.concat_ws(":", "shipping.weight_class", F.col("shipping.free_shipping").cast("string"), F.col("shipping.handling_days").cast("string"), F.array_join("shipping.regions", ",")).alias("shipping"),
        documents.is_ip(F.col("client_ip")).alias("ip_ok"),
    )


def q_generate(spark, sf):
    """One product document per order."""
    orders = spread(fx.table(spark, sf, "orders").select("o_orderkey"))
    return _product_text(synth.documents_for(orders, column="o_orderkey"))


def q_mutate(spark, sf):
    ids = fx.table(spark, sf, "orders").select(F.concat(F.lit("doc-"), F.col("o_orderkey").cast("string")).alias("id"))
    out = synth.mutate(ids, 0.10, at=fx.CUTOVER)
    return out.select("op", "id", "sku", "title", "status", "is_active", "price", F.col("updated_at").cast("timestamp_ntz").alias("updated_at"))


def q_mutate_apply(spark, sf):
    """The mutated table: updates merged, deletes gone, creates added."""
    ids = fx.table(spark, sf, "orders").select(
        F.concat(F.lit("doc-"), F.col("o_orderkey").cast("string")).alias("id"), F.col("o_orderpriority").alias("title")
    )
    return synth.apply_mutations(ids, synth.mutate(ids, 0.10, at=fx.CUTOVER)).select("id", "title", "sku")


def q_running_bytes(spark, sf):
    docs = fx.table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.col("lang").alias("part"), F.octet_length("text").alias("size")
    )
    return exchange.running_bytes(docs, "part")


def q_pack(spark, sf):
    """Totals over packed parts.

    No part of several rows may exceed the cap, and no part may leave out a next row that fits.
    """
    docs = fx.table(spark, sf, "documents").select("doc_id", F.octet_length("text").alias("size"))
    packed = materialize(exchange.pack(docs, 20_000).withColumn("place", F.monotonically_increasing_id()), "packed")
    parts = packed.groupBy("part_no").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").cast("bigint").alias("bytes"), F.min_by("size", "place").alias("first")
    )
    run = Window.partitionBy(F.shiftright("part_no", 32)).orderBy("part_no")
    parts = parts.withColumn("next", F.lead("first").over(run))
    return parts.agg(
        F.count_if(F.col("bytes") + F.col("next") <= 20_000).alias("loose"),
        F.sum("n").alias("docs"), F.sum("bytes").alias("bytes"),
        F.count_if((F.col("n") > 1) & (F.col("bytes") > 20_000)).alias("too_large"),
    )


def _change_set(spark, sf):
    """Deletes, routed and unrouted upserts with their documents as JSON."""
    upserts = fx.changes(spark, sf).select(
        F.lit("index").alias("op"), "id", F.when(F.col("cust") % 2 == 0, F.col("cust").cast("string")).alias("routing"),
        F.to_json(F.struct("status", "prio", F.lit("tab\tand\nline").alias("t"))).alias("doc"),
    )
    gone = fx.to_delete(spark, sf).select(
        F.lit("delete").alias("op"), "id", F.lit(None).cast("string").alias("routing"), F.lit(None).cast("string").alias("doc")
    )
    return upserts.unionByName(gone)


def _doc_fields(df, form):
    return df.select(
        F.lit(form).alias("form"), "op", "id", "routing", F.get_json_object("doc", "$.status").alias("status"),
        F.get_json_object("doc", "$.t").alias("t"),
    )


def q_ndjson(spark, sf):
    """Written and read back as one line, two lines, and byte-capped two-line parts."""
    changes, base = _change_set(spark, sf), fresh_dir(spark, "ndjson")
    exchange.write_ndjson(changes, f"{base}/one")
    exchange.write_ndjson(changes, f"{base}/two", two_lines=True)
    exchange.write_parts(changes, f"{base}/parts", cap=20_000)
    out = _doc_fields(exchange.read_ndjson(spark, f"{base}/one"), "one")
    out = out.unionByName(_doc_fields(exchange.read_ndjson(spark, f"{base}/two", True), "two"))
    return out.unionByName(_doc_fields(exchange.read_ndjson(spark, f"{base}/parts", True), "parts"))


def q_journal_tsv(spark, sf):
    path = fresh_dir(spark, "tsv")
    journal_store.write_journal_tsv(compare.full_journal(spark, sf), path)
    back = journal_store.read_journal_tsv(spark, path)
    return back.select(
        "seq", "id", "op", "found", F.get_json_object("source", "$.status").alias("status"),
        F.get_json_object("source", "$.prio").alias("prio"),
    )


MAPPING = {
    "mappings": {
        "_doc": {
            "properties": {
                "id": {"type": "keyword"},
                "kind": {"type": "text", "fields": {"keyword": {"type": "keyword", "ignore_above": 5}}},
                "at": {"type": "date"},
                "value": {"type": "double"},
                "count": {"type": "integer"},
                "where": {"type": "geo_point"},
                "tags": {"type": "keyword"},
                "attributes": {"type": "object"},
                "lines": {"type": "nested", "properties": {"n": {"type": "long"}, "seen": {"type": "date"}}},
            }
        }
    }
}


def q_typed_read(spark, sf):
    """Event documents as JSON lines, read back by a mapping; both wrapper forms, bad rows aside."""
    n, ts = F.col("event_id"), F.col("ts").cast("timestamp")
    when = F.when(n % 2 == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).otherwise(F.unix_millis(ts).cast("string"))
    doc = F.to_json(F.struct(
        F.concat(F.lit("e-"), n.cast("string")).alias("id"), F.col("event_type").alias("kind"),
        F.when(n % 53 == 0, "never").otherwise(when).alias("at"), "value",
        (n % 1000).alias("count"), F.struct((n % 90).cast("double").alias("lat"), F.lit(1.5).alias("lon")).alias("where"),
        F.array(F.lit("a"), F.col("event_type")).alias("tags"), F.create_map(F.lit("u"), F.col("user_id").cast("string")).alias("attributes"),
        F.array(F.struct(n.alias("n"), when.alias("seen"))).alias("lines"),
    ))
    path = fresh_dir(spark, "typed")
    fx.table(spark, sf, "events").select(
        F.when(n % 101 == 0, "{oops").when(n % 103 == 0, F.regexp_replace(doc, '"count":', '"count":"x","c":')).otherwise(doc).alias("value")
    ).write.text(path)
    flat = {"mappings": {"properties": documents.properties(MAPPING)}}
    good, _ = documents.read_documents(spark, path, MAPPING, arrays=["tags"])
    _, bad = documents.read_documents(spark, path, flat, arrays=["tags"])
    good = documents.with_subfields(good, MAPPING)
    typed = good.select(
        "id", "kind_keyword", F.col("at").cast("timestamp_ntz").alias("at"), "value", "count", "where.lat",
        F.array_join("tags", ",").alias("tags"), F.col("attributes")["u"].alias("user"),
        F.col("lines")[0]["n"].alias("line"), F.lit("ok").alias("outcome"),
    )
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in typed.schema.fields if f.name not in ("id", "outcome")]
    aside = bad.select(F.get_json_object("value", "$.id").alias("id"), *none, F.col("reject").alias("outcome"))
    return typed.unionByName(aside)


QUERIES = {n: f for n, f in list(globals().items()) if n.startswith("q_") and callable(f)}


class _Rule:
    """SQL text of the generator's number sequence, written down from its definition."""

    def __init__(self):
        self.k = 0

    def raw(self):
        self.k += 1
        k = self.k
        return f"(((a + {k * 40503}) % 2147483647) * ((b + {k * 69621}) % 2147483629) % 4294967291)"

    def int(self, low, high):
        return f"({self.raw()} % {high - low + 1} + {low})"

    def real(self, low, high, scale):
        return f"(CAST({self.int(round(low * scale), round(high * scale))} AS DOUBLE) / {scale})"

    def pick(self, values):
        return f"{_list(values)}[CAST({self.raw()} % {len(values)} + 1 AS INTEGER)]"

    def chance(self, percent):
        return f"({self.raw()} % 100 < {percent})"


def _list(values):
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _sentence(p, low, high):
    """Sentence p (from 1) of the pool, by its rule."""
    text = f"md5('pool|' || ({p} - 1))"
    size = f"(CAST('0x' || substr({text}, 1, 8) AS BIGINT) % {high - low + 1} + {low})"
    word = f"{_list(synth.WORDS)}[CAST(CAST('0x' || substr({text}, CAST(j AS BIGINT) + 1, 3) AS BIGINT) % 10 + 1 AS INTEGER)]"
    return f"array_to_string(list_transform(range({size}), lambda j: {word}), ' ')"


def _some(values, draw, k):
    order = f"list_sort(list_transform({_list(values)}, lambda v: md5('order|' || ({draw} % 1000) || '|' || v) || v))"
    return f"list_transform(list_slice({order}, 1, {k}), lambda v: substr(v, 33))"


def _cents(expr):
    return f"CAST({expr} AS VARCHAR)"


def _generate_sql():
    r = _Rule()
    s = synth
    price = r.int(100, 500_000)

    def scaled(low, high):
        return f"CAST(floor((cents * {r.int(low, high)} + 500) / 1000) AS BIGINT)"

    def moment(year):
        m, d, h, i = r.int(1, 12), r.int(1, 28), r.int(0, 23), r.int(0, 59)
        return f"make_timestamp({year}, {m}, {d}, {h}, {i}, 0)"

    cols = {
        "id": "'doc-' || i", "sku": "sku", "title": f"'Product ' || i || ' ' || {r.pick(s.WORDS)}",
        "description": _sentence(r.int(1, 2000), 6, 20), "category": r.pick(s.CATEGORIES),
        "sub_category": r.pick(s.CATEGORIES), "brand": r.pick(s.BRANDS), "status": r.pick(s.STATUSES),
        "country_code": r.pick(s.COUNTRIES), "currency": r.pick(s.CURRENCIES),
        "price": "CAST(cents AS DOUBLE) / 100",
        "discount": f"CAST(CAST({r.real(0, 0.9, 100)} AS FLOAT) AS DOUBLE)",
        "rating": f"CAST(CAST({r.real(1, 5, 10)} AS FLOAT) AS DOUBLE)",
        "views": r.int(0, 1_000_000), "stock": r.int(0, 10_000), "sold_count": r.int(0, 500_000),
    }
    for name, low, high, scale in (("weight_kg", 0.1, 50, 100), ("width_cm", 1, 200, 10), ("height_cm", 1, 200, 10), ("depth_cm", 1, 200, 10)):
        cols[name] = f"CAST(CAST({r.real(low, high, scale)} AS FLOAT) AS DOUBLE)"
    cols |= {"is_active": r.chance(70), "is_featured": r.chance(20), "in_stock": r.chance(80)}
    cols |= {"created_at": moment(2023), "updated_at": moment(2024)}
    cols["published_at"] = f"make_timestamp(2024, {r.int(1, 12)}, 1, 0, 0, 0)"
    cols["client_ip"] = " || '.' || ".join(f"CAST({r.int(lo, hi)} AS VARCHAR)" for lo, hi in ((1, 223), (0, 255), (0, 255), (1, 254)))
    cols |= {"lat": r.real(-90, 90, 100_000), "lon": r.real(-180, 180, 100_000)}
    cols |= {"seller_id": f"'seller-' || {r.int(1, 50_000)}", "seller_name": f"'Seller ' || {r.int(1, 50_000)}"}
    cols |= {"warehouse_code": f"'WH-' || {r.pick(s.COUNTRIES)}", "supplier_id": f"'sup-' || {r.int(1, 20_000)}"}
    high, low = r.raw(), r.raw()
    cols["barcode"] = f"lpad(CAST(({high} % 10000000 * 1000000 + {low} % 1000000) % 9999999999999 + 1 AS VARCHAR), 13, '0')"
    cols |= {"color": r.pick(s.COLORS), "size": r.pick(s.SIZES), "material": r.pick(s.MATERIALS)}
    cols |= {"rank": r.int(1, 100_000), "score": r.real(0, 100, 10_000)}

    def sized(n, items):
        return f"array_to_string(list_slice([{', '.join(items)}], 1, {n}), ';')"

    n = r.int(0, 3)
    cols["reviews"] = sized(n, [f"'user-' || {r.int(1, 100_000)} || ':' || {r.int(1, 5)} || ':' || {_sentence(r.int(1, 2000), 3, 10)}" for _ in range(3)])
    n, items = r.int(1, 4), []
    for v in range(4):
        color, size, cost, stock = r.pick(s.COLORS), r.pick(s.SIZES), scaled(800, 1200), r.int(0, 5000)
        items.append(f"sku || '-V{v}:' || {color} || ':' || {size} || ':' || {cost} || ':' || {stock} || ':{'true' if v == 0 else 'false'}'")
    cols["variants"] = sized(n, items)
    n, items = r.int(0, 3), []
    for _ in range(3):
        month, day, old, why = r.int(1, 12), r.int(1, 28), scaled(700, 1300), r.pick(s.PRICE_CHANGE_REASONS)
        items.append(f"strftime(make_date(2022, {month}, {day}), '%Y-%m-%d') || ':' || {old} || ':' || cents || ':' || {why}")
    cols["price_history"] = sized(n, items)
    tags, keys, regions = r.int(1, 4), r.int(3, 6), r.int(1, 3)
    values = [f"{r.pick(s.WORDS)} || '-' || {r.int(1, 999)}" for _ in range(6)]
    cols["tags"] = f"array_to_string({_some(s.WORDS, r.raw(), tags)}, ';')"
    chosen = _some(s.ATTRIBUTE_KEYS, r.raw(), keys)
    cols["attributes"] = (
        f"array_to_string(list_sort(list_transform({chosen}, lambda x, y: x || '=' || [{', '.join(values)}][y])), ';')"
    )
    weight, free, days = r.pick(s.WEIGHT_CLASSES), r.chance(50), r.int(1, 14)
    where = f"array_to_string({_some(s.COUNTRIES, r.raw(), regions)}, ',')"
    cols["shipping"] = f"{weight} || ':' || {free} || ':' || {days} || ':' || {where}"
    cols["ip_ok"] = "true"
    body = ", ".join(f"{expr} AS {name}" for name, expr in cols.items())
    return f"""WITH h AS (SELECT o_orderkey AS i, md5('42|' || o_orderkey) AS h FROM orders),
      p AS (SELECT i, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS b FROM h),
      q AS (SELECT *, {price} AS cents,
              'SKU-' || CASE WHEN i >= 100000000 THEN CAST(i AS VARCHAR) ELSE lpad(CAST(i AS VARCHAR), 8, '0') END AS sku FROM p)
      SELECT {body} FROM q"""


_MUTATION = """WITH t AS (SELECT count(*) AS n, max(o_orderkey) AS top FROM orders),
  c AS (SELECT CAST(floor(n * 0.1) AS BIGINT) AS touch, top FROM t),
  d AS (SELECT CAST(floor(touch * 0.1) AS BIGINT) AS cr, CAST(floor(touch * 0.2) AS BIGINT) AS de, touch, top FROM c),
  ids AS (SELECT o_orderkey AS i, 'doc-' || o_orderkey AS id, o_orderpriority AS prio FROM orders),
  r AS (SELECT i, id, row_number() OVER (ORDER BY md5(id || '|42'), id) AS seq FROM ids),
  u AS (SELECT r.* FROM r, d WHERE seq <= touch - cr - de),
  x AS (SELECT r.* FROM r, d WHERE seq > touch - cr - de AND seq <= touch - cr),
  w AS (SELECT top + g.g AS i, md5('42|' || (top + g.g) || '|create') AS h
        FROM d, (SELECT unnest(range(1, 1 + (SELECT cr FROM d))) AS g) g),
  n AS (SELECT i, 'doc-' || i AS id, 'SKU-NEW-' || i AS sku,
          'added row ' || i || ' ' ||
          ['fast', 'durable', 'compact', 'premium', 'eco', 'smart', 'classic', 'pro', 'lite', 'max'][CAST(CAST('0x' || substr(h, 1, 8) AS BIGINT) % 10 + 1 AS INTEGER)] AS title,
          CAST(CAST('0x' || substr(h, 9, 8) AS BIGINT) % 499901 + 100 AS DOUBLE) / 100 AS price FROM w)
"""

ORACLE = {
    "q_align": """SELECT CAST(l_orderkey AS VARCHAR) AS orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
        CAST(trunc(l_quantity) AS INTEGER) AS l_quantity, CAST(NULL AS INTEGER) AS l_returnflag,
        CAST(NULL AS VARCHAR) AS mode, l_linestatus AS flag, CAST(NULL AS DOUBLE) AS absent FROM lineitem""",
    "q_misfit": """SELECT CASE WHEN l_linenumber = 3 THEN 'mapper_parsing_exception'
        WHEN l_linenumber = 5 THEN 'strict_dynamic_mapping_exception' ELSE 'fits' END AS reason, count(*) AS n
        FROM lineitem GROUP BY 1""",
    "q_drop_columns": "SELECT event_id, event_type, 2 AS width FROM events",
    "q_stamp": pair_sql("SELECT id, TIMESTAMP '2001-01-01 00:00:00' AS modified_at FROM src"),
    "q_clean_ids": "SELECT 'doc-' || event_id AS id FROM events WHERE event_id % 10 NOT IN (1, 2)",
    "q_dates": """WITH t AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN date_trunc('second', ts)
          WHEN 1 THEN date_trunc('millisecond', ts)
          WHEN 2 THEN CAST(CASE event_id % 12 WHEN 2 THEN date_trunc('day', ts) WHEN 6 THEN date_trunc('year', ts) ELSE date_trunc('month', ts) END AS TIMESTAMP)
          END AS moment FROM events)
        SELECT event_id, moment, strftime(moment, '%Y-%m-%dT%H:%M:%SZ') AS iso, CAST(floor(epoch_us(moment) / 1000000) AS BIGINT) AS epoch,
          strftime(moment, '%Y%m%dT%H%M%SZ') AS run_id, moment - INTERVAL 300 SECOND AS earlier FROM t""",
    "q_canonical_json": """SELECT event_id,
        '{"a":{"x":[3,1,"b \\" 2.0,"],"y":null},"k":' || CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) || ',"s":"1.0","z":1}' AS json,
        event_type AS raw FROM events""",
    "q_strings": """SELECT doc_id, octet_length(encode(text)) AS bytes,
        substring(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 120) AS head,
        lpad(CAST(doc_id AS VARCHAR), 8, '0') AS padded, regexp_matches(text, 'cluster_block|[0-9]{3}') AS hit FROM documents""",
    "q_id_suffix": "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN -1 ELSE c_custkey END AS suffix FROM customer",
    "q_generate": _generate_sql(),
    "q_mutate": _MUTATION + """SELECT 'update' AS op, id, CAST(NULL AS VARCHAR) AS sku, 'changed title ' || i AS title,
          CAST(NULL AS VARCHAR) AS status, CAST(NULL AS BOOLEAN) AS is_active, CAST(NULL AS DOUBLE) AS price,
          TIMESTAMP '2001-01-01 00:00:00' AS updated_at FROM u
        UNION ALL SELECT 'delete', id, NULL, NULL, NULL, NULL, NULL, NULL FROM x
        UNION ALL SELECT 'create', id, sku, title, 'active', true, price, TIMESTAMP '2001-01-01 00:00:00' FROM n""",
    "q_mutate_apply": _MUTATION + """SELECT ids.id, CASE WHEN u.id IS NULL THEN prio ELSE 'changed title ' || ids.i END AS title,
          CAST(NULL AS VARCHAR) AS sku FROM ids LEFT JOIN u ON ids.id = u.id WHERE ids.id NOT IN (SELECT id FROM x)
        UNION ALL SELECT id, title, sku FROM n""",
    "q_running_bytes": """SELECT id, part, size, CAST(sum(size) OVER (PARTITION BY part ORDER BY id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running
        FROM (SELECT doc_id AS id, lang AS part, octet_length(encode(text)) AS size FROM documents)""",
    "q_pack": "SELECT count(*) AS docs, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes, 0 AS too_large, 0 AS loose FROM documents",
    "q_ndjson": pair_sql(
        """, c AS (SELECT 'index' AS op, CAST(id AS VARCHAR) AS id, CASE WHEN cust % 2 = 0 THEN CAST(cust AS VARCHAR) END AS routing,
               status, 'tab' || chr(9) || 'and' || chr(10) || 'line' AS t FROM chg
             UNION ALL SELECT 'delete', CAST(id AS VARCHAR), NULL, NULL, NULL FROM del)
           SELECT form, c.* FROM c, (SELECT unnest(['one', 'two', 'parts']) AS form)"""
    ),
    "q_journal_tsv": pair_sql(
        """, ids AS (SELECT id, 'delta' AS op FROM chg UNION ALL SELECT id, 'delete' FROM del UNION ALL SELECT id, 'repair' FROM rep)
           SELECT CAST(row_number() OVER (ORDER BY md5(CAST(i.id AS VARCHAR)), i.id) AS BIGINT) AS seq, CAST(i.id AS VARCHAR) AS id, i.op,
             CASE WHEN t.id IS NULL THEN 0 ELSE 1 END AS found, t.status, t.prio FROM ids i LEFT JOIN tgt t ON i.id = t.id"""
    ),
    "q_typed_read": """WITH e AS (SELECT *, event_id % 101 = 0 AS broken, event_id % 103 = 0 AS badcount, event_id % 53 = 0 AS baddate FROM events)
        SELECT CASE WHEN NOT broken THEN 'e-' || event_id END AS id,
          CASE WHEN fits AND length(event_type) <= 5 THEN event_type END AS kind_keyword,
          CASE WHEN fits THEN CASE WHEN event_id % 2 = 0 THEN ts ELSE date_trunc('millisecond', ts) END END AS at,
          CASE WHEN fits THEN value END AS value, CASE WHEN fits THEN event_id % 1000 END AS count,
          CASE WHEN fits THEN CAST(event_id % 90 AS DOUBLE) END AS lat, CASE WHEN fits THEN 'a,' || event_type END AS tags,
          CASE WHEN fits THEN CAST(user_id AS VARCHAR) END AS "user", CASE WHEN fits THEN event_id END AS line,
          CASE WHEN fits THEN 'ok' ELSE 'mapper_parsing_exception' END AS outcome
        FROM (SELECT *, NOT broken AND NOT badcount AND NOT baddate AS fits FROM e)""",
}
