"""Deterministic test documents and mutations.

Every value is a function of (seed, id, field), so a document is the same for any partitioning
and after any retry.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsync.functions import hash_int, hash_text, id_suffix, zero_pad
from docsync.operators.journal import number

# The vocabularies of the product documents.
CATEGORIES = ["electronics", "books", "clothing", "home", "toys", "sports", "beauty", "grocery"]
BRANDS = ["acme", "globex", "initech", "umbrella", "wayne", "stark", "wonka", "cyberdyne"]
STATUSES = ["draft", "active", "archived", "out_of_stock"]
COUNTRIES = ["US", "JP", "VN", "DE", "FR", "GB", "IN", "BR"]
CURRENCIES = ["USD", "JPY", "VND", "EUR", "GBP", "INR", "BRL"]
COLORS = ["red", "green", "blue", "black", "white", "silver", "gold"]
SIZES = ["XS", "S", "M", "L", "XL", "XXL"]
MATERIALS = ["cotton", "steel", "plastic", "wood", "glass", "leather"]
WORDS = ["fast", "durable", "compact", "premium", "eco", "smart", "classic", "pro", "lite", "max"]
WEIGHT_CLASSES = ["light", "medium", "heavy", "oversized"]
PRICE_CHANGE_REASONS = ["promotion", "cost_increase", "clearance", "correction"]
ATTRIBUTE_KEYS = [
    "battery_life", "warranty_months", "voltage", "connector_type",
    "water_resistance", "material_grade", "noise_level_db", "screen_size_in",
    "bluetooth_version", "charging_type", "origin_country", "eco_label",
    "assembly_required", "max_load_kg",
]
UPDATED_TITLE = "changed title"
CREATED_TITLE = "added row"

SEED = 42
TEXT_POOL = 2000
ORDER_POOL = 1000


# Steps and primes of the per-row number sequence.
STEP_A, PRIME_A = 40_503, 2_147_483_647
STEP_B, PRIME_B = 69_621, 2_147_483_629
PRIME = 4_294_967_291


class Draws:
    """Hands out the random numbers of one row, in order.

    Two 32-bit numbers ``a`` and ``b`` from the row's md5 start the sequence
    ``((a + k STEP_A) mod PRIME_A) * ((b + k STEP_B) mod PRIME_B) mod PRIME``. Plain integer
    arithmetic is far cheaper than one hash for each of about a hundred values. The expressions
    are given as SQL text, one call each: building them operator by operator took longer than
    running them on a small table.
    """

    def __init__(self, a: str, b: str):
        self._a, self._b, self._k = a, b, 0

    def _text(self) -> str:
        self._k += 1
        left = f"(({self._a} + {self._k * STEP_A}) % {PRIME_A})"
        right = f"(({self._b} + {self._k * STEP_B}) % {PRIME_B})"
        return f"({left} * {right} % {PRIME})"

    def raw(self) -> Column:
        return F.expr(self._text())

    def int(self, low: int, high: int) -> Column:
        return F.expr(f"{self._text()} % {high - low + 1} + {low}")

    def real(self, low: float, high: float, digits: int) -> Column:
        scale = 10**digits
        low, high = round(low * scale), round(high * scale)
        return F.expr(f"cast({self._text()} % {high - low + 1} + {low} as double) / {scale}")

    def pick(self, values: Sequence[str]) -> Column:
        return F.expr(_choice(values, self._text()))

    def chance(self, percent: int) -> Column:
        return F.expr(f"{self._text()} % 100 < {percent}")


def _choice(values: Sequence[str], draw: str) -> str:
    listed = ", ".join(f"'{v}'" for v in values)
    return f"element_at(array({listed}), cast({draw} % {len(values)} + 1 as int))"


def orders_of(values: Sequence[str], size: int = ORDER_POOL) -> list[list[str]]:
    """Pool of random orders of a short list: order ``p`` sorts by md5("order|p|value")."""
    def rank(p: int, value: str) -> str:
        return hashlib.md5(f"order|{p}|{value}".encode()).hexdigest()

    return [sorted(values, key=lambda value, p=p: rank(p, value)) for p in range(size)]


def pick_some(orders: Column, draw: Column, k: Column) -> Column:
    """``k`` different values: the first ones of a randomly chosen order."""
    order = F.element_at(orders, (draw % ORDER_POOL + 1).cast("int"))
    return F.slice(order, F.lit(1), k.cast("int"))


def sentence_pool(low: int, high: int, size: int = TEXT_POOL) -> list[str]:
    """Sentences of ``low`` to ``high`` words (at most 20), built once from a rule.

    Sentence ``p`` has its length in the first eight digits of md5("pool|p") and word ``j`` in
    the three digits from position ``j`` on.
    """
    pool = []
    for p in range(size):
        text = hashlib.md5(f"pool|{p}".encode()).hexdigest()
        length = int(text[:8], 16) % (high - low + 1) + low
        pool.append(" ".join(WORDS[int(text[j : j + 3], 16) % len(WORDS)] for j in range(length)))
    return pool


def constant_array(values: Sequence, dtype: str = "array<string>") -> Column:
    """A list as one literal, folded to a constant before execution."""
    return F.from_json(F.lit(json.dumps(values)), dtype)


def _sized(n: Column, items: Sequence[Column]) -> Column:
    """The first ``n`` of the prepared elements (none for 0)."""
    return F.slice(F.array(*items), F.lit(1), n.cast("int"))


def _moment(d: Draws, year: int) -> Column:
    month, day = d.int(1, 12), d.int(1, 28)
    hour, minute = d.int(0, 23), d.int(0, 59)
    parts = [F.lit(year), month, day, hour, minute]
    return F.make_timestamp(*[p.cast("int") for p in parts], F.lit(0), F.lit("UTC"))


def documents_for(ids: DataFrame, seed: int = SEED, column: str = "i") -> DataFrame:
    """Product documents, one for each number in ``ids[column]``."""
    i = F.col("_i")
    number_col = F.col(column).cast("bigint")
    hashed = ids.select(number_col.alias("_i"), hash_text(seed, number_col).alias("_h"))
    base = hashed.select("_i", hash_int(F.col("_h"), 0).alias("_a"), hash_int(F.col("_h"), 1).alias("_b"))
    descriptions = constant_array(sentence_pool(6, 20))
    comments = constant_array(sentence_pool(3, 10))
    word_orders, key_orders, country_orders = (
        constant_array(orders_of(v), "array<array<string>>") for v in (WORDS, ATTRIBUTE_KEYS, COUNTRIES)
    )
    d = Draws("_a", "_b")
    cents = d.int(100, 500_000)
    price = cents.cast("double") / 100

    def scaled(low: int, high: int) -> Column:
        """Base price times a factor in thousandths, in whole cents."""
        return F.floor((cents * d.int(low, high) + 500) / 1000).cast("double") / 100

    sku = F.concat(F.lit("SKU-"), zero_pad(i, 8))
    fields: dict[str, Column] = {
        "id": F.concat(F.lit("doc-"), i.cast("string")),
        "sku": sku,
        "title": F.concat_ws(" ", F.lit("Product"), i.cast("string"), d.pick(WORDS)),
        "description": F.element_at(descriptions, d.int(1, TEXT_POOL).cast("int")),
        "category": d.pick(CATEGORIES),
        "sub_category": d.pick(CATEGORIES),
        "brand": d.pick(BRANDS),
        "status": d.pick(STATUSES),
        "country_code": d.pick(COUNTRIES),
        "currency": d.pick(CURRENCIES),
        "price": price,
        "discount": d.real(0, 0.9, 2).cast("float"),
        "rating": d.real(1, 5, 1).cast("float"),
        "views": d.int(0, 1_000_000),
        "stock": d.int(0, 10_000).cast("int"),
        "sold_count": d.int(0, 500_000),
        "weight_kg": d.real(0.1, 50, 2).cast("float"),
        "width_cm": d.real(1, 200, 1).cast("float"),
        "height_cm": d.real(1, 200, 1).cast("float"),
        "depth_cm": d.real(1, 200, 1).cast("float"),
        "is_active": d.chance(70),
        "is_featured": d.chance(20),
        "in_stock": d.chance(80),
        "created_at": _moment(d, 2023),
        "updated_at": _moment(d, 2024),
        "published_at": F.make_timestamp(
            F.lit(2024), d.int(1, 12).cast("int"), F.lit(1), F.lit(0), F.lit(0), F.lit(0), F.lit("UTC")
        ),
        "client_ip": F.concat_ws(
            ".", *[d.int(lo, hi).cast("string") for lo, hi in ((1, 223), (0, 255), (0, 255), (1, 254))]
        ),
        "location": F.struct(
            d.real(-90, 90, 5).alias("lat"), d.real(-180, 180, 5).alias("lon")
        ),
        "seller_id": F.concat(F.lit("seller-"), d.int(1, 50_000).cast("string")),
        "seller_name": F.concat(F.lit("Seller "), d.int(1, 50_000).cast("string")),
        "warehouse_code": F.concat(F.lit("WH-"), d.pick(COUNTRIES)),
        "supplier_id": F.concat(F.lit("sup-"), d.int(1, 20_000).cast("string")),
        "barcode": zero_pad(
            (d.raw() % 10_000_000 * 1_000_000 + d.raw() % 1_000_000) % 9_999_999_999_999 + 1, 13
        ),
        "color": d.pick(COLORS),
        "size": d.pick(SIZES),
        "material": d.pick(MATERIALS),
        "rank": d.int(1, 100_000).cast("int"),
        "score": d.real(0, 100, 4),
    }
    fields["reviews"] = _sized(
        d.int(0, 3),
        [
            F.struct(
                F.concat(F.lit("user-"), d.int(1, 100_000).cast("string")).alias("author"),
                d.int(1, 5).cast("int").alias("rating"),
                F.element_at(comments, d.int(1, TEXT_POOL).cast("int")).alias("comment"),
            )
            for _ in range(3)
        ],
    )
    fields["variants"] = _sized(
        d.int(1, 4),
        [
            F.struct(
                F.concat(sku, F.lit(f"-V{v}")).alias("sku"),
                d.pick(COLORS).alias("color"),
                d.pick(SIZES).alias("size"),
                scaled(800, 1200).alias("price"),
                d.int(0, 5000).cast("int").alias("stock"),
                F.lit(v == 0).alias("is_default"),
            )
            for v in range(4)
        ],
    )
    fields["price_history"] = _sized(
        d.int(0, 3),
        [
            F.struct(
                F.make_timestamp(
                    F.lit(2022), d.int(1, 12).cast("int"), d.int(1, 28).cast("int"),
                    F.lit(0), F.lit(0), F.lit(0), F.lit("UTC"),
                ).alias("changed_at"),
                scaled(700, 1300).alias("old_price"),
                price.alias("new_price"),
                d.pick(PRICE_CHANGE_REASONS).alias("reason"),
            )
            for _ in range(3)
        ],
    )
    tag_count, key_count, region_count = d.int(1, 4), d.int(3, 6), d.int(1, 3)
    values = [F.concat_ws("-", d.pick(WORDS), d.int(1, 999).cast("string")) for _ in range(6)]
    fields["tags"] = pick_some(word_orders, d.raw(), tag_count)
    fields["attributes"] = F.map_from_arrays(
        pick_some(key_orders, d.raw(), key_count), _sized(key_count, values)
    )
    fields["shipping"] = F.struct(
        d.pick(WEIGHT_CLASSES).alias("weight_class"),
        d.chance(50).alias("free_shipping"),
        d.int(1, 14).cast("int").alias("handling_days"),
        pick_some(country_orders, d.raw(), region_count).alias("regions"),
    )
    return base.select(*[col.alias(name) for name, col in fields.items()])


def generate_documents(spark: SparkSession, n: int, seed: int = SEED) -> DataFrame:
    """Documents ``doc-0`` to ``doc-<n-1>``."""
    return documents_for(spark.range(n), seed, "id")


def mutation_counts(total: int, pct: float, ratios: tuple[float, float, float]) -> tuple[int, int, int]:
    """How many rows to create, update and delete; updates take what rounding leaves."""
    touched = int(total * pct)
    create, delete = int(touched * ratios[0]), int(touched * ratios[2])
    return create, touched - create - delete, delete


def mutate(
    df: DataFrame,
    pct: float | None = None,
    ratios: tuple[float, float, float] = (0.10, 0.70, 0.20),
    seed: int = SEED,
    at: dt.datetime | Column = dt.datetime(2024, 12, 31),
    counts: tuple[int, int, int] = (3, 3, 2),
) -> DataFrame:
    """Change set of creates, updates and deletes against ``df`` (ids ``<text>-<number>``).

    With ``pct`` that share of the rows is touched, split by ``ratios`` (create, update, delete);
    otherwise ``counts`` says how many of each. Updates and deletes are different rows, drawn
    without replacement in hash order. Created ids continue after the largest number. Columns a
    change does not set are null.
    """
    facts = df.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.max(id_suffix(F.col("id"))), F.lit(-1)).alias("top")
    ).first()
    create, update, delete = counts if pct is None else mutation_counts(facts["n"], pct, ratios)
    moment = (at if isinstance(at, Column) else F.lit(at)).cast("timestamp")
    drawn = number(df.select("id"), seed=seed).where(F.col("seq") <= update + delete)
    is_update = F.col("seq") <= update
    touched = drawn.select(
        F.when(is_update, "update").otherwise("delete").alias("op"),
        "id",
        F.lit(None).cast("string").alias("sku"),
        F.when(
            is_update,
            F.concat_ws(" ", F.lit(UPDATED_TITLE), id_suffix(F.col("id")).cast("string")),
        ).alias("title"),
        F.lit(None).cast("string").alias("status"),
        F.lit(None).cast("boolean").alias("is_active"),
        F.lit(None).cast("boolean").alias("in_stock"),
        F.lit(None).cast("double").alias("price"),
        F.lit(None).cast("timestamp").alias("created_at"),
        F.when(is_update, moment).alias("updated_at"),
        F.when(is_update, moment).alias("modified_at"),
    )
    number_text = F.col("i").cast("string")
    first = facts["top"] + 1
    numbers = df.sparkSession.range(first, first + create).toDF("i")
    text = hash_text(seed, F.col("i"), "create")
    drawn_numbers = numbers.select("i", hash_int(text).alias("_w"), hash_int(text, 1).alias("_p"))
    created = drawn_numbers.select(
        F.lit("create").alias("op"),
        F.concat(F.lit("doc-"), number_text).alias("id"),
        F.concat(F.lit("SKU-NEW-"), number_text).alias("sku"),
        F.concat_ws(" ", F.lit(CREATED_TITLE), number_text, F.expr(_choice(WORDS, "_w"))).alias("title"),
        F.lit("active").alias("status"),
        F.lit(True).alias("is_active"),
        F.lit(True).alias("in_stock"),
        ((F.col("_p") % 499_901 + 100).cast("double") / 100).alias("price"),
        moment.alias("created_at"),
        moment.alias("updated_at"),
        moment.alias("modified_at"),
    )
    return touched.unionByName(created)


def apply_mutations(df: DataFrame, changes: DataFrame) -> DataFrame:
    """The table after a mutation change set, with the columns of both."""
    from docsync.operators.apply import apply_deletes, apply_merge

    for field in changes.schema.fields:
        if field.name not in df.columns and field.name != "op":
            df = df.withColumn(field.name, F.lit(None).cast(field.dataType))
    kept = apply_deletes(df, changes.where("op = 'delete'"))
    return apply_merge(kept, changes.where("op <> 'delete'").drop("op"))


__all__ = [
    "apply_mutations", "documents_for", "generate_documents", "mutate", "mutation_counts",
]
