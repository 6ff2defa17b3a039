"""Benchmark decontamination: windows of test-item words found in training texts.

Built-in functions only. The set of test windows is small against the corpus:

1. A bit map of fixed size over the hashes of all test windows travels in the plan. Each text
   tests its own windows against it inside one row, so that the words of a text are never
   exploded; a handful of windows per text survive.
2. Survivors are verified by an equality join on the window's words themselves. The test side
   is broadcast while its measured size is below ``BROADCAST_BYTES``; beyond, Spark shuffles.
3. Hits are grouped per text. A fuller bit map only makes the first step let more through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsync.session import materialize

WINDOW = 10
BITS = 1 << 19
BROADCAST_BYTES = 32 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# A word in the raw text with what follows it up to the next word.
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
RAW_HEAD = r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"


def words_of(text: Column) -> Column:
    """Lower-case words; a null text has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATOR), "")


def test_windows(bench: DataFrame, window: int) -> DataFrame:
    """``(words, n_words, items)``: each distinct window and the items that hold it."""
    items = bench.select("item_id", words_of(F.col("text").cast("string")).alias("w"))
    items = items.where(F.size("w") > 0).withColumn("size", F.least(F.size("w"), F.lit(window)))
    return (
        items.select(
            "item_id", F.col("size").alias("n_words"),
            F.explode(F.transform(
                F.sequence(F.lit(1), F.size("w") - F.col("size") + 1),
                lambda i: F.array_join(F.slice("w", i, F.col("size")), " "),
            )).alias("words"),
        )
        .groupBy("words", "n_words").agg(F.collect_set("item_id").alias("items"))
    )


def _places(h: Column) -> tuple[Column, Column]:
    """Two bit numbers of a 64-bit hash."""
    return F.pmod(h, F.lit(BITS)), F.pmod(F.shiftrightunsigned(h, 24), F.lit(BITS))


def bit_map(windows: DataFrame) -> Column:
    """The windows' hashes as an array of BITS / 64 longs, a literal of fixed size."""
    hashed = windows.select(F.xxhash64(F.split("words", " ")).alias("h"))
    rows = (
        hashed.select(F.explode(F.array(*_places(F.col("h")))).alias("bit"))
        .groupBy(F.floor(F.col("bit") / 64).alias("at"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("value"))
        .collect()
    )
    values = [0] * (BITS // 64)
    for row in rows:
        values[row["at"]] = row["value"]
    return F.expr(f"cast(split('{','.join(map(str, values))}', ',') as array<bigint>)")


def _candidates(words: Column, n: int, bits: Column) -> Column:
    """Windows of ``n`` words that the bit map lets through: (start, length, words)."""

    def start_or_none(h: Column, i: Column) -> Column:
        one, two = _places(h)
        test = [F.getbit(F.element_at(bits, (b / 64).cast("int") + 1), (b % 64).cast("int")) == 1 for b in (one, two)]
        return F.when(test[0] & test[1], i)

    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(
        F.array().cast("array<int>")
    )
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, F.lit(n))))
    found = F.filter(F.transform(hashes, start_or_none), lambda i: i.isNotNull())
    return F.transform(
        found,
        lambda i: F.struct(
            i.alias("start"), F.lit(n).alias("n_words"),
            F.array_join(F.slice(words, i + 1, F.lit(n)), " ").alias("words"),
        ),
    )


def find_leaks(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(doc_id, text_hash, n_words, hits, items)``, a row per row of ``docs(doc_id, text)``.

    ``hits``: sorted numbers (from 0) of the words inside any occurrence of a test window.
    ``items``: ids of the items with such windows, as sorted strings. A window is ``window``
    words, or all words of a shorter item. Null and wordless texts and items have no windows.
    Repeated rows are answered alike. Other columns are ignored.
    """
    windows = materialize(test_windows(bench, window), "windows")
    facts = windows.agg(
        F.coalesce(F.sum(F.length("words") + 16 * F.size("items") + 64), F.lit(0)).alias("bytes"),
        F.collect_set("n_words").alias("lengths"),
    ).first()
    bits = bit_map(windows)
    texts = docs.select(
        F.col("doc_id"),
        F.xxhash64(F.col("text").cast("string")).alias("text_hash"),
        words_of(F.col("text").cast("string")).alias("w"),
    )
    empty = F.array().cast("array<struct<start:int,n_words:int,words:string>>")
    rows = materialize(
        texts.select(
            "doc_id", "text_hash", F.size("w").alias("n_words"),
            F.concat(empty, *[_candidates(F.col("w"), n, bits) for n in sorted(facts["lengths"])]).alias("candidates"),
        ),
        "candidates",
    )
    small = windows.select(F.col("words"), "items")
    if facts["bytes"] <= BROADCAST_BYTES:
        small = F.broadcast(small)
    hits = (
        rows.select("doc_id", "text_hash", F.explode("candidates").alias("c"))
        .select("doc_id", "text_hash", "c.*").join(small, "words")
        .groupBy("doc_id", "text_hash")
        .agg(
            F.array_sort(F.array_distinct(F.flatten(F.collect_set(
                F.sequence(F.col("start"), F.col("start") + F.col("n_words") - 1)
            )))).alias("hits"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.col("items").cast("array<string>"))))).alias("items"),
        )
    )
    none = F.array().cast("array<string>")
    l, r = rows.alias("l"), hits.alias("r")
    return l.join(
        r, F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & F.col("l.text_hash").eqNullSafe(F.col("r.text_hash")), "left"
    ).select(
        "l.doc_id", "l.text_hash", "l.n_words",
        F.coalesce("r.hits", none.cast("array<int>")).alias("hits"), F.coalesce("r.items", none).alias("items"),
    )


def decontaminate(docs: DataFrame, bench: DataFrame, remove: str = "documents", window: int = WINDOW) -> DataFrame:
    """``docs`` without what it shares with the test items; all columns stay.

    ``remove="documents"`` drops each text with a hit, ``remove="spans"`` cuts the hit words
    (with the white space and punctuation that follow them) out of the text.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove: {remove}")
    leaks = find_leaks(docs, bench, window).where(F.size("hits") > 0).dropDuplicates(["doc_id", "text_hash"])
    docs, leaks = docs.alias("d"), leaks.alias("leak")
    same = F.col("d.doc_id").eqNullSafe(F.col("leak.doc_id")) & (
        F.xxhash64(F.col("d.text").cast("string")) == F.col("leak.text_hash")
    )
    if remove == "documents":
        return docs.join(leaks, same, "left_anti")
    text, hits = F.col("d.text"), F.col("leak.hits")
    tokens = F.regexp_extract_all(text, F.lit(RAW_WORD), 0)
    rest = F.array_except(F.sequence(F.lit(0), F.size(tokens) - 1), hits)
    clean = F.concat(
        F.regexp_extract(text, RAW_HEAD, 0), F.array_join(F.transform(rest, lambda i: F.get(tokens, i)), "")
    )
    return docs.join(leaks, same, "left").select(
        *[
            F.when(hits.isNull(), text).otherwise(clean).alias("text") if c == "text" else F.col(f"d.`{c}`")
            for c in docs.columns
        ]
    )


def leak_report(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """Digest of :func:`find_leaks`, one row per text."""
    return find_leaks(docs, bench).select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS t
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM win),
place AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS t
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)),
hit AS (SELECT doc_id, item_id, i, place.n AS n FROM place JOIN win USING (t)),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN items USING (doc_id) LEFT JOIN covered USING (doc_id)
"""
