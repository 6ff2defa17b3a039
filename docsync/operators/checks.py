"""Gates and checks: small aggregates that stop a job before it can do harm."""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsync.functions import hash_text, minus_seconds
from docsync.operators.diff import content_diff
from docsync.operators.extract import ID

# Default limits of a run.
MAX_DELETE_RATIO = 0.10
SAMPLE_ROWS = 1000
SAMPLE_SEED = 42
MARGIN_SECONDS = 300


class GateFailed(RuntimeError):
    """A check refused to let the run go on."""


# ---- cutover and window ------------------------------------------------------------------


def usable_bound(since: Column, margin: int, now: Column | None = None) -> Column:
    """Cutover text to the window's lower bound; null when not ISO-8601 or in the future."""
    moment = F.try_to_timestamp(since)
    current = F.current_timestamp() if now is None else now
    return F.when(moment <= current, minus_seconds(moment, margin))


def lower_bound(
    since: str | dt.datetime | None,
    margin: int = MARGIN_SECONDS,
    now: dt.datetime | None = None,
) -> dt.datetime:
    """The same for one run's setting, on the driver; raises when the cutover is unusable."""
    now = now or dt.datetime.now(dt.timezone.utc)
    try:
        moment = since if isinstance(since, dt.datetime) else dt.datetime.fromisoformat(since)
    except (TypeError, ValueError):
        raise GateFailed(f"cutover is not ISO-8601: {since!r}") from None
    if moment.tzinfo is None:
        moment = moment.replace(tzinfo=dt.timezone.utc)
    if now.tzinfo is None:
        now = now.replace(tzinfo=dt.timezone.utc)
    if moment > now:
        raise GateFailed(f"cutover lies in the future: {since}")
    return moment - dt.timedelta(seconds=margin)


def counts(df: DataFrame, ts_col: str | None = None) -> DataFrame:
    """One row ``n, high_water`` (null when empty or without a timestamp column)."""
    high = F.max(ts_col) if ts_col else F.lit(None).cast("timestamp")
    return df.agg(F.count(F.lit(1)).alias("n"), high.alias("high_water"))


def stable(
    read_fn: Callable[[], DataFrame],
    ts_col: str | None,
    wait: float = 0,
    version_fn: Callable[[], int] | None = None,
) -> bool:
    """True when two samples ``wait`` seconds apart agree.

    Compared are count and newest timestamp, and the version of a source that has versions.
    """

    def sample():
        return version_fn() if version_fn else None, counts(read_fn(), ts_col).first()

    first = sample()
    time.sleep(wait)
    return first == sample()


def plan(
    src: DataFrame,
    tgt: DataFrame,
    ts_col: str | None,
    since=None,
    row_bytes: Column | None = None,
    mean_bytes: float | None = None,
) -> DataFrame:
    """Dry run as one row. The journal estimate is the delta times the target's row size.

    ``mean_bytes`` is that size when it is known, and no document is read then; otherwise it is
    measured on all rows, by ``row_bytes`` or as JSON.
    """
    size = row_bytes if row_bytes is not None else F.octet_length(F.to_json(F.struct("*")))
    if mean_bytes is not None:
        size = F.lit(None)
    in_window = F.lit(True) if ts_col is None else F.col(ts_col) > F.lit(since)
    none = F.lit(None).cast("bigint")
    left = src.select(
        F.lit(1).alias("s"), in_window.cast("int").alias("d"), F.lit(0).alias("t"), none.alias("b")
    )
    right = tgt.select(
        F.lit(0).alias("s"), F.lit(0).alias("d"), F.lit(1).alias("t"), size.cast("bigint").alias("b")
    )
    totals = left.unionByName(right).agg(
        F.coalesce(F.sum("s"), F.lit(0)).alias("source_total"),
        F.coalesce(F.sum("t"), F.lit(0)).alias("target_total"),
        F.coalesce(F.sum("d"), F.lit(0)).alias("delta"),
        F.sum("b").alias("_bytes"),
    )
    mean = F.try_divide(F.col("_bytes"), F.col("target_total")) if mean_bytes is None else F.lit(mean_bytes)
    return totals.select(
        "source_total",
        "target_total",
        "delta",
        (F.col("source_total") - F.col("target_total")).alias("net"),
        F.coalesce(F.ceil(mean * F.col("delta")), F.lit(0)).alias("journal_bytes"),
    )


# ---- gates -------------------------------------------------------------------------------


def gate_passes(seen: Column, total: Column, dead: Column, allow_partial: Column) -> Column:
    return (seen >= total) & ((dead == 0) | allow_partial)


def gate(seen: int, total: int, dead: int, allow_partial: bool = False) -> None:
    """Lets deletes proceed only after a complete delta without rejected rows."""
    if seen < total:
        raise GateFailed(f"delta window had {total} rows but only {seen} were read")
    if dead > 0 and not allow_partial:
        raise GateFailed(f"{dead} rows were rejected by the target")


def delete_ratio(
    deletes: int, target_rows: int, limit: float = MAX_DELETE_RATIO, assume_yes: bool = False
) -> None:
    """Stops when strictly more than ``limit`` of the target would be deleted."""
    if target_rows > 0 and deletes / target_rows > limit and not assume_yes:
        raise GateFailed(f"{deletes} deletes are more than {limit} of {target_rows} rows")


def ratio_exceeded(deletes: Column, target_rows: Column, limit: float = MAX_DELETE_RATIO) -> Column:
    return (target_rows > 0) & (F.try_divide(deletes, target_rows) > F.lit(limit))


def completeness(
    df: DataFrame, counted: int | None = None, keys: Sequence[str] = ID
) -> DataFrame:
    """One row ``counted, exported, complete``: as many distinct ids as counted rows.

    Grouping by id first means a repeated id collapses in every task before the shuffle.
    """
    per_id = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    valid = F.lit(True)
    for key in keys:
        valid = valid & F.col(key).isNotNull()
    total = F.lit(counted) if counted is not None else F.coalesce(F.sum("n"), F.lit(0))
    return per_id.agg(
        total.cast("bigint").alias("counted"), F.count_if(valid).alias("exported")
    ).withColumn("complete", F.col("counted") == F.col("exported"))


def bad_keys(df: DataFrame, key: str = "id") -> DataFrame:
    """``id, reason`` of null, empty and duplicated ids; must be empty before any diff."""
    per_id = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    reason = (
        F.when(F.col(key).isNull(), "null")
        .when(F.length(F.col(key).cast("string")) == 0, "empty")
        .when(F.col("n") > 1, "duplicate")
    )
    return per_id.select(key, reason.alias("reason")).where("reason is not null")


# ---- samples and verification ------------------------------------------------------------


def sample(df: DataFrame, n: int = SAMPLE_ROWS, seed: int = SAMPLE_SEED, key: str = "id") -> DataFrame:
    """At most ``n`` ids, the same ones on each run and for any partitioning.

    A top-k by hash: each task keeps ``n`` ids, nothing is sorted as a whole.
    """
    return df.select(key).orderBy(hash_text(F.col(key), seed), key).limit(n)


def preview(df: DataFrame, k: int = 5, key: str = "id") -> DataFrame:
    """The first ``k`` ids, to show with a refusal."""
    return df.select(key).orderBy(key).limit(k)


def check_row(name: str, expected: Column, actual: Column) -> Column:
    return F.struct(
        F.lit(name).alias("check"),
        expected.cast("bigint").alias("expected"),
        actual.cast("bigint").alias("actual"),
        (expected == actual).alias("ok"),
    )


def _rows(df: DataFrame, *rows: Column) -> DataFrame:
    return df.select(F.inline(F.array(*rows)))


def verify(
    src: DataFrame,
    tgt: DataFrame,
    before: DataFrame | None = None,
    to_delete: DataFrame | None = None,
    to_repair: DataFrame | None = None,
    removed: str = "",
    sample_ids: DataFrame | None = None,
    full: bool = False,
    keys: Sequence[str] = ID,
) -> DataFrame:
    """Report rows ``check, expected, actual, ok``.

    * ``count``: rows of both sides.
    * ``extra_ids`` and ``missing_ids``: the written target, read again, against the source.
    * ``expected_ids``: the planned set ``(before - to_delete) + to_repair`` against the source.
    * ``content_sample``: differing documents among ``sample_ids``.
    * ``content_full``: differing documents among all; finds updates that left the timestamp.
    """
    # All id sets meet in one grouped aggregate: one shuffle, ids only.
    sets = {"src": src, "tgt": tgt}
    if before is not None:
        sets |= {"before": before, "gone": to_delete, "added": to_repair}
    marked = None
    for name, df in sets.items():
        flags = [F.lit(int(other == name)).cast("bigint").alias(other) for other in sets]
        part = df.select(*keys, *flags)
        marked = part if marked is None else marked.unionByName(part)
    per_id = marked.groupBy(*keys).agg(*[F.sum(name).alias(name) for name in sets])
    facts = [
        F.coalesce(F.sum("src"), F.lit(0)).alias("ns"),
        F.coalesce(F.sum("tgt"), F.lit(0)).alias("nt"),
        F.count_if((F.col("src") == 0) & (F.col("tgt") > 0)).alias("extra"),
        F.count_if((F.col("tgt") == 0) & (F.col("src") > 0)).alias("missing"),
    ]
    zero = F.lit(0)
    rows = [
        check_row("count", F.col("ns"), F.col("nt")),
        check_row("extra_ids", zero, F.col("extra")),
        check_row("missing_ids", zero, F.col("missing")),
    ]
    if before is not None:
        planned = ((F.col("before") > 0) & (F.col("gone") == 0)) | (F.col("added") > 0)
        facts.append(F.count_if(planned != (F.col("src") > 0)).alias("off"))
        rows.append(check_row("expected_ids", zero, F.col("off")))
    report = _rows(per_id.agg(*facts), *rows)
    if sample_ids is not None:
        part = content_diff(
            src.join(sample_ids, list(keys), "left_semi"),
            tgt.join(sample_ids, list(keys), "left_semi"),
            removed,
            keys,
        )
        report = report.unionByName(difference_row("content_sample", part))
    if full:
        report = report.unionByName(
            difference_row("content_full", content_diff(src, tgt, removed, keys))
        )
    return report


def difference_row(name: str, ids: DataFrame) -> DataFrame:
    found = ids.agg(F.count(F.lit(1)).alias("n"))
    return _rows(found, check_row(name, F.lit(0), F.col("n")))


__all__ = [
    "GateFailed", "MARGIN_SECONDS", "MAX_DELETE_RATIO", "SAMPLE_ROWS", "SAMPLE_SEED", "bad_keys",
    "completeness", "counts", "delete_ratio", "difference_row", "gate", "gate_passes", "lower_bound",
    "plan", "preview", "ratio_exceeded", "sample", "stable",
    "usable_bound", "verify",
]
