"""Runs: delta sync, gate, reconcile, verify, undo, resume, and many tables.

A run pins the target version it started from and goes through the phases

    DELTA_SYNC -> DELTA_DONE -> GATE_PASSED -> RECONCILE_DONE -> DONE

Each phase stages its change set and records that, then writes the journal, then makes the change
set visible and last records the new phase. A phase that is repeated after a crash takes up the
staged change set, so that journal and change set always hold the same rows, whatever the source
did meanwhile; a change set that became visible already is recognised by the run and batch in its
commit and not applied again. Counters follow the commit.
"""

from __future__ import annotations

import datetime as dt
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsync.functions import fingerprint, from_document, to_document
from docsync.functions.types import struct_of
from docsync.operators import checks
from docsync.operators.checks import GateFailed
from docsync.operators.diff import presence
from docsync.operators.extract import delta, touched
from docsync.operators.journal import number, preimage, undo_changes
from docsync.operators.outcome import DEAD_LETTER, rejected
from docsync.operators.schema import align, extend, misfit, remove_fields
from docsync.session import fresh_dir, materialize, tune
from docsync.sources import digest, files, store
from docsync.sources.journal_store import JOURNAL, append_journal, batch_path, read_journal

# Phases of a run, in order.
PHASES = ("DELTA_SYNC", "DELTA_DONE", "GATE_PASSED", "RECONCILE_DONE", "DONE")
# Outcomes, from good to bad.
OUTCOMES = ("ok", "dead_letters", "interrupted", "failed")

# Counter names.
STATE = struct_of(
    table="string",
    run_id="string",
    step="int",
    phase="string",
    src="string",
    dst="string",
    ts_field="string",
    remove_fields="string",
    since="string",
    watermark="string",
    total="bigint",
    seen="bigint",
    synced="bigint",
    dl_count="bigint",
    deleted_planned="bigint",
    deleted_applied="bigint",
    repaired_planned="bigint",
    repaired_applied="bigint",
    journal_seq="bigint",
    base_version="int",
    version="int",
    attempt="int",
    differences="string",
    outcome="string",
    message="string",
    seconds="double",
    src_version="int",
    staged="string",
    layer="string",
    offending="string",
    from_version="int",
    inclusive="boolean",
)


@dataclass(frozen=True)
class SyncConfig:
    """One table to bring in step.

    ``source`` is a function returning the source rows, or the root of a versioned table.
    ``target`` is the root of a versioned table with a string or integer ``id``. ``ts_field``
    None copies everything; it must be a timestamp column. ``since`` is the cutover, by default the
    marker's, or ``last``: behind the last good run (see :func:`continue_from`). ``home`` is the folder of
    run states, journals and dead letters. ``unknown`` says what happens to source columns that the target
    lacks: ``extend`` adds them to the target, ``drop`` leaves them out; ``strict`` rejects rows
    that have a value there. ``digests`` makes ``full_compare`` compare the digests of two versioned
    tables (:mod:`docsync.sources.digest`), which it keeps for both, where both have the same columns and types.
    """

    table: str
    source: Callable[[SparkSession], DataFrame] | str
    target: str
    home: str
    ts_field: str | None = "updated_at"
    since: str | None = None
    margin: int = checks.MARGIN_SECONDS
    remove: str = ""
    routing: str | None = None
    strict: bool = False
    allow_partial: bool = False
    max_delete_ratio: float = checks.MAX_DELETE_RATIO
    assume_yes: bool = False
    sample_rows: int = checks.SAMPLE_ROWS
    full_compare: bool = False
    freeze_wait: float = 10.0
    unknown: str = "extend"
    digests: bool = False

    @property
    def source_name(self) -> str:
        return self.source if isinstance(self.source, str) else self.source.__name__

    def read_source(self, spark: SparkSession, version: int | None = None) -> DataFrame:
        """The source rows; of a versioned table those of ``version``, by default the newest."""
        if isinstance(self.source, str):
            return store.read_table(spark, self.source, version or None)
        return self.source(spark)

    def source_version(self, spark: SparkSession) -> int:
        return store.current_version(spark, self.source) if isinstance(self.source, str) else 0

    @property
    def journal(self) -> str:
        return f"{self.home}/{self.table}/journal"

    @property
    def states(self) -> str:
        return f"{self.home}/{self.table}/runs"

    @property
    def failures(self) -> str:
        return f"{self.home}/{self.table}/failures"

    @property
    def dead(self) -> str:
        return f"{self.home}/{self.table}/dead"


@dataclass
class RunState:
    """Counters of one run; every step is kept as its own small file."""

    table: str
    run_id: str
    step: int = 0
    phase: str = "DELTA_SYNC"
    src: str = ""
    dst: str = ""
    ts_field: str | None = None
    remove_fields: str = ""
    since: str | None = None
    watermark: str | None = None
    total: int = 0
    seen: int = 0
    synced: int = 0
    dl_count: int = 0
    deleted_planned: int = 0
    deleted_applied: int = 0
    repaired_planned: int = 0
    repaired_applied: int = 0
    journal_seq: int = 0
    base_version: int = 0
    version: int = 0
    attempt: int = 0
    differences: str | None = None
    outcome: str | None = None
    message: str | None = None
    seconds: float = 0.0
    src_version: int = 0
    staged: str | None = None
    layer: str | None = None
    offending: str | None = None
    from_version: int = 0
    inclusive: bool = False
    started: float = field(default_factory=time.time, repr=False, compare=False)


class RunConflict(RuntimeError):
    """A run is open, belongs to other settings, or another process drives it."""


# ---- run state ---------------------------------------------------------------------------


def _save(spark: SparkSession, cfg: SyncConfig, state: RunState, folder: str | None = None) -> None:
    """Appends the next step; of two processes driving one run, only one can."""
    state.step += 1
    state.seconds += time.time() - state.started
    state.started = time.time()
    record = {k: v for k, v in asdict(state).items() if k != "started"}
    path = f"{folder or cfg.states}/{state.run_id}-{state.step:06d}.json"
    if not files.create_json(spark, path, record):
        raise RunConflict(f"run {state.run_id} of {cfg.table} is driven by another process")


def load_state(spark: SparkSession, cfg: SyncConfig) -> RunState | None:
    """Last recorded step of the newest run."""
    for name in reversed(files.names(spark, cfg.states)):
        record = files.read_json(spark, f"{cfg.states}/{name}")
        if record is not None:
            return RunState(**record)
    return None


def state_table(spark: SparkSession, home: str) -> DataFrame:
    """One row per table and run: its last step."""
    kinds = [f"{home}/{t}/{kind}" for t in files.names(spark, home) for kind in ("runs", "failures")]
    kinds = [path for path in kinds if files.exists(spark, path)]
    if not kinds:
        return spark.createDataFrame([], STATE)
    steps = spark.read.schema(STATE).json(kinds)
    row = F.struct(*[F.col(c) for c in STATE.names])
    last = steps.groupBy("table", "run_id").agg(F.max_by(row, "step").alias("s"))
    return last.select("s.*")


def rates(states: DataFrame) -> DataFrame:
    """``rows_per_sec`` and ``ms_per_row`` of each run."""
    return states.select(
        "table",
        "run_id",
        "synced",
        "seconds",
        F.try_divide(F.col("synced"), F.col("seconds")).alias("rows_per_sec"),
        F.try_divide(F.col("seconds") * 1000, F.col("synced")).alias("ms_per_row"),
    )


def summary(states: DataFrame) -> DataFrame:
    """Newest run per table with its counters and result."""
    row = F.struct(*[F.col(c) for c in states.columns if c != "table"])
    newest = states.groupBy("table").agg(F.max_by(row, F.struct("run_id", "step")).alias("s"))
    return newest.select(
        "table", "s.phase", "s.seen", "s.synced", F.col("s.deleted_applied").alias("deleted"),
        F.col("s.repaired_applied").alias("repaired"), F.col("s.dl_count").alias("dead_letters"),
        "s.outcome",
    )


def severity(outcome: Column) -> Column:
    """0 for ok up to 3; anything unknown is as bad as a failure."""
    code = F.when(outcome == OUTCOMES[0], 0)
    for rank, name in enumerate(OUTCOMES[1:-1], start=1):
        code = code.when(outcome == name, rank)
    return code.otherwise(len(OUTCOMES) - 1)


def worst(states: DataFrame) -> DataFrame:
    """One row ``outcome``: the most severe result."""
    return states.agg(F.max_by("outcome", severity(F.col("outcome"))).alias("outcome"))


# ---- copy --------------------------------------------------------------------------------


def copy_table(
    src: DataFrame,
    root: str,
    schema: T.StructType | None = None,
    buckets: int | None = None,
    cutover: dt.datetime | None = None,
) -> DataFrame:
    """Full copy as a new version; totals ``source_rows, created, updated, failed, target_rows, ok``.

    Rows that do not fit are written to ``_dead`` below the table as dead letters. Only a copy
    without them becomes visible, and with it the cutover marker; else the old version stays and
    the target counts are its own. The marker's time is taken before the source is read, so
    nothing written meanwhile is missed later.
    """
    spark = tune(src.sparkSession)
    cutover = cutover or dt.datetime.now(dt.timezone.utc)
    schema = schema or src.schema
    before = store.current_version(spark, root)
    offending = checks.bad_keys(src).count()
    if offending:
        raise GateFailed(f"{offending} ids of the source are null, empty or repeated")
    marked = src.withColumn("_reject", misfit(src, schema))
    # Counted on its own: metrics observed ahead of a shuffle count a repeated task twice.
    totals = marked.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("_reject").isNotNull()).alias("bad")
    ).first()
    target_rows = updated = created = 0
    if totals["bad"]:
        document = to_document([F.col(f"`{c}`") for c in src.columns])
        records = marked.where("_reject is not null").select(
            "id", F.col("_reject").alias("reject"), document.alias("source")
        )
        rejected(records, "copy").write.json(f"{root}/_dead/{uuid.uuid4().hex}")
        target_rows = store.read_table(spark, root, before).count() if before else 0
    else:
        version = store.write_version(align(src, schema), root, buckets, expect=before)
        written = store.read_table(spark, root, version)
        target_rows = written.count()
        if before:
            old = store.read_table(spark, root, before)
            updated = presence(old, written).where("n_src > 0 and n_tgt > 0").count()
        created = target_rows - updated
    ok = totals["bad"] == 0 and target_rows == totals["rows"]
    if ok:
        moment = cutover.astimezone(dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        store.set_marker(spark, root, "cutover_at", moment)
    row = (totals["rows"], created, updated, totals["bad"], target_rows, ok)
    return spark.createDataFrame(
        [row],
        "source_rows bigint, created bigint, updated bigint, failed bigint, "
        "target_rows bigint, ok boolean",
    )


# ---- phases ------------------------------------------------------------------------------


LAST = "last"


def _runs(spark: SparkSession, cfg: SyncConfig) -> list[str]:
    """Ids of the recorded runs, newest first."""
    return sorted({n.rsplit("-", 1)[0] for n in files.names(spark, cfg.states)}, reverse=True)


def _state_of(spark: SparkSession, cfg: SyncConfig, run_id: str) -> RunState | None:
    """Last recorded step of a run."""
    steps = [n for n in files.names(spark, cfg.states) if n.rsplit("-", 1)[0] == run_id]
    records = (files.read_json(spark, f"{cfg.states}/{n}") for n in reversed(steps))
    return next((RunState(**r) for r in records if r is not None), None)


def _undone(spark: SparkSession, cfg: SyncConfig) -> dict[str, int]:
    """Runs whose effect on the target was taken back, with the version that did it."""
    tags = {v: store.read_commit(spark, cfg.target, v)["tag"] for v in store.versions(spark, cfg.target)}
    return {t["run_id"]: v for v, t in tags.items() if t.get("batch", "").startswith("undo-")}


def continue_from(spark: SparkSession, cfg: SyncConfig) -> RunState | None:
    """The run that a run with ``since="last"`` continues: the newest good one that still holds.

    A run no longer holds when it, or one before it, was undone since.

    A versioned source is continued behind the version that run read, by the change sets committed
    since (:func:`store.changes_between`): no timestamp is looked at. Any other source is read
    from that run's watermark on, inclusively, since rows of the same time may have come later;
    rows that the target holds already with the same content are then left out.
    """
    undone = _undone(spark, cfg)
    for run_id in _runs(spark, cfg):
        state = _state_of(spark, cfg, run_id)
        if state is None or state.outcome != OUTCOMES[0] or state.src != cfg.source_name:
            continue
        if not any(u <= run_id and state.base_version < version for u, version in undone.items()):
            return state
    return None


def _refuse_keys(schema: T.StructType) -> None:
    """Journals are JSON, whose objects have string keys: other maps could not be undone."""

    def check(kind: T.DataType, path: str) -> None:
        if isinstance(kind, T.StructType):
            for field in kind.fields:
                check(field.dataType, f"{path}.{field.name}" if path else field.name)
        elif isinstance(kind, T.ArrayType):
            check(kind.elementType, path)
        elif isinstance(kind, T.MapType):
            if not isinstance(kind.keyType, T.StringType):
                raise GateFailed(f"{path} is a map with {kind.keyType.simpleString()} keys, which a journal cannot hold")
            check(kind.valueType, path)

    check(schema, "")


def preflight(spark: SparkSession, cfg: SyncConfig, continued: bool = False) -> dt.datetime | None:
    """Lower bound of the delta window; fails on a bad cutover, a moving source or types that
    could not be undone. A run that continues another has no cutover."""
    bound = None
    for schema in (cfg.read_source(spark).schema, store.schema_of(store.read_commit(spark, cfg.target))):
        _refuse_keys(schema)
    if cfg.ts_field is not None and not continued:
        since = cfg.since
        if since in (None, LAST):
            root = cfg.source if isinstance(cfg.source, str) else cfg.target
            since = store.get_marker(spark, root, "cutover_at")
        bound = checks.lower_bound(since, cfg.margin)
    if cfg.ts_field is not None:
        kind = cfg.read_source(spark).schema[cfg.ts_field].dataType
        if not isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            raise GateFailed(f"{cfg.ts_field} is {kind.simpleString()}, not a timestamp")
    versioned = (lambda: cfg.source_version(spark)) if isinstance(cfg.source, str) else None
    if not checks.stable(lambda: cfg.read_source(spark), cfg.ts_field, cfg.freeze_wait, versioned):
        raise GateFailed("the source is still taking writes: stop them first")
    return bound


def plan(spark: SparkSession, cfg: SyncConfig) -> DataFrame:
    """What a run would do, as one row of :func:`checks.plan`; no document of the target is read."""
    tune(spark)
    src, tgt = cfg.read_source(spark), store.read_table(spark, cfg.target)
    since = None
    if cfg.ts_field is not None:
        bound = preflight(spark, cfg)
        since = dt.datetime.fromisoformat(bound.isoformat())
    return checks.plan(src, tgt, cfg.ts_field, since, mean_bytes=store.mean_row_bytes(spark, cfg.target))


def _bound_column(src: DataFrame, cfg: SyncConfig, since: str | None):
    if since is None or cfg.ts_field is None:
        return None
    moment = F.lit(dt.datetime.fromisoformat(since))
    return moment.cast(src.schema[cfg.ts_field].dataType)


def _target_schema(spark: SparkSession, cfg: SyncConfig, src: DataFrame, version: int) -> T.StructType:
    """The target's schema for this run: with the source's further columns, if they are kept."""
    schema = store.schema_of(store.read_commit(spark, cfg.target, version))
    if cfg.unknown == "extend" and not cfg.strict:
        return extend(schema, remove_fields(src, cfg.remove).schema)
    return schema


def _stage_delta(spark: SparkSession, cfg: SyncConfig, state: RunState, schema: T.StructType, op: str) -> None:
    """The window's rows to the shared folder, in one pass over the source, and their counters."""
    if state.from_version:
        feed = store.changes_between(spark, cfg.source, state.from_version, state.src_version)
        window = feed.where("change = 'upsert'").drop("change")
    else:
        src = cfg.read_source(spark, state.src_version)
        op = "gte" if state.inclusive else op
        window = delta(src, cfg.ts_field, _bound_column(src, cfg, state.since), op)
    state.total = window.count()
    staged = remove_fields(window, cfg.remove)
    seen = Observation()
    high = F.max(cfg.ts_field).cast("string") if cfg.ts_field in staged.columns else F.lit(None).cast("string")
    marked = staged.withColumn("_reject", misfit(staged, schema, cfg.strict)).observe(
        seen,
        F.count(F.lit(1)).alias("seen"),
        F.count_if(F.col("_reject").isNotNull()).alias("dead"),
        high.alias("high"),
    )
    path = fresh_dir(spark, f"{cfg.table}-delta")
    marked.write.parquet(path)
    facts = seen.get
    state.seen, state.dl_count = facts["seen"], facts["dead"]
    state.watermark = facts["high"] or state.watermark
    state.staged = path


def delta_sync(spark: SparkSession, cfg: SyncConfig, state: RunState, op: str = "gt") -> None:
    """Extract, set misfits aside, journal, apply.

    What is staged stays staged: a repeated phase does not look at the source again.
    """
    schema = _target_schema(spark, cfg, cfg.read_source(spark, state.src_version), state.base_version)
    if not state.staged:
        _stage_delta(spark, cfg, state, schema, op)
        _save(spark, cfg, state)
    changes = spark.read.parquet(state.staged)
    if state.dl_count or state.attempt:
        columns = [c for c in changes.columns if c != "_reject"]
        document = to_document([F.col(f"`{c}`") for c in columns])
        bad = changes.where("_reject is not null").select(
            "id", F.col("_reject").alias("reject"), document.alias("source")
        )
        # Of several attempts the last one counts, also when nothing is left to reject.
        _write_dead(rejected(bad, "delta"), cfg, state, f"delta-{state.attempt:04d}")
    good = align(changes.where("_reject is null").drop("_reject"), schema)
    if state.inclusive or state.from_version:
        good = _not_yet_applied(spark, cfg, state, good)
    good = good.withColumn("op", F.lit("index"))
    state.synced = _apply(spark, cfg, state, good, schema, f"delta-{state.attempt}")["n"]
    state.phase, state.staged = "DELTA_DONE", None


def _not_yet_applied(spark: SparkSession, cfg: SyncConfig, state: RunState, rows: DataFrame) -> DataFrame:
    """Rows that the target does not hold with the same content.

    Only ids and fingerprints of the rows that may have been applied meet: those at the
    watermark itself, or all rows of a change feed.
    """
    payload = [c for c in rows.columns if c != "id"]
    again = F.lit(True)
    if state.inclusive and cfg.ts_field in rows.columns:
        again = F.coalesce(F.col(cfg.ts_field) == _bound_column(rows, cfg, state.since), F.lit(False))
    asked = rows.where(again)
    held = touched(store.read_table(spark, cfg.target, state.base_version), asked)
    if [c for c in payload if c not in held.columns]:
        return rows  # new columns: every row is applied again
    same = asked.select("id", fingerprint(asked, payload).alias("_print")).join(
        held.select("id", fingerprint(held, payload).alias("_print")), ["id", "_print"], "left_semi"
    )
    return rows.join(same.select("id"), "id", "left_anti").select(*rows.columns)


def _write_dead(records: DataFrame, cfg: SyncConfig, state: RunState, batch: str) -> None:
    path = f"{cfg.dead}/run_id={state.run_id}/batch_id={batch}"
    records.write.mode("overwrite").json(path)


def read_dead(spark: SparkSession, cfg: SyncConfig, run_id: str) -> DataFrame:
    """Dead letters of one run: those of the delta's last attempt and of the repairs."""
    root = f"{cfg.dead}/run_id={run_id}"
    named = files.names(spark, root)
    attempts = sorted(n for n in named if n.startswith("batch_id=delta"))
    chosen = [n for n in named if not n.startswith("batch_id=delta")] + attempts[-1:]
    if not chosen:
        return spark.createDataFrame([], DEAD_LETTER)
    return spark.read.schema(DEAD_LETTER).json([f"{root}/{n}" for n in chosen])


def _apply(
    spark: SparkSession,
    cfg: SyncConfig,
    state: RunState,
    changes: DataFrame | None,
    schema: T.StructType,
    batch: str,
) -> dict:
    """Stage, record, journal, make visible. Returns the rows of the change set, by kind.

    The staged change set and the target share their buckets, so the pre-image join reads
    both in place. ``changes`` may be None when the state names a staged change set.
    """
    tag = {"run_id": state.run_id, "batch": batch}
    made = store.find_commit(spark, cfg.target, tag, state.base_version)
    if made is not None:
        # Made visible before the crash; the journal was complete by then.
        done = _journaled(spark.read.schema(JOURNAL).parquet(batch_path(cfg.journal, state.run_id, batch)))
        state.version = made["version"]
    else:
        is_delta = batch.startswith("delta")
        expect = state.base_version if is_delta else state.version
        pinned = {**store.read_commit(spark, cfg.target, expect), "schema": schema.jsonValue()}
        if not state.layer:
            name = store.stage_changes(changes, cfg.target, schema)
            # An id that comes twice would be applied twice. Counted where the rows lie by bucket, before
            # the run knows the change set: what is refused here is never taken up again.
            offending = checks.bad_keys(store.read_layer(spark, cfg.target, name, pinned)).count()
            if offending:
                state.staged = None
                raise GateFailed(f"{offending} changed ids are null, empty or repeated")
            state.layer = name
            _save(spark, cfg, state)
        layer = store.read_layer(spark, cfg.target, state.layer, pinned)
        kinds = F.when(F.col(store.OP) == "delete", "delete").otherwise(
            "delta" if is_delta else "repair"
        )
        ids = number(layer.select("id", kinds.alias("kind")), state.journal_seq)
        before = store.read_table(spark, cfg.target, expect)
        rows = preimage(ids, before, F.col("kind"), cfg.routing, store.matching(before, layer))
        append_journal(rows, cfg.journal, state.run_id, batch, uncommitted=True, buckets=pinned["buckets"])
        done = _journaled(spark.read.schema(JOURNAL).parquet(batch_path(cfg.journal, state.run_id, batch)))
        state.version = store.commit_changes(spark, cfg.target, state.layer, expect, tag, schema)
    state.layer = None
    state.journal_seq += done["n"]
    return done


def _journaled(journal: DataFrame) -> dict:
    """Rows of a journal batch: all, deletes, repairs."""
    return journal.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("op") == "delete").alias("deletes"),
        F.count_if(F.col("op") == "repair").alias("repairs"),
    ).first().asDict()


def gate(spark: SparkSession, cfg: SyncConfig, state: RunState) -> None:
    """Stops unless the delta was complete; dead letters are judged by the current schema."""
    if state.dl_count:
        given = remove_fields(cfg.read_source(spark, state.src_version), cfg.remove).schema
        schema = _target_schema(spark, cfg, cfg.read_source(spark, state.src_version), store.current_version(spark, cfg.target))
        dead = read_dead(spark, cfg, state.run_id)
        rows = dead.select(from_document(F.col("source"), given).alias("d")).select("d.*")
        if rows.where(misfit(rows, schema, cfg.strict).isNotNull()).isEmpty():
            # All fit now: go through the delta again under the new schema.
            state.phase, state.attempt, state.staged = "DELTA_SYNC", state.attempt + 1, None
            state.base_version = state.version = store.current_version(spark, cfg.target)
            return
    checks.gate(state.seen, state.total, state.dl_count, cfg.allow_partial)
    state.phase = "GATE_PASSED"


def reconcile(spark: SparkSession, cfg: SyncConfig, state: RunState) -> None:
    """Find target-only and source-only ids in one pass; guard; journal; delete and repair."""
    src = cfg.read_source(spark, state.src_version)
    schema = _target_schema(spark, cfg, src, state.version)
    made = store.find_commit(
        spark, cfg.target, {"run_id": state.run_id, "batch": "reconcile"}, state.base_version
    )
    if state.layer or made:
        _reconciled(state, _apply(spark, cfg, state, None, schema, "reconcile"))
        return
    tgt = store.read_table(spark, cfg.target, state.version)
    src_rows = src.count()

    path = fresh_dir(spark, f"{cfg.table}-ids")
    facts = Observation()
    ids = presence(src.select("id"), tgt.select("id")).observe(
        facts,
        F.count_if(F.col("n_src") > 0).alias("src_ids"),
        F.count_if(F.col("n_tgt") > 0).alias("tgt_ids"),
        F.coalesce(F.sum("n_tgt"), F.lit(0)).alias("tgt_rows"),
        F.count_if(
            F.col("id").isNull()
            | (F.length(F.col("id").cast("string")) == 0)
            | (F.col("n_src") > 1)
            | (F.col("n_tgt") > 1)
        ).alias("bad"),
        F.count_if((F.col("n_src") == 0)).alias("deletes"),
        F.count_if((F.col("n_tgt") == 0)).alias("repairs"),
    )
    ids.where((F.col("n_src") == 0) | (F.col("n_tgt") == 0)).write.parquet(path)
    found = facts.get
    state.differences = path
    if found["bad"]:
        raise GateFailed(f"{found['bad']} ids are null, empty or repeated: refusing to compare")
    tgt_rows = found["tgt_rows"]
    for side, n_ids, n_rows in (
        ("source", found["src_ids"], src_rows),
        ("target", found["tgt_ids"], tgt_rows),
    ):
        if n_ids != n_rows:
            raise GateFailed(f"{side} id scan incomplete: {n_ids} ids for {n_rows} rows")
    differing = spark.read.schema(ids.schema).parquet(path)
    to_delete = differing.where("n_src = 0").select("id")
    to_repair = differing.where("n_tgt = 0").select("id")
    try:
        checks.delete_ratio(found["deletes"], tgt_rows, cfg.max_delete_ratio, cfg.assume_yes)
    except GateFailed as refusal:
        shown = [str(r["id"]) for r in checks.preview(to_delete).collect()]
        raise GateFailed(f"{refusal}; first ids: {', '.join(shown)}; all ids: {path}") from None

    state.deleted_planned, state.repaired_planned = found["deletes"], found["repairs"]
    if found["deletes"] or found["repairs"]:
        deletes = align(to_delete, schema).withColumn("op", F.lit("delete"))
        rows = remove_fields(src.join(to_repair, "id", "left_semi"), cfg.remove)
        reject = misfit(rows, schema, cfg.strict)
        marked = rows.withColumn("_reject", reject)
        if found["repairs"]:
            staged_path = fresh_dir(spark, f"{cfg.table}-repair")
            bad = Observation()
            marked.observe(
                bad, F.count_if(F.col("_reject").isNotNull()).alias("dead")
            ).write.parquet(staged_path)
            marked = spark.read.schema(marked.schema).parquet(staged_path)
        if found["repairs"] and bad.get["dead"]:
            document = to_document([F.col(f"`{c}`") for c in rows.columns])
            refused = marked.where("_reject is not null").select(
                "id", F.col("_reject").alias("reject"), document.alias("source")
            )
            _write_dead(rejected(refused, "repair"), cfg, state, "repair")
        repairs = align(marked.where("_reject is null").drop("_reject"), schema).withColumn("op", F.lit("index"))
        _reconciled(state, _apply(spark, cfg, state, deletes.unionByName(repairs), schema, "reconcile"))
    state.phase = "RECONCILE_DONE"


def _reconciled(state: RunState, done: dict) -> None:
    """Counters as journaled. Planned repairs that are not among them were set aside or are gone."""
    state.deleted_applied, state.repaired_applied = done["deletes"], done["repairs"]
    state.dl_count += state.repaired_planned - done["repairs"]
    state.phase = "RECONCILE_DONE"


def verify(spark: SparkSession, cfg: SyncConfig, state: RunState | None = None) -> DataFrame:
    """Report of the newest target version against the source, as ``checks.verify``.

    The source is compared as it was written: in the target's types, without the contents of
    rows that do not fit, and without those of their ids that the target never got.
    """
    return _checked(spark, cfg, state)[0]


def _checked(spark: SparkSession, cfg: SyncConfig, state: RunState | None) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The report, and the ids of differing contents by check, which are compared once and kept."""
    src, content, tgt = _compared(spark, cfg, state)
    planned, found = {}, {}
    if state is not None and state.differences:
        differing = spark.read.parquet(state.differences)
        batches = store.read_commit(spark, cfg.target)
        if batches["tag"].get("batch") == "reconcile" and batches["tag"].get("run_id") == state.run_id:
            planned = {
                "before": store.read_table(spark, cfg.target, _version_before(spark, cfg, state)),
                "to_delete": differing.where("n_src = 0"),
                "to_repair": differing.where("n_tgt = 0"),
            }
    report = checks.verify(src, tgt, **planned)
    if cfg.full_compare:
        found["content_full"] = materialize(_full_diff(spark, cfg, state, content), "content")
    if cfg.sample_rows > 0:
        found["content_sample"] = materialize(_sample_diff(*content, cfg.sample_rows), "content")
    for name, ids in found.items():
        report = report.unionByName(checks.difference_row(name, ids))
    return report, found


def _compared(spark: SparkSession, cfg: SyncConfig, state: RunState | None) -> tuple:
    """Source rows for ids, (source, target) rows for contents, target rows."""
    src = remove_fields(cfg.read_source(spark, state.src_version if state else None), cfg.remove)
    tgt = store.read_table(spark, cfg.target)
    reject = misfit(src, tgt.schema, cfg.strict)
    fits = align(src.where(reject.isNull()), tgt.schema)
    if state is None or not state.dl_count:
        return align(src, tgt.schema), (fits, tgt), tgt
    refused = src.where(reject.isNotNull()).select("id")
    absent = refused.join(tgt.select("id"), "id", "left_anti")
    same = tgt.join(refused, "id", "left_anti")
    return align(src, tgt.schema).join(absent, "id", "left_anti"), (fits, same), tgt


def offending_ids(spark: SparkSession, cfg: SyncConfig, state: RunState) -> DataFrame:
    """``check, id`` of what a verification found: extra, missing and differing ids."""
    return _offending(spark, cfg, state, _checked(spark, cfg, state)[1])


def _offending(
    spark: SparkSession, cfg: SyncConfig, state: RunState, found: dict[str, DataFrame], failed: Sequence[str] | None = None
) -> DataFrame:
    """The same from contents that were compared. Checks that are not among ``failed`` found nothing and are left out."""
    ids = F.col("id").cast("string").alias("id")
    parts = [found[name].select(F.lit(name).alias("check"), ids) for name in found]
    if failed is None or {"extra_ids", "missing_ids"} & set(failed):
        src, _, tgt = _compared(spark, cfg, state)
        sides = presence(src.select("id"), tgt.select("id"))
        parts += [
            sides.where("n_src = 0").select(F.lit("extra_ids").alias("check"), ids),
            sides.where("n_tgt = 0").select(F.lit("missing_ids").alias("check"), ids),
        ]
    out = spark.createDataFrame([], struct_of(check="string", id="string"))
    for part in parts:
        out = out.unionByName(part)
    return out


def _version_before(spark: SparkSession, cfg: SyncConfig, state: RunState) -> int:
    """The version the reconcile step of this run started from."""
    mine = {"run_id": state.run_id, "batch": "reconcile"}
    for version in reversed(store.versions(spark, cfg.target)):
        if store.read_commit(spark, cfg.target, version)["tag"] != mine:
            return version
    return state.base_version


def _full_diff(spark: SparkSession, cfg: SyncConfig, state: RunState | None, content: tuple) -> DataFrame:
    """Ids of the source whose target row is absent or different, by digests where they can tell.

    They cannot where fields are removed, rows were set aside, or the tables' columns or types differ.
    """
    versions = (cfg.source_version(spark), store.current_version(spark, cfg.target))
    if cfg.digests and versions[0] and not cfg.remove and not (state and state.dl_count):
        pinned = state.src_version if state else versions[0]
        src, tgt = (store.schema_of(store.read_commit(spark, r, v)) for r, v in ((cfg.source, pinned), (cfg.target, versions[1])))
        if set(src.names) <= set(tgt.names) and not digest.mismatched(src, tgt):
            found = digest.compare(spark, cfg.source, cfg.target, pinned, versions[1])
            return found.where("status <> 'only_target'").select("id")
    return checks.content_diff(*content)


def _sample_diff(src: DataFrame, tgt: DataFrame, n: int) -> DataFrame:
    """Differing ids among ``n`` sampled ones; the sample meets both sides as a small join."""
    chosen = materialize(checks.sample(src, n).select("id"), "sample")
    ours, theirs = (rows.join(chosen, "id", "left_semi") for rows in (src, tgt))
    return checks.content_diff(ours, theirs)


# ---- run, resume, undo -------------------------------------------------------------------


def _advance(spark: SparkSession, cfg: SyncConfig, state: RunState) -> RunState:
    try:
        while state.phase != "RECONCILE_DONE":
            if state.phase == "DELTA_SYNC":
                delta_sync(spark, cfg, state)
            elif state.phase == "DELTA_DONE":
                gate(spark, cfg, state)
            elif state.phase == "GATE_PASSED":
                reconcile(spark, cfg, state)
            else:
                raise RunConflict(f"unknown phase {state.phase}")
            _save(spark, cfg, state)
        report, found = _checked(spark, cfg, state)
        failed = [r["check"] for r in report.where("not ok").collect()]
        if failed:
            state.offending = fresh_dir(spark, f"{cfg.table}-offending")
            _offending(spark, cfg, state, found, failed).write.parquet(state.offending)
            raise GateFailed(f"verification failed: {', '.join(failed)}; ids: {state.offending}")
        state.phase, state.message = "DONE", None
        state.outcome = "dead_letters" if state.dl_count else "ok"
        _save(spark, cfg, state)
    except KeyboardInterrupt:
        state.outcome = "interrupted"
        _save(spark, cfg, state)
        raise
    except RunConflict:
        raise
    except Exception as error:
        state.outcome, state.message = "failed", str(error)
        _save(spark, cfg, state)
        raise
    return state


def _new_run_id(spark: SparkSession, cfg: SyncConfig) -> str:
    moment = dt.datetime.now(dt.timezone.utc).strftime("%Y%m%dT%H%M%SZ")
    taken = {n.rsplit("-", 1)[0] for kind in (cfg.states, cfg.failures) for n in files.names(spark, kind)}
    run_id, n = moment, 1
    while run_id in taken:
        n += 1
        run_id = f"{moment}_{n:03d}"
    return run_id


def run(spark: SparkSession, cfg: SyncConfig) -> RunState:
    """A new run from preflight to verification. Refused while another one is open."""
    tune(spark)
    open_run = load_state(spark, cfg)
    if open_run is not None and open_run.phase != "DONE":
        raise RunConflict(f"run {open_run.run_id} is in phase {open_run.phase}: resume it")
    before = continue_from(spark, cfg) if cfg.since == LAST else None
    feed = before is not None and before.src_version > 0
    if before is not None and not feed and before.watermark is None:
        before = None
    bound = preflight(spark, cfg, before is not None)
    if before is not None and not feed:
        bound = dt.datetime.fromisoformat(before.watermark).replace(tzinfo=dt.timezone.utc)
    version = store.current_version(spark, cfg.target)
    state = RunState(
        table=cfg.table,
        run_id=_new_run_id(spark, cfg),
        src=cfg.source_name,
        dst=cfg.target,
        ts_field=cfg.ts_field,
        remove_fields=cfg.remove,
        since=bound.isoformat() if bound is not None else None,
        base_version=version,
        version=version,
        src_version=cfg.source_version(spark),
        watermark=before.watermark if before is not None else None,
        from_version=before.src_version if feed else 0,
        inclusive=before is not None and not feed,
    )
    _save(spark, cfg, state)
    return _advance(spark, cfg, state)


def resume(spark: SparkSession, cfg: SyncConfig) -> RunState:
    """Continues the open run at its recorded phase, under the same settings only."""
    tune(spark)
    state = load_state(spark, cfg)
    if state is None:
        raise RunConflict(f"no run of {cfg.table} to resume")
    if state.phase == "DONE":
        return state
    for name, was, now in (
        ("source", state.src, cfg.source_name),
        ("target", state.dst, cfg.target),
        ("timestamp field", state.ts_field, cfg.ts_field),
        ("removed fields", state.remove_fields, cfg.remove),
    ):
        if was != now:
            raise RunConflict(f"the open run has {name} {was!r}, not {now!r}")
    state.started = time.time()
    return _advance(spark, cfg, state)


def abandon(spark: SparkSession, cfg: SyncConfig) -> None:
    """Closes an open run without finishing it; its journal stays for undo."""
    state = load_state(spark, cfg)
    if state is not None and state.phase != "DONE":
        state.phase, state.outcome = "DONE", "interrupted"
        _save(spark, cfg, state)


def undo(
    spark: SparkSession, cfg: SyncConfig, run_id: str | None = None, force: bool = False
) -> int:
    """Puts the target back to the state before a run: rows, and the schema it started from.

    By default that is the newest run with a visible change set that was not undone yet; runs that
    ended before they changed anything do not count, and a second call undoes the run before.
    Returns the new version number. Refused when there is nothing to undo, and when the target was
    written by others since, unless ``force`` accepts that their changes to the same ids go; the
    newest schema is kept then.
    """
    tune(spark)
    undone, others = _undone(spark, cfg), None
    for number_ in reversed(store.versions(spark, cfg.target)):
        owner = store.read_commit(spark, cfg.target, number_)["tag"].get("run_id")
        if owner in undone and owner != run_id:
            continue
        if owner is not None and run_id is None and _state_of(spark, cfg, owner):
            if read_journal(spark, cfg.journal, owner).isEmpty():
                continue  # an empty change set
            run_id = owner
        if owner is not None and owner == run_id:
            break
        others = others or number_
    else:
        raise RunConflict(f"no journal of {cfg.table} to undo")
    if run_id in undone:
        raise RunConflict(f"run {run_id} of {cfg.table} was undone already")
    if others and not force:
        raise RunConflict(f"{cfg.target} was written since run {run_id}: version {others}")
    version = store.current_version(spark, cfg.target)
    state, start = _state_of(spark, cfg, run_id), None
    if state is not None and not others and state.base_version in store.versions(spark, cfg.target):
        start = store.read_commit(spark, cfg.target, state.base_version)
    schema = store.schema_of(start or store.read_commit(spark, cfg.target, version))
    changes = undo_changes(read_journal(spark, cfg.journal, run_id), schema, cfg.routing)
    name = store.stage_changes(changes, cfg.target, schema)
    tag = {"run_id": run_id, "batch": f"undo-{uuid.uuid4().hex}"}
    return store.commit_changes(spark, cfg.target, name, version, tag, schema)


def run_many(spark: SparkSession, configs: Sequence[SyncConfig]) -> DataFrame:
    """Runs tables one after another; a failure does not stop the others.

    Summary with a row per configured table; one that was not reached is ``interrupted``.
    """
    for cfg in configs:
        try:
            open_run = load_state(spark, cfg)
            unfinished = open_run is not None and open_run.phase != "DONE"
            (resume if unfinished else run)(spark, cfg)
        except KeyboardInterrupt:
            break
        except Exception as error:
            _record_failure(spark, cfg, error)
    homes = sorted({cfg.home for cfg in configs})
    states = state_table(spark, homes[0])
    for home in homes[1:]:
        states = states.unionByName(state_table(spark, home))
    names = spark.createDataFrame([(n,) for n in sorted({c.table for c in configs})], "table string")
    done = names.join(summary(states), "table", "left")
    return done.withColumn("outcome", F.coalesce("outcome", F.lit(OUTCOMES[2])))


def _record_failure(spark: SparkSession, cfg: SyncConfig, error: Exception) -> None:
    """Failures before the first recorded step (a bad cutover, say) also appear in the summary.

    They are kept apart from the runs: a failure is no run to resume or undo.
    """
    state = load_state(spark, cfg)
    if state is not None and state.outcome == "failed":
        return
    fresh = RunState(
        table=cfg.table, run_id=_new_run_id(spark, cfg), phase="DONE", src=cfg.source_name,
        dst=cfg.target, ts_field=cfg.ts_field, remove_fields=cfg.remove,
        outcome="failed", message=str(error),
    )
    _save(spark, cfg, fresh, cfg.failures)


__all__ = [
    "LAST", "OUTCOMES", "PHASES", "RunConflict", "RunState", "STATE", "SyncConfig", "abandon",
    "continue_from", "copy_table", "delta_sync", "gate", "load_state", "offending_ids", "plan", "preflight", "rates",
    "read_dead", "reconcile", "resume", "run", "run_many", "severity", "state_table",
    "summary", "undo", "verify", "worst",
]
