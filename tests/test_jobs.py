"""End-to-end runs over the small seed: 20 target rows, 8 updates, 2 creates, 1 delete."""

import datetime as dt
from unittest import mock

import pytest
from pyspark.sql import functions as F

from docsync.operators import checks
from docsync.operators.checks import GateFailed
from docsync.operators.diff import diff
from docsync.operators.journal import audit, duplicate_seqs
from docsync.plans import jobs
from docsync.plans.jobs import SyncConfig
from docsync.sources import files, store
from docsync.sources.journal_store import read_journal

OLD, NEW = dt.datetime(2026, 7, 1), dt.datetime(2026, 7, 20)
CUTOVER = "2026-07-10T00:00:00Z"
SCHEMA = "id string, title string, updated_at timestamp"


def target_rows():
    return [(f"doc-{i:02d}", f"orig-{i}", OLD) for i in range(20)]


def source_rows():
    rows = [(f"doc-{i:02d}", f"UPD-{i}", NEW) for i in range(1, 9)]
    rows += [(f"doc-{i:02d}", f"orig-{i}", OLD) for i in range(9, 20)]
    return rows + [(f"doc-{i}", f"new-{i}", NEW) for i in (20, 21)]


def config(spark, home, rows=None, schema=SCHEMA, **settings):
    root = f"{home}/target"
    if store.current_version(spark, root) == 0:
        store.write_version(spark.createDataFrame(target_rows(), SCHEMA), root, buckets=4)
    data = source_rows() if rows is None else rows

    def source(session):
        return session.createDataFrame(data, schema)

    settings = {"since": CUTOVER, "sample_rows": 5, "freeze_wait": 0, **settings}
    return SyncConfig(table="t", source=source, target=root, home=f"{home}/runs", **settings)


def content(spark, cfg):
    return {r["id"]: r["title"] for r in store.read_table(spark, cfg.target).collect()}


def test_happy_path_journal_and_undo(spark, home):
    cfg = config(spark, home, full_compare=True)
    before = content(spark, cfg)
    state = jobs.run(spark, cfg)
    assert (state.phase, state.outcome) == ("DONE", "ok")
    assert (state.total, state.seen, state.synced) == (10, 10, 10)
    assert (state.deleted_planned, state.deleted_applied) == (1, 1)
    assert (state.repaired_planned, state.repaired_applied) == (0, 0)
    after = content(spark, cfg)
    assert after == {i: t for i, t, _ in source_rows()}

    journal = read_journal(spark, cfg.journal, state.run_id)
    counts = {(r["op"], r["found"]): r["n"] for r in audit(journal).collect()}
    assert counts == {("delta", 1): 8, ("delta", 0): 2, ("delete", 1): 1}
    assert duplicate_seqs(journal).count() == 0
    assert sorted(r["seq"] for r in journal.collect()) == list(range(1, 12))
    assert {r["source"] for r in journal.where("found = 0").collect()} == {"{}"}
    old = journal.where("id = 'doc-03'").select(F.get_json_object("source", "$.title")).first()[0]
    assert old == "orig-3"

    jobs.undo(spark, cfg)
    assert content(spark, cfg) == before
    original = spark.createDataFrame(target_rows(), SCHEMA)
    left = diff(original, store.read_table(spark, cfg.target)).where("status <> 'same'")
    assert left.count() == 0


def test_second_run_has_its_own_journal(spark, home):
    cfg = config(spark, home)
    first = jobs.run(spark, cfg)
    jobs.undo(spark, cfg)
    second = jobs.run(spark, cfg)
    assert first.run_id != second.run_id
    journal = read_journal(spark, cfg.journal, second.run_id)
    assert journal.count() == 11 and duplicate_seqs(journal).count() == 0
    jobs.undo(spark, cfg)
    assert content(spark, cfg)["doc-03"] == "orig-3"


def test_run_on_equal_tables_changes_nothing(spark, home):
    cfg = config(spark, home)
    jobs.run(spark, cfg)
    version = store.current_version(spark, cfg.target)
    again = jobs.run(spark, cfg)
    assert again.outcome == "ok" and again.deleted_planned == 0
    assert content(spark, cfg) == {i: t for i, t, _ in source_rows()}
    assert store.current_version(spark, cfg.target) == version + 1


def test_rejected_row_blocks_deletes_until_allowed(spark, home):
    rows = [(i, t, "not a date" if i == "doc-03" else "2026-07-20T00:00:00Z", ts) for i, t, ts in source_rows()]
    root = f"{home}/target"
    wide = "id string, title string, seen_at timestamp, updated_at timestamp"
    target = spark.createDataFrame([(i, t, OLD, ts) for i, t, ts in target_rows()], wide)
    store.write_version(target, root, buckets=4)
    cfg = config(spark, home, rows, "id string, title string, seen_at string, updated_at timestamp", sample_rows=0)
    with pytest.raises(GateFailed, match="rejected"):
        jobs.run(spark, cfg)
    state = jobs.load_state(spark, cfg)
    assert (state.phase, state.outcome, state.dl_count) == ("DELTA_DONE", "failed", 1)
    assert "doc-00" in content(spark, cfg)
    dead = jobs.read_dead(spark, cfg, state.run_id).first()
    assert (dead["_id"], dead["error"]["type"], dead["tag"]) == ("doc-03", "mapper_parsing_exception", "delta")
    with pytest.raises(jobs.RunConflict, match="resume"):
        jobs.run(spark, cfg)

    state = jobs.resume(spark, jobs.SyncConfig(**{**cfg.__dict__, "allow_partial": True}))
    assert (state.phase, state.outcome, state.deleted_applied) == ("DONE", "dead_letters", 1)
    assert content(spark, cfg)["doc-03"] == "orig-3"


def test_corrected_schema_lets_dead_letters_through(spark, home):
    rows = [(i, t, "many" if i == "doc-03" else "7", ts) for i, t, ts in source_rows()]
    root = f"{home}/target"
    narrow = "id string, title string, n int, updated_at timestamp"
    wide = "id string, title string, n string, updated_at timestamp"
    target = spark.createDataFrame([(i, t, 7, ts) for i, t, ts in target_rows()], narrow)
    store.write_version(target, root, buckets=4)
    cfg = config(spark, home, rows, wide)
    with pytest.raises(GateFailed):
        jobs.run(spark, cfg)
    current = store.read_table(spark, root)
    store.write_version(current.withColumn("n", F.col("n").cast("string")), root)
    state = jobs.resume(spark, cfg)
    assert (state.phase, state.outcome, state.dl_count) == ("DONE", "ok", 0)
    assert content(spark, cfg)["doc-03"] == "UPD-3"


def test_delete_ratio_and_assume_yes(spark, home):
    rows = [r for r in source_rows() if r[0] in ("doc-01", "doc-20", "doc-21")]
    cfg = config(spark, home, rows)
    with pytest.raises(GateFailed, match="more than 0.1 of 22"):
        jobs.run(spark, cfg)
    state = jobs.load_state(spark, cfg)
    assert state.phase == "GATE_PASSED" and state.deleted_planned == 0
    assert spark.read.parquet(state.differences).where("n_src = 0").count() == 19
    state = jobs.resume(spark, jobs.SyncConfig(**{**cfg.__dict__, "assume_yes": True}))
    assert state.deleted_applied == 19 and state.phase == "DONE"


@pytest.mark.parametrize("step", ["append_journal", "commit_changes", "_save"])
def test_crash_and_resume_converges(spark, home, monkeypatch, step):
    cfg = config(spark, home)
    where = store if step == "commit_changes" else jobs
    real, calls = getattr(where, step), []

    def broken(*args, **kwargs):
        calls.append(step)
        if step == "_save" and len(calls) == 1:
            return real(*args, **kwargs)
        if step == "append_journal":
            raise OSError("lost")
        result = real(*args, **kwargs) if step == "commit_changes" else None
        raise KeyboardInterrupt() if result is None else OSError("lost after commit")

    monkeypatch.setattr(where, step, broken)
    with pytest.raises((OSError, KeyboardInterrupt)):
        jobs.run(spark, cfg)
    monkeypatch.undo()
    state = jobs.resume(spark, cfg)
    assert (state.phase, state.outcome) == ("DONE", "ok")
    assert content(spark, cfg) == {i: t for i, t, _ in source_rows()}
    journal = read_journal(spark, cfg.journal, state.run_id)
    assert journal.count() == 11 and duplicate_seqs(journal).count() == 0
    jobs.undo(spark, cfg)
    assert content(spark, cfg) == {i: t for i, t, _ in target_rows()}


def test_moving_source_fails_preflight(spark, home):
    cfg = config(spark, home)
    reads = []

    def moving(session):
        reads.append(1)
        return session.createDataFrame(source_rows()[: 10 + len(reads)], SCHEMA)

    with pytest.raises(GateFailed, match="taking writes"):
        jobs.run(spark, jobs.SyncConfig(**{**cfg.__dict__, "source": moving}))


@pytest.mark.parametrize("since", ["garbage", "2999-01-01T00:00:00Z"])
def test_unusable_cutover(spark, home, since):
    with pytest.raises(GateFailed):
        jobs.run(spark, config(spark, home, since=since))


def test_missing_marker(spark, home):
    with pytest.raises(KeyError):
        jobs.run(spark, config(spark, home, since=None))


@pytest.mark.parametrize("bad", [None, "", "doc-05"])
def test_bad_source_ids_never_lead_to_deletes(spark, home, bad):
    cfg = config(spark, home, source_rows() + [(bad, "x", OLD)])
    with pytest.raises(GateFailed, match="null, empty or repeated"):
        jobs.run(spark, cfg)
    assert "doc-00" in content(spark, cfg)


def test_changed_ids_are_checked_where_they_lie(spark, home):
    """The change set is made once, and its ids are counted without an exchange."""
    cfg = config(spark, home)
    with mock.patch.object(checks, "bad_keys", wraps=checks.bad_keys) as checked:
        jobs.run(spark, cfg)
    assert checked.call_count == 2
    for call in checked.call_args_list:
        rows = call.args[0]
        assert "Exchange" not in checks.bad_keys(rows)._jdf.queryExecution().executedPlan().toString()
        assert all("/chg-" in name for name in rows.inputFiles())


def test_refused_change_set_is_not_taken_up_again(spark, home):
    rows = source_rows()
    cfg = config(spark, home, [*rows, rows[0]])
    with pytest.raises(GateFailed, match="null, empty or repeated"):
        jobs.run(spark, cfg)
    state = jobs.load_state(spark, cfg)
    assert state.layer is None and store.current_version(spark, cfg.target) == 1
    fixed = jobs.SyncConfig(**{**cfg.__dict__, "source": config(spark, home).source})
    assert jobs.resume(spark, fixed).outcome == "ok"
    assert content(spark, fixed) == {i: t for i, t, _ in rows}


def test_contents_are_compared_once(spark, home):
    """A verification that fails keeps the ids it found instead of comparing again."""
    rows = [(i, "moved" if i == "doc-12" else t, ts) for i, t, ts in source_rows()]
    cfg = config(spark, home, rows, full_compare=True, sample_rows=0)
    with mock.patch.object(jobs, "_full_diff", wraps=jobs._full_diff) as compared, mock.patch.object(jobs, "_compared", wraps=jobs._compared) as sides:
        with pytest.raises(GateFailed, match="content_full"):
            jobs.run(spark, cfg)
    assert (compared.call_count, sides.call_count) == (1, 1)
    state = jobs.load_state(spark, cfg)
    found = [("content_full", "doc-12")]
    assert [tuple(r) for r in spark.read.parquet(state.offending).collect()] == found
    assert [tuple(r) for r in jobs.offending_ids(spark, cfg, state).collect()] == found


def test_repair_brings_back_rows_with_old_or_no_timestamp(spark, home):
    rows = source_rows() + [("doc-30", "late", OLD), ("doc-31", "undated", None)]
    state = jobs.run(spark, config(spark, home, rows))
    assert (state.repaired_planned, state.repaired_applied, state.outcome) == (2, 2, "ok")
    cfg = config(spark, home, rows)
    counts = {(r["op"], r["found"]): r["n"] for r in audit(read_journal(spark, cfg.journal, state.run_id)).collect()}
    assert counts[("repair", 0)] == 2
    jobs.undo(spark, cfg)
    assert len(content(spark, cfg)) == 20


def test_full_compare_finds_silent_update(spark, home):
    rows = [(i, "silent" if i == "doc-12" else t, ts) for i, t, ts in source_rows()]
    cfg = config(spark, home, rows, full_compare=True, sample_rows=0)
    with pytest.raises(GateFailed, match="content_full"):
        jobs.run(spark, cfg)


def test_resume_refuses_other_settings(spark, home):
    cfg = config(spark, home, source_rows()[:3])
    with pytest.raises(GateFailed):
        jobs.run(spark, cfg)
    for change in ({"ts_field": "title"}, {"remove": "title"}, {"target": f"{home}/other"}):
        with pytest.raises(jobs.RunConflict):
            jobs.resume(spark, jobs.SyncConfig(**{**cfg.__dict__, **change}))


def test_full_copy_mode_and_removed_field(spark, home):
    rows = [(i, t, ts, NEW) for i, t, ts in source_rows()]
    schema = SCHEMA + ", modified_at timestamp"
    cfg = config(spark, home, rows, schema, ts_field=None, remove="modified_at, nope.x", strict=True)
    state = jobs.run(spark, cfg)
    assert (state.total, state.synced, state.outcome) == (21, 21, "ok")


def test_many_tables_one_failure(spark, home):
    good = config(spark, f"{home}/a")
    bad = jobs.SyncConfig(**{**config(spark, f"{home}/b").__dict__, "table": "u", "since": "garbage", "home": good.home})
    rows = {r["table"]: r for r in jobs.run_many(spark, [bad, good]).collect()}
    assert rows["t"]["outcome"] == "ok" and rows["t"]["deleted"] == 1
    assert rows["u"]["outcome"] == "failed"
    assert jobs.worst(jobs.state_table(spark, good.home)).first()["outcome"] == "failed"
    rate = jobs.rates(jobs.state_table(spark, good.home)).where("table = 't'").first()
    assert rate["rows_per_sec"] > 0


def test_copy_then_marker_then_run(spark, home):
    src = spark.createDataFrame(target_rows(), SCHEMA)
    totals = jobs.copy_table(src, f"{home}/target", buckets=4, cutover=dt.datetime(2026, 7, 10, tzinfo=dt.timezone.utc)).first()
    assert (totals["source_rows"], totals["created"], totals["ok"]) == (20, 20, True)
    assert store.get_marker(spark, f"{home}/target", "cutover_at") == CUTOVER
    assert jobs.run(spark, config(spark, home, since=None)).outcome == "ok"


def test_two_processes_cannot_advance_one_run(spark, home):
    cfg = config(spark, home, source_rows()[:3])
    with pytest.raises(GateFailed):
        jobs.run(spark, cfg)
    mine, theirs = jobs.load_state(spark, cfg), jobs.load_state(spark, cfg)
    jobs._save(spark, cfg, mine)
    with pytest.raises(jobs.RunConflict, match="another process"):
        jobs._save(spark, cfg, theirs)


def test_old_version_stays_readable_and_layers_compact(spark, home):
    root = f"{home}/target"
    store.write_version(spark.createDataFrame(target_rows(), SCHEMA), root, buckets=4)
    first = store.read_table(spark, root)
    for n in range(store.MOST_LAYERS + 1):
        change = spark.createDataFrame([(f"doc-{n:02d}", f"v{n}", NEW)], SCHEMA)
        store.commit_changes(spark, root, store.stage_changes(change.withColumn("op", F.lit("index")), root))
    # The ninth small change folds the change sets and leaves the base alone.
    assert len(store.read_commit(spark, root)["layers"]) == 1
    assert store.read_commit(spark, root)["base"] == store.read_commit(spark, root, 1)["base"]
    titles = {r["id"]: r["title"] for r in store.read_table(spark, root).collect()}
    assert titles["doc-08"] == "v8" and titles["doc-09"] == "orig-9"
    assert {r["title"] for r in first.collect()} == {t for _, t, _ in target_rows()}
    with pytest.raises(store.CommitConflict):
        store.commit_changes(spark, root, "x", expect=1)
    assert len(files.names(spark, f"{root}/_commits")) == store.current_version(spark, root)


def test_half_written_commit_is_a_conflict(spark, home):
    cfg = config(spark, home)
    staged = store.stage_changes(store.read_table(spark, cfg.target).withColumn("op", F.lit("index")), cfg.target)
    with open(f"{cfg.target}/_commits/{2:010d}.json", "w") as half:
        half.write('{"version": 2, "ba')
    with pytest.raises(store.CommitConflict):
        store.commit_changes(spark, cfg.target, staged, expect=1)


def test_of_two_writers_one_wins_and_no_draft_is_seen(spark, home):
    path = f"{home}/x/1.json"
    assert files.create_json(spark, path, {"a": 1})
    assert not files.create_json(spark, path, {"a": 2})
    assert files.read_json(spark, path) == {"a": 1} and files.names(spark, f"{home}/x") == ["1.json"]


def test_resume_applies_what_was_staged(spark, home, monkeypatch):
    cfg = config(spark, home)

    def lost(*args, **kwargs):
        raise OSError("lost")

    monkeypatch.setattr(store, "commit_changes", lost)
    with pytest.raises(OSError):
        jobs.run(spark, cfg)
    monkeypatch.undo()
    assert jobs.load_state(spark, cfg).journal_seq == 0
    # The source gains an update of a row that the delta did not have.
    data = [(i, "LATE" if i == "doc-12" else t, NEW if i == "doc-12" else ts) for i, t, ts in source_rows()]

    def source(session):
        return session.createDataFrame(data, SCHEMA)

    state = jobs.resume(spark, jobs.SyncConfig(**{**cfg.__dict__, "source": source, "sample_rows": 0}))
    journal = read_journal(spark, cfg.journal, state.run_id)
    assert state.journal_seq == journal.count() == 11 and duplicate_seqs(journal).count() == 0
    assert content(spark, cfg)["doc-12"] == "orig-12"
    jobs.undo(spark, cfg)
    assert content(spark, cfg) == {i: t for i, t, _ in target_rows()}


def test_undo_looks_past_failures_and_refuses_what_it_cannot_do(spark, home):
    cfg = config(spark, home)
    with pytest.raises(jobs.RunConflict, match="no journal"):
        jobs.undo(spark, cfg)
    jobs.run(spark, cfg)
    late = jobs.SyncConfig(**{**cfg.__dict__, "since": "garbage"})
    assert jobs.run_many(spark, [late]).first()["outcome"] == "failed"
    store.write_version(store.read_table(spark, cfg.target), cfg.target)
    with pytest.raises(jobs.RunConflict, match="written since"):
        jobs.undo(spark, cfg)
    jobs.undo(spark, cfg, force=True)
    assert content(spark, cfg) == {i: t for i, t, _ in target_rows()}


def test_other_types_and_new_columns_verify(spark, home):
    rows = [(i, t, ts, "7", "x") for i, t, ts in source_rows()]
    root = f"{home}/target"
    target = spark.createDataFrame([(i, t, ts, 7) for i, t, ts in target_rows()], SCHEMA + ", n int")
    store.write_version(target, root, buckets=4)
    cfg = config(spark, home, rows, SCHEMA + ", n string, extra string", full_compare=True)
    with pytest.raises(GateFailed, match="content_full"):  # rows before the cutover lack the new column
        jobs.run(spark, cfg)
    state = jobs.load_state(spark, cfg)
    assert {r["id"] for r in spark.read.parquet(state.offending).where("check = 'content_full'").collect()} == {f"doc-{i:02d}" for i in range(9, 20)}
    jobs.abandon(spark, cfg)
    assert jobs.run(spark, jobs.SyncConfig(**{**cfg.__dict__, "ts_field": None})).outcome == "ok"
    assert {r["extra"] for r in store.read_table(spark, root).collect()} == {"x"}
    dropped = config(spark, f"{home}/b", rows, SCHEMA + ", n string, extra string", unknown="drop", full_compare=True)
    assert jobs.run(spark, dropped).outcome == "ok"


def test_copy_with_misfits_leaves_the_old_version(spark, home):
    root = f"{home}/target"
    jobs.copy_table(spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int"), root, buckets=2)
    bad = spark.createDataFrame([("a", "1"), ("b", "two"), ("c", "3")], "id string, n string")
    totals = jobs.copy_table(bad, root, spark.createDataFrame([], "id string, n int").schema).first()
    assert (totals["ok"], totals["failed"], totals["target_rows"]) == (False, 1, 2)
    assert store.current_version(spark, root) == 1
    assert [r["_id"] for r in spark.read.json(f"{root}/_dead/*").collect()] == ["b"]


def test_text_timestamps_are_refused(spark, home):
    with pytest.raises(GateFailed, match="not a timestamp"):
        jobs.run(spark, config(spark, home, ts_field="title"))


def test_compaction_can_deal_a_table_anew(spark, home):
    cfg = config(spark, home)
    jobs.run(spark, cfg)
    before = content(spark, cfg)
    store.compact(spark, cfg.target, buckets=8)
    commit = store.read_commit(spark, cfg.target)
    assert (commit["buckets"], commit["layers"]) == (8, []) and content(spark, cfg) == before
    with pytest.raises(store.CommitConflict):
        store.compact(spark, cfg.target, version=1, buckets=2)


def test_dates_are_strict(spark):
    from docsync.functions import parse_date

    cases = {
        "12:30": None, "T10:00": None, "2024": dt.datetime(2024, 1, 1), "2024-03": dt.datetime(2024, 3, 1), "2024-1-5": None,
        "2024-01-05": dt.datetime(2024, 1, 5), "2024-01-05T10": dt.datetime(2024, 1, 5, 10), "2024-01-05T10:20": dt.datetime(2024, 1, 5, 10, 20),
        "2024-01-05T10:20:30.5Z": dt.datetime(2024, 1, 5, 10, 20, 30, 500000), "2024-01-05 10:20:30": dt.datetime(2024, 1, 5, 10, 20, 30),
        "2024-01-05T10:20:30+0200": dt.datetime(2024, 1, 5, 8, 20, 30), "2024-01-05T10:20:30-02": dt.datetime(2024, 1, 5, 12, 20, 30),
        "1700000000000": dt.datetime(2023, 11, 14, 22, 13, 20), "2024-13-01": None, "yesterday": None, "": None,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", parse_date(F.col("t")).cast("timestamp_ntz").alias("at"))
    assert {r["t"]: r["at"] for r in rows.collect()} == cases


def test_plan_reads_no_target_document(spark, home):
    cfg = config(spark, home)
    planned = jobs.plan(spark, cfg)
    row = planned.first()
    assert (row["source_total"], row["target_total"], row["delta"], row["net"]) == (21, 20, 10, 1)
    commit = store.read_commit(spark, cfg.target)
    assert commit["rows"] == 20 and row["journal_bytes"] == -(-commit["bytes"] * 10 // 20)
    scans = [line for line in planned._jdf.queryExecution().toString().split("\n") if "title" in line and "ReadSchema" in line]
    assert not scans


def test_expired_versions_go_and_staged_changes_stay(spark, home):
    cfg = config(spark, home)
    jobs.run(spark, cfg)
    store.compact(spark, cfg.target)
    staged = store.stage_changes(store.read_table(spark, cfg.target).withColumn("op", F.lit("index")), cfg.target)
    newest, before = store.current_version(spark, cfg.target), content(spark, cfg)
    gone = store.expire(spark, cfg.target, newest)
    assert len(gone) == 3 and store.versions(spark, cfg.target) == [newest]
    assert content(spark, cfg) == before and staged in files.names(spark, cfg.target)
    assert store.expire(spark, cfg.target, newest + 9) == []


# ---- change feed, continuing, undo in steps ----------------------------------------------


def feed(spark, root, *args, **more):
    return sorted((r["change"], r["id"], r["title"]) for r in store.changes_between(spark, root, *args, **more).collect())


def layered(spark, root, *steps):
    """A table of three rows, then one change set per step of ``(op, id, title)``."""
    schema = "id string, title string"
    store.write_version(spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C")], schema), root, buckets=4)
    for step in steps:
        rows = spark.createDataFrame(step, f"op string, {schema}")
        store.commit_changes(spark, root, store.stage_changes(rows, root))


def test_change_feed_is_the_net_effect(spark, home):
    layered(
        spark, home,
        [("index", "a", "A2"), ("index", "x", "X1"), ("delete", "b", None)],
        [("index", "x", "X2"), ("delete", "a", None), ("index", "y", "Y")],
        [("delete", "y", None), ("index", "b", "B2"), ("delete", "nobody", None)],
    )
    assert feed(spark, home, 1) == [
        ("delete", "a", None), ("delete", "nobody", None), ("delete", "y", None), ("upsert", "b", "B2"), ("upsert", "x", "X2"),
    ]
    assert feed(spark, home, 1, kinds=True) == [("delete", "a", None), ("insert", "x", "X2"), ("update", "b", "B2")]
    assert feed(spark, home, 2, 3, kinds=True) == [("delete", "a", None), ("insert", "y", "Y"), ("update", "x", "X2")]
    assert feed(spark, home, 4) == [] and feed(spark, home, 4, kinds=True) == []
    store.compact(spark, home)
    assert feed(spark, home, 3, kinds=True) == [("delete", "y", None), ("insert", "b", "B2")]
    store.write_version(spark.createDataFrame([("z", "Z")], "id string, title string"), home)
    with pytest.raises(store.NoChangeFeed, match="written whole"):
        feed(spark, home, 1)
    assert feed(spark, home, 1, 4, kinds=True) == [("delete", "a", None), ("insert", "x", "X2"), ("update", "b", "B2")]
    with pytest.raises(LookupError):
        feed(spark, home, 99)


def test_change_feed_over_folds_and_expired_versions(spark, home):
    layered(spark, home, *[[("index", "n", f"N{i}"), ("index", f"i{i}", "I")] for i in range(11)])
    commits = [store.read_commit(spark, home, v) for v in store.versions(spark, home)]
    assert any(len(c["layers"]) < len(b["layers"]) for b, c in zip(commits, commits[1:]))
    want = sorted([("insert", "n", "N10"), *(("insert", f"i{i}", "I") for i in range(11))])
    assert feed(spark, home, 1, kinds=True) == want
    store.expire(spark, home, before=9)
    assert feed(spark, home, 9) == [("upsert", f"i{i}", "I") for i in (10, 8, 9)] + [("upsert", "n", "N10")]
    with pytest.raises(LookupError):
        feed(spark, home, 1)


def test_run_continues_by_the_change_feed(spark, home):
    source = f"{home}/source"
    store.write_version(spark.createDataFrame(source_rows(), SCHEMA), source, buckets=4)
    cfg = config(spark, home, since="last")
    cfg = SyncConfig(**{**cfg.__dict__, "source": source})
    store.set_marker(spark, source, "cutover_at", CUTOVER)
    first = jobs.run(spark, cfg)
    assert first.from_version == 0 and first.outcome == "ok"
    # A change that leaves the timestamp alone, a new row and a delete: all are found without timestamps.
    rows = [("index", "doc-09", "silent", OLD), ("index", "doc-30", "new", OLD), ("delete", "doc-10", None, None)]
    staged = store.stage_changes(spark.createDataFrame(rows, f"op string, {SCHEMA}"), source)
    store.commit_changes(spark, source, staged)
    second = jobs.run(spark, SyncConfig(**{**cfg.__dict__, "full_compare": True}))
    assert (second.from_version, second.seen, second.synced, second.deleted_applied) == (1, 2, 2, 1)
    got = content(spark, cfg)
    assert got["doc-09"] == "silent" and got["doc-30"] == "new" and "doc-10" not in got
    assert jobs.run(spark, cfg).journal_seq == 0


def test_run_continues_inclusively_from_the_watermark(spark, home):
    """Rows of one time, some before the first run and some after it: none lost, none journaled twice."""
    cfg = config(spark, home)
    first = jobs.run(spark, cfg)
    assert first.watermark == str(NEW)
    late = [*source_rows()[1:], ("doc-01", "UPD-1 again", NEW), ("doc-40", "late", NEW)]
    cfg = config(spark, home, late, since="last")
    second = jobs.run(spark, cfg)
    assert second.inclusive and (second.seen, second.synced, second.journal_seq) == (11, 2, 2)
    assert content(spark, cfg) == {i: t for i, t, _ in late}
    third = jobs.run(spark, cfg)
    assert third.synced == 0 and third.watermark == str(NEW)
    # An undone run is not continued.
    jobs.undo(spark, cfg)
    assert jobs.continue_from(spark, cfg).run_id == first.run_id


def test_undo_passes_over_runs_that_changed_nothing(spark, home, monkeypatch):
    cfg = config(spark, home)
    before = content(spark, cfg)
    first = jobs.run(spark, cfg)

    def lost(*args, **kwargs):
        raise OSError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(store, "commit_changes", lost)
        with pytest.raises(OSError):
            jobs.run(spark, config(spark, home, [("doc-01", "other", dt.datetime(2026, 7, 25)), *source_rows()[1:]]))
    jobs.abandon(spark, cfg)
    assert jobs.load_state(spark, cfg).run_id != first.run_id
    jobs.undo(spark, cfg)
    assert content(spark, cfg) == before


def test_undo_steps_back_run_by_run(spark, home):
    cfg = config(spark, home)
    start = content(spark, cfg)
    first = jobs.run(spark, cfg)
    middle = content(spark, cfg)
    rows = [(i, f"{t}!", dt.datetime(2026, 7, 25)) for i, t, _ in source_rows()]
    second = jobs.run(spark, config(spark, home, rows))
    jobs.undo(spark, cfg)
    assert content(spark, cfg) == middle
    with pytest.raises(jobs.RunConflict, match="undone already"):
        jobs.undo(spark, cfg, second.run_id)
    jobs.undo(spark, cfg)
    assert content(spark, cfg) == start
    with pytest.raises(jobs.RunConflict, match="no journal"):
        jobs.undo(spark, cfg)
    with pytest.raises(jobs.RunConflict, match="undone already"):
        jobs.undo(spark, cfg, first.run_id)
    # A new run after that is undone as any other.
    jobs.run(spark, cfg)
    jobs.undo(spark, cfg)
    assert content(spark, cfg) == start


def test_undo_restores_the_schema(spark, home):
    cfg = config(spark, home)
    names = store.read_table(spark, cfg.target).columns
    rows = [(i, t, ts, 1) for i, t, ts in source_rows()]
    cfg = config(spark, home, rows, f"{SCHEMA}, extra int", sample_rows=0)
    jobs.run(spark, cfg)
    assert store.read_table(spark, cfg.target).columns == [*names, "extra"]
    jobs.undo(spark, cfg)
    assert store.read_table(spark, cfg.target).columns == names
    left = diff(spark.createDataFrame(target_rows(), SCHEMA), store.read_table(spark, cfg.target)).where("status <> 'same'")
    assert left.count() == 0


def test_maps_that_could_not_be_undone_are_refused(spark, home):
    rows = [(i, t, ts, [{1: "x"}]) for i, t, ts in source_rows()]
    cfg = config(spark, home, rows, f"{SCHEMA}, extra array<map<int, string>>")
    version = store.current_version(spark, cfg.target)
    with pytest.raises(GateFailed, match="extra is a map with int keys"):
        jobs.run(spark, cfg)
    assert store.current_version(spark, cfg.target) == version
