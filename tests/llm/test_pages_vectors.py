"""Pages, archives, vectors, and the pipeline."""

import base64
import gzip
import hashlib
import os
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docsync.llm import cover_tree, html_pages, html_text, registry, warc
from docsync.llm.components import components
from tests.llm.fixtures import documents

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
PAGES = "page_id long, url string, html string, text string, digest string, bytes long"


def pages(spark):
    rows = [
        (1, "http://a", None), (2, None, ""), (3, "http://a\r\nX: y", "<p>same</p>"), (4, "http://b", "<p>same</p>"),
        (5, "http://c", "<p>same</p>"), (6, "u", "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n"), (7, "u", "<p>" + "long text. " * 100_000),
        (8, "u", "<div " * 3000), (9, "u", "<div class='content'>" + "<div>" * 3000 + "deep text here, with a sentence." + "</div>" * 3000), (10, "u", "é\U0001f600 \x00 &eacute;&nbsp;&#x41;"),
    ]
    return spark.createDataFrame([(*r, "t", "d", 1) for r in rows], PAGES)


# Main text


def test_messages_equal_enumeration():
    """Marginals of a small tree against the sum over all states."""
    tree = html_text.build("<div><p>one two</p><ul><li>three</li></ul></div>")
    forest = html_text.join_trees([tree])
    rng = np.random.default_rng(1)
    w = html_text.Weights(rng.normal(size=len(html_text.NAMES)), rng.normal(size=(2, 2, 2)))
    marginal, joint = html_text.sum_product(forest, w)
    n = len(forest.parent)
    node = np.bincount(forest.row, w.node[forest.feature], n)
    total, ones, pairs = 0.0, np.zeros(n), np.zeros((n, 2, 2))
    for code in range(2**n):
        y = [(code >> i) & 1 for i in range(n)]
        score = sum(node[i] for i in range(n) if y[i])
        for c, p in enumerate(forest.parent):
            if p >= 0:
                score += w.pair[int(forest.is_run[c])][y[p], y[c]]
        p = np.exp(score)
        total += p
        ones += p * np.array(y)
        for c, q in enumerate(forest.parent):
            if q >= 0:
                pairs[c, y[q], y[c]] += p
    assert np.allclose(marginal, ones / total)
    assert np.allclose(joint[1:], pairs[1:] / total)


def test_held_out_layouts():
    """Trained on some fillings, right on pages filled otherwise."""
    w = html_text.train()
    trees = [html_text.build(p) for p in html_pages.labelled_pages(2, seed=99)]
    marginal, _ = html_text.sum_product(html_text.join_trees(trees), w)
    label = np.array([x for t in trees for x in t.label])
    run = np.array([x is not None for t in trees for x in t.text])
    assert ((marginal >= 0.5) == label)[run].mean() > 0.98


def test_extract_blocks_and_references(spark):
    html = (
        "<html><head><title>no</title><script>if (a<b) x('<p>no</p>')</script></head><body><nav><a href=/>no</a></nav>"
        "<article><h1>Big &amp; small</h1><p>One\n\t two&nbsp;<b>three</b><i>four</i>.<p>Next &lt;p&gt; one.</article>"
        "<div class='comments'><p>Not this one, please.</p></div><footer>&copy; no</footer>"
    )
    table = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    row = html_text.extract(table).first()
    assert row.text == "Big & small\nOne two threefour.\nNext <p> one."
    assert row.n_chars == len(row.text)


def test_extract_awkward_rows(spark):
    rows = {r.page_id: r for r in html_text.extract(pages(spark)).collect()}
    assert len(rows) == 10 and rows[1].text == "" and rows[2].text == "" and rows[1].n_chars == 0
    assert len(rows[7].text) > 1_000_000 and rows[2].url is None
    assert "deep text" in rows[9].text
    assert html_text.extract(pages(spark).limit(0)).count() == 0


MAIN = "<article><h1>A heading</h1><p>One longer sentence of text.</p>{}<p>Another sentence of the text.</p></article><footer>&copy; x</footer>"


@pytest.mark.parametrize(
    "html",
    [
        "<html><head><title>T</title><body>" + MAIN.format(""), "<html><head><meta charset=x><title>T</title>" + MAIN.format(""),
        "<head><title>T<body>" + MAIN.format(""), "<head><title>T" + MAIN.format(""), "<head><noscript><div>no</div></noscript>" + MAIN.format(""),
        *(MAIN.format(f"<div><{t}>no</div>") for t in ("button", "svg", "object", "select", "noscript", "iframe", "textarea")),
        *(MAIN.format(f"<{t}>no <b>no</b>") for t in ("button", "svg", "object", "select", "noscript", "template")),
        MAIN.format("<select><option>no<option>no</select>"), MAIN.format("<button><p>no</p></button><svg><title>no</svg>"),
        MAIN.format("<svg><object><div><button>no</div></object></svg>"), MAIN.format("<button>no<button>no</button>"), MAIN.format("<svg>" * 3000),
        MAIN.format("<noscript><p>no</p></noscript><script>'<p>no'</script>"),
    ],
)
def test_dropped_elements_without_end_tags(html):
    runs = [x for x in html_text.build(html).text if x]
    wanted = ["A heading", "One longer sentence of text.", "Another sentence of the text."]
    assert [x for x in runs if x != "\u00a9 x"] == wanted
    assert html_text.main_texts([html], html_text.train(), {}) == [wanted]


def test_head_ends_at_text_of_the_body():
    assert [x for x in html_text.build("<head><title>no</title>\n<link href=x>Plain <b>text</b>").text if x] == ["Plain text"]


@needs_data
def test_extract_given_pages(spark):
    import html
    import re

    rows = html_text.extract(spark.read.parquet(f"{SF}/pages.parquet")).collect()
    given = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in rows:
        inside = given[r.page_id].split("<article>")[1].split("</article>")[0]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", inside)]
        assert r.text == "\n".join(b for b in blocks if b)


# Archives


def check_archive(rows, table):
    by = {}
    for p in table.collect():
        by.setdefault((p.html or "").encode(), []).append(p.page_id)
    rows = {r.page_id: r for r in rows}
    assert len(rows) == sum(map(len, by.values()))
    for payload, ids in by.items():
        for i in ids:
            r = rows[i]
            assert r.payload_bytes == len(payload)
            assert r.payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
            last = max(ids)
            assert (r.record_type, r.refers_to) == (("response", None) if i == last else ("revisit", last))


def test_archive_round_trip(spark):
    check_archive(warc.archive_round_trip(pages(spark)).collect(), pages(spark))
    assert warc.archive_round_trip(pages(spark).limit(0)).count() == 0


def test_archive_of_repeated_and_null_ids(spark, home):
    rows = [
        (1, "a", "one"), (1, "b", "two"), (1, "b", "two"), (2, "c", "two"), (2, "c", "two"), (None, "d", "two"), (None, "e", "own"),
        (None, "e", "own"), (None, None, None), (3, "f", "one"), (4, "g", "alone"),
    ]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    last = {"two": 2, "one": 3}
    wanted = []
    for i, _, html in rows:
        payload = (html or "").encode()
        refers = last.get(html) if last.get(html) != i else None
        wanted.append((i, len(payload), warc.digest(payload), "response" if refers is None else "revisit", refers, 1))
    assert sorted(map(tuple, warc.archive_round_trip(table).collect()), key=repr) == sorted(wanted, key=repr)
    warc.write_warc(table, home)
    records = warc.read_warc(spark, home).collect()
    ids = {r.record_id for r in records}
    assert len(ids) == len(records) == 3 * len(rows)
    payloads = {r.record_id: r.payload_sha1 for r in records if r.kind == "response"}
    for r in records:
        if r.kind == "revisit":
            assert f"sha1:{payloads[r.refers_to]}" == r.payload_digest
    captures = warc.captures(warc.read_warc(spark, home)).collect()
    assert sorted(c.response.target_uri for c in captures) == sorted(u or "" for _, u, _ in rows)


@needs_data
def test_archive_of_given_pages(spark):
    table = spark.read.parquet(f"{SF}/pages.parquet")
    check_archive(warc.archive_round_trip(table.union(table.withColumn("page_id", F.col("page_id") + 100_000))).collect(),
                  table.union(table.withColumn("page_id", F.col("page_id") + 100_000)))


def test_archive_keeps_payloads_and_least_bytes(spark, home):
    warc.write_warc(pages(spark), home, least_bytes=12)
    records = warc.read_warc(spark, home)
    assert {r.kind: r["count"] for r in records.groupBy("kind").count().collect()} == {"request": 10, "response": 10, "metadata": 10}
    rows = {int(r.response.headers["x-page-id"]): r for r in warc.captures(records).collect()}
    for p in pages(spark).collect():
        assert bytes(rows[p.page_id].response.payload) == (p.html or "").encode()
        assert len(rows[p.page_id].request) == len(rows[p.page_id].metadata) == 1


def test_read_gzip_members_and_cut_files(spark, home):
    os.makedirs(home)
    one = warc.build_record("response", [("WARC-Record-ID", "<a>")], "abc") + warc.RECORD_END
    two = warc.build_record("request", [("WARC-Record-ID", "<b>"), ("WARC-Concurrent-To", "<a>")], "GET") + warc.RECORD_END
    with open(f"{home}/x.warc.gz", "wb") as f:
        f.write(gzip.compress(one.encode()) + gzip.compress(two.encode()))
    with open(f"{home}/cut.warc", "w", newline="") as f:
        f.write(one.replace("<a>", "<c>") + two[:-8])
    open(f"{home}/empty.warc", "w").close()
    records = warc.read_warc(spark, home)
    assert sorted(r.record_id for r in records.collect()) == ["<a>", "<b>", "<c>"]
    rows = {r.record_id: r for r in warc.captures(records).collect()}
    assert set(rows) == {"<a>", "<c>"} and rows["<a>"].request[0].record_id == "<b>" and rows["<c>"].request is None


# Vectors


def brute_top(rows, k=5):
    good = {}
    data = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        w = [int(np.floor(256 * float(np.float32(x)))) for x in v]
        data.append((i, w))
        if i % 50 == 0:
            good[i] = min(good.get(i, w), w)
    out = set()
    for q, w in good.items():
        score = lambda x: min(max(sum(a * b for a, b in zip(w, x)), -(2**63)), 2**63 - 1)  # noqa: B023, E731
        scored = sorted((-score(x), i) for i, x in data if i != q)[:k]
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)}
    return out


def run_top(spark, rows, **more):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("cell", F.lit("x"))
    return {tuple(r) for r in cover_tree.top_k(table.where("vec_id % 50 = 0"), table, **more).collect()}


def test_top_k_clustered(spark, monkeypatch):
    for name, value in (("BLOCK", 64), ("QUERY_BLOCK", 8), ("ROWS_PER_PIVOT", 150), ("LEAF", 8)):
        monkeypatch.setattr(cover_tree, name, value)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8)) * 3
    rows = [(i, (centres[i % 6] + 0.2 * rng.normal(size=8)).tolist()) for i in range(900)]
    assert run_top(spark, rows) == brute_top(rows)


def test_top_k_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0]), (50, [0.5, -1.0]), (100, None), (150, [nan, 1.0]), (200, [None, 1.0]), (250, [inf, 0.0]), (None, [1.0, 1.0]),
        (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [1.0, 2.0]), (4, [1.0, 2.0]), (5, [1.0, 2.0]), (6, [1.0, 2.0]), (7, [1e9, 0.0]), (300, [200000.0, 200000.0]),
        (0, [1.0, 2.0]),
    ]
    assert run_top(spark, rows) == brute_top(rows)
    assert run_top(spark, [(0, [1.0])]) == set()
    assert run_top(spark, []) == set()
    # Beyond a long on either side, with ties among the least scores.
    large = [(0, [2.0**30, 1.0]), (50, [-(2.0**60), 3.0]), (100, [1.0, 2.0**40])] + [(i, [(-1.0) ** i * 2.0 ** (20 + 3 * i), float(i)]) for i in range(1, 25)]
    assert run_top(spark, large) == brute_top(large)
    # One id a third of all rows.
    often = [(7, [1.0, float(i % 3)]) for i in range(40)] + [(i, [float(i % 7), 1.0]) for i in range(100, 180)]
    assert run_top(spark, often) == brute_top(often)
    # Shorter vectors are padded by zeros.
    assert {r[2:] for r in run_top(spark, [(0, [1.0, 1.0]), (1, [1.0])])} == {(1, 65536)}


def test_top_k_of_large_components_equals_the_sql(spark):
    rng = np.random.default_rng(8)
    rows = [(i, (rng.normal(size=4) * 4.0 ** (i % 11)).astype(np.float32).tolist()) for i in range(300)]
    columns = {"vec_id": [i for i, _ in rows], "embedding": pa.array([v for _, v in rows], pa.list_(pa.float32()))}
    with duckdb.connect() as db:
        db.register("embeddings", pa.table(columns))
        wanted = set(db.sql(registry.TOP_K).fetchall())
    assert max(abs(x) for _, v in rows for x in v) > 2**20 and run_top(spark, rows) == wanted


def test_bound_holds():
    rng = np.random.default_rng(5)
    points = rng.integers(-300, 300, (500, 6)).astype(float)
    tree = cover_tree.Tree(cover_tree.grow_tree(np.arange(500), points))
    for node in range(len(tree.low)):
        own = tree.points[tree.low[node] : tree.high[node]]
        assert np.sqrt(((own - tree.centre[node]) ** 2).sum(axis=1)).max() <= tree.radius[node] + 1e-9
    pairs = rng.integers(0, len(tree.low), (200, 2))
    top = cover_tree.bound(tree, pairs[:, 0], tree, pairs[:, 1])
    for (a, b), t in zip(pairs, top):
        assert (tree.points[tree.low[a] : tree.high[a]] @ tree.points[tree.low[b] : tree.high[b]].T).max() <= t


# Components and pipeline


def test_components_against_union_find(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1200)] + [(5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    single = {x for x in parent if root(x) == x and sum(root(y) == x for y in parent) == 1}
    assert got == {x: root(x) for x in parent if x not in single}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@needs_data
def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, count = docs.columns, docs.count()
    seen = [count]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
        seen.append(docs.count())
        assert seen[-1] <= seen[-2] and seen[-1] > 0.6 * count, name
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.select("doc_id").collect()}
    assert {(r.doc_id, r.piece) for r in corpus_pipeline.run(spark, SF).collect()} == {(r.doc_id, r.piece) for r in rows}


@needs_data
def test_pipeline_stages_on_awkward_rows(spark):
    docs = documents(spark)
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).count()
        stage(spark, docs.limit(0), SF).count()
