"""Lexical search, hard negatives and language-model scores against brute force."""

import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docsync.llm import hard_negatives, lexical, registry, suffix_tree, vectors
from tests.llm.fixtures import SCHEMA, documents, no_documents
from tests.oracle import compare

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

# Lexical search


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def brute_rank(docs, items, k=10):
    docs = [(i, terms(t)) for i, t in docs]
    docs = [(i, t, Counter(t)) for i, t in docs if t]
    n_docs, length = len(docs), sum(len(t) for _, t, _ in docs)
    df = Counter(x for _, _, c in docs for x in c)
    least = {}
    for i, t in items:
        if t is not None:
            least[i] = min(least.get(i, t), t)
    out = []
    for i, t in least.items():
        scored = []
        for doc, all_terms, tf in docs:
            m = 25 + 75 * len(all_terms) * n_docs // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (10**9 * tf[x] // (1000 * tf[x] + 8 * m)) for x in terms(t))
            if s > 0:
                scored.append((-s, doc is None, doc or 0, doc))
        out += [(i, r, doc, -s) for r, (s, _, _, doc) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return out


def run_rank(spark, docs, items, **more):
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit("x")).withColumn("terms", F.lit(1))
    return sorted((tuple(r) for r in lexical.rank(docs, table, **more).collect()), key=repr)


ITEMS = [
    (1, "alpha Beta gamma, delta; river-stone"), (2, None), (3, ""), (4, "?!"), (5, "winter"), (6, "winter winter winter letter"),
    (7, "unheard words"), (8, "éè 中文 1234"), (9, "one"), (9, "alpha one"), (None, "garden bridge"), (10, "alpha " * 5000 + "evening"),
]


def test_rank_awkward_rows(spark, monkeypatch):
    docs = documents(spark)
    want = sorted(brute_rank([(r.doc_id, r.text) for r in docs.collect()], ITEMS), key=repr)
    assert run_rank(spark, docs, ITEMS) == want and len(want) > 30
    # Items in several blocks, tries of two documents.
    for name, value in (("BLOCK_TERMS", 5), ("TRIE_DOCS", 2), ("LEAF", 1)):
        monkeypatch.setattr(lexical, name, value)
    assert run_rank(spark, docs, ITEMS) == want
    monkeypatch.setattr(lexical, "TRIE_ENTRIES", 3)
    assert run_rank(spark, docs, ITEMS, k=2) == sorted(brute_rank([(r.doc_id, r.text) for r in docs.collect()], ITEMS, 2), key=repr)


def test_rank_empty_tables(spark):
    assert run_rank(spark, no_documents(spark), ITEMS) == []
    assert run_rank(spark, documents(spark), []) == []
    assert run_rank(spark, spark.createDataFrame([(1, None), (2, "..")], "doc_id long, text string"), ITEMS) == []


def test_rank_copies_and_ties(spark):
    """A third of all documents are copies; equal scores go by id."""
    rng = random.Random(4)
    vocabulary = [f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(3000)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 60)))) for i in range(600)]
    rows += [(1000 + i, "w1 w2 w3 w4 w5 w6 w7 common copy") for i in range(300)]
    rng.shuffle(rows)
    items = [(i, " ".join(rng.choices(vocabulary, k=12))) for i in range(20)] + [(99, "common copy w1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert run_rank(spark, docs, items) == sorted(brute_rank(rows, items), key=repr)


def test_trie_bounds_hold_and_paths_are_shared():
    rng = np.random.default_rng(2)
    size = rng.integers(1, 12, 400)
    ends = np.concatenate([[0], np.cumsum(size)])
    words = np.concatenate([np.sort(rng.choice(30, n, replace=False, p=np.arange(30, 0, -1) / 465)) for n in size]).astype(np.int32)
    tf, m = rng.integers(1, 9, len(words)).astype(np.int32), rng.integers(25, 300, 400)
    trie = lexical.Trie(np.arange(400), m, words, tf, ends, np.arange(30))
    asked, weights = np.array([0, 3, 17, 29]), np.array([5, 70, 300, 900])
    bound = trie.bounds(asked, weights)
    for node in range(len(trie.low)):
        for d in range(trie.low[node], trie.high[node]):
            own = dict(zip(trie.terms[trie.ends[d] : trie.ends[d + 1]].tolist(), trie.tf[trie.ends[d] : trie.ends[d + 1]].tolist()))
            assert sum(w * (10**9 * own[t] // (1000 * own[t] + 8 * trie.m[d])) for t, w in zip(asked.tolist(), weights.tolist()) if t in own) <= bound[node]
    assert sorted(trie.ids.tolist()) == list(range(400)) and len(trie.low) < 400
    paths = [tuple(trie.terms[a:b].tolist()) for a, b in zip(trie.ends[:-1], trie.ends[1:])]
    assert paths == sorted(paths)


@needs_data
@pytest.mark.parametrize("name", ["op11_lexical", "op12_hard_negatives"])
def test_query_equals_sql(spark, name):
    assert compare(spark, SF, registry.QUERIES[name], registry.ORACLE[name]) is None


# Vectors and hard negatives


def test_inner_products_are_exact():
    rng = np.random.default_rng(1)
    for size in (10.0, 1e6, 1e9, 1e12, 1e30):
        q, p = np.floor(rng.normal(size=(7, 5)) * size), np.floor(rng.normal(size=(9, 5)) * size)
        p[0] = 1
        want = [[min(max(sum(int(x) * int(y) for x, y in zip(a, b)), -(2**63)), 2**63 - 1) for b in p.tolist()] for a in q.tolist()]
        assert vectors.inner_products(q, p).tolist() == want


def brute_mine(rows, positives=5, negatives=3):
    data, anchors = [], {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        w = [int(math.floor(256 * float(np.float32(x)))) for x in v]
        data.append((i, w, label))
        if i % 50 == 0:
            anchors[i] = min(anchors.get(i, (w, label)), (w, label))
    out = []
    for a, (w, label) in anchors.items():
        scored = sorted((-min(max(sum(x * y for x, y in zip(w, v)), -(2**63)), 2**63 - 1), i, other) for i, v, other in data if i != a)
        for s, i, _ in [x for x in scored if x[2] == label][:positives]:
            fit = [(t, j) for t, j, other in scored if other != label and 50 * -s <= 100 * -t <= 95 * -s][:negatives]
            out += [(a, i, r, j, -s, -t) for r, (t, j) in enumerate(fit, 1)]
    return sorted(out)


def run_mine(spark, rows):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("score", F.lit(1)).withColumn("cell", F.lit("x"))
    table = table.withColumn("slot", F.lit(2)).withColumn("rank", F.lit(3))
    return sorted(tuple(r) for r in hard_negatives.mine(table.where("vec_id % 50 = 0"), table).collect())


def test_mine_clustered(spark, monkeypatch):
    for name, value in (("BLOCK", 64), ("ANCHORS", 4), ("ROWS_PER_CELL", 100), ("LEAF", 8), ("FAN", 4)):
        monkeypatch.setattr(hard_negatives, name, value)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8)) * 3
    rows = [(i, (centres[i % 6] + 0.5 * rng.normal(size=8)).tolist(), int(rng.integers(4))) for i in range(900)]
    want = brute_mine(rows)
    assert run_mine(spark, rows) == want and len(want) > 100


def test_mine_hot_copies(spark, monkeypatch):
    """A third of all rows are one vector under one id, all of one label."""
    monkeypatch.setattr(hard_negatives, "BLOCK", 64)
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=4).tolist(), i % 3) for i in range(400)] + [(777, [1.0, 1.0, 0.5, 0.0], 1)] * 200
    assert run_mine(spark, rows) == brute_mine(rows)


def test_mine_broadcasts_nothing_that_grows(spark, monkeypatch):
    """Only numbers by cell are broadcast: neither trees nor anchors nor what was found."""
    monkeypatch.setattr(hard_negatives, "BLOCK", 64)
    plans, write = [], hard_negatives.materialize
    plan = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    monkeypatch.setattr(hard_negatives, "materialize", lambda df, label: (plans.append((label, plan(df))), write(df, label))[1])
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=4).tolist(), i % 3) for i in range(400)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    plans.append(("result", plan(hard_negatives.mine(table.where("vec_id % 50 = 0"), table))))
    joins = [(label, p.count("SortMergeJoin"), p.count("BroadcastHashJoin")) for label, p in plans if "Join" in p]
    assert joins == [("trees", 0, 1), ("home", 1, 1), ("sent", 1, 0), ("positives", 1, 1), ("sent", 1, 0), ("result", 2, 1)]


def test_mine_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0], 1), (50, [0.5, -1.0], 1), (100, None, 1), (150, [nan, 1.0], 1), (200, [None, 1.0], 2), (250, [inf, 0.0], 1), (None, [1.0, 1.0], 1),
        (300, [1.0, 1.0], None), (1, [1.0, 2.0], 1), (2, [1.0, 1.5], 2), (3, [1.0, 1.5], 2), (4, [0.9, 1.5], 3), (5, [-1.0, 0.0], 2), (6, [1.0, 2.0], 1),
        (0, [1.0, 2.0], 1), (2, [1.0, 1.5], 2), (350, [3e38, 0.0], 4), (7, [1e9, 1.0], 4), (8, [2e30, 1.0], 5), (9, [1e8, 0.0], 5), (400, [], 7), (10, [1.0], 7), (450, [0.0, 0.0], 1),
    ]
    rows = [(i, v + [0.0] * (2 - len(v)) if v is not None else v, x) for i, v, x in rows]
    want = brute_mine(rows)
    assert run_mine(spark, rows) == want and want
    assert run_mine(spark, [(0, [1.0], 1)]) == [] and run_mine(spark, []) == []
    # Shorter vectors are padded by zeros.
    assert run_mine(spark, [(0, [1.0, 1.0], 1), (1, [1.0], 1), (2, [0.5, 0.25], 2)]) == [(0, 1, 1, 2, 65536, 49152)]


def test_ranges_never_drop_a_hit():
    rng = np.random.default_rng(7)
    points, queries = rng.integers(-300, 300, (400, 5)).astype(float), rng.integers(-300, 300, (30, 5)).astype(float)
    chosen = points[hard_negatives.split_points(points, 12)]
    away = hard_negatives.distances(points, chosen)
    which = away.argmin(axis=1)
    length = np.sqrt((points**2).sum(axis=1))
    split = hard_negatives.Split(
        chosen, *hard_negatives.ranges(away, which, len(chosen)),
        *(np.array([f(length[which == c]) for c in range(len(chosen))]) for f in (np.min, np.max)),
    )
    scores = queries @ points.T
    middle = np.quantile(scores, rng.random(30))
    low, high = middle, middle + 2000
    ok = split.alive(hard_negatives.distances(queries, chosen), (queries**2).sum(axis=1), low, high)
    hits = (scores >= low[:, None]) & (scores <= high[:, None])
    for q, x in zip(*np.nonzero(hits)):
        assert ok[q, which[x]]
    assert not ok.all()


# Language-model scores


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER)) + [0]


def brute_scores(rows, depth=2):
    """The docstring's model with dictionaries: n-grams are tuples, None is the start, 0 the end."""
    least, context_least, discount, threshold = (getattr(suffix_tree, n) for n in ("MIN_GRAM", "MIN_CONTEXT", "DISCOUNT", "THRESHOLD"))
    learned = [tokens(t) for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 10]
    counts = [Counter() for _ in range(depth + 2)]
    for text in learned:
        text = [None, *text]
        for d in range(1, depth + 2):
            for i in range(len(text) - d + 1):
                counts[d][tuple(text[i : i + d])] += 1
    total = sum(len(t) for t in learned)
    context_least = max(context_least, math.ceil(suffix_tree.MIN_SHARE * total))
    words = {g: c for g, c in counts[1].items() if g != (None,)}
    once, twice = (sum(c == n for c in words.values()) for n in (1, 2))
    d0 = min(max(once / max(once + 2 * twice, 1), 0.1), 0.9)

    def root(word):
        if not total:
            return 1.0
        return (words[(word,)] - d0) / total if (word,) in words else d0 * len(words) / total

    rest, p, keep = {}, {}, set()
    for d in range(1, depth + 1):
        below = defaultdict(list)
        for gram, c in counts[d + 1].items():
            if c >= least and counts[d][gram[:-1]] >= context_least:
                below[gram[:-1]].append((gram, c))
        for s, grams in below.items():
            n = counts[d][s]
            rest[s] = (n - sum(c for _, c in grams) + discount * len(grams)) / n
            gain = (n - sum(c for _, c in grams)) * math.log(rest[s])
            for gram, c in grams:
                parent = root(gram[-1]) if d == 1 else p[gram[1:]]
                p[gram] = (c - discount) / n + rest[s] * parent
                gain += c * math.log(p[gram] / parent)
            if gain >= threshold:
                keep |= {s[i:] for i in range(len(s))}
    out = []
    for i, text in rows:
        held = i is not None and zlib.crc32(str(i).encode()) % 10 == 0
        own, known, base, score = tokens(text), 0, 0.0, 0.0
        for at, word in enumerate(own):
            c = words.get((word,), 0)
            known += c > 0
            base += math.log10((c + 0.1) / (total + 0.1 * (len(words) + 1)))
            before, chance = [None, *own[:at]], root(word)
            for d in range(1, min(depth, len(before)) + 1):
                s = tuple(before[len(before) - d :])
                if s in keep:
                    chance = p[(*s, word)] if (*s, word) in p else rest[s] * chance
            score += math.log10(chance)
        out.append((i, held, len(own), known, total, base, score))
    return out, keep


def texts_with_habits(seed=1, n=300):
    rng = random.Random(seed)
    follows = {w: rng.choices(range(60), k=3) for w in range(60)}
    rows = []
    for i in range(n):
        word, out = rng.randrange(60), []
        for _ in range(rng.randrange(0, 60)):
            word = rng.choice(follows[word]) if rng.random() < 0.8 else int(rng.paretovariate(0.5)) % 3000
            out.append(f"W{word}")
            word %= 60
        rows.append((i, " ".join(out)))
    return rows + [(1000 + i, "the same long passage comes again and again in copies of one text") for i in range(100)] + [(None, "w1 w2"), (None, None), (5, "W1"), (5, "w1")]


def same_scores(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:4], round(r[5], 6))
    got, want = sorted((tuple(r) for r in got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-6, atol=1e-6)


@pytest.mark.parametrize("depth, head, share", [(2, 40, 0.002), (1, 1 << 20, 0), (3, 0, 0)])
def test_scores_equal_brute_force(spark, monkeypatch, depth, head, share):
    """Also with most or all entries looked up by the join, and counts sent in many parts."""
    for name, value in (("HEAD_WORDS", head), ("HEAD_GRAMS", head), ("MIN_GRAM", 4), ("MIN_CONTEXT", 8), ("THRESHOLD", 6.0), ("MIN_SHARE", share), ("FLUSH", 3000), ("SLICE", 100)):
        monkeypatch.setattr(suffix_tree, name, value)
    rows = texts_with_habits()
    want, kept = brute_scores(rows, depth)
    assert {len(s) for s in kept} >= set(range(1, min(depth, 2) + 1))
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, row long")
    got = suffix_tree.score_held_out(table.repartition(3), depth).collect()
    same_scores(got, want)
    # Text of one's own habits is likelier than by single words.
    assert sum(r[6] for r in want if r[1]) > sum(r[5] for r in want if r[1])


def test_scores_with_crowded_bit_maps(spark, monkeypatch):
    """Bit maps that let everything through change no result."""
    for name, value in (("HEAD_WORDS", 30), ("HEAD_GRAMS", 30), ("MOST_BITS", 9)):
        monkeypatch.setattr(suffix_tree, name, value)
    rows = texts_with_habits(2, 120)
    got = suffix_tree.score_held_out(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    same_scores(got, brute_scores(rows)[0])


def test_scores_awkward_rows(spark):
    docs = documents(spark)
    want, _ = brute_scores([(r.doc_id, r.text) for r in docs.collect()])
    same_scores(suffix_tree.score_held_out(docs).collect(), want)
    assert suffix_tree.score_held_out(no_documents(spark)).collect() == []
    # Nothing to learn from: probability 1.
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    alone = spark.createDataFrame([(held, "a b", "en", "s", 0, *[None] * 10)], SCHEMA)
    assert [tuple(r) for r in suffix_tree.score_held_out(alone).collect()] == [(held, True, 3, 0, 0, 0.0, 0.0)]


def test_scores_tell_texts_that_occur_twice(spark):
    """Words, contexts and transitions seen once or twice count."""
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(2000)}" for _ in range(60)) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, t) for i, t in enumerate(texts[:30])]
    got = suffix_tree.score_held_out(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    learned = {r.doc_id: r.score for r in got if not r.held_out}
    twice = [learned[i] for i in range(30) if i in learned and 1000 + i in learned]
    once = [x for i, x in learned.items() if 30 <= i < 1000]
    assert len(twice) > 10 and len(once) > 200 and min(twice) > max(once)


def test_scores_of_other_texts_than_the_learned(spark):
    """A model's texts need not be among those that are scored."""
    docs = spark.createDataFrame(texts_with_habits(4, 80), "doc_id long, text string")
    alone = suffix_tree.score(docs, suffix_tree.fit(docs.where(~suffix_tree.held_out())), suffix_tree.held_out()).collect()
    same_scores(alone, [tuple(r) for r in suffix_tree.score_held_out(docs).collect()])


def test_root_sums_to_one(spark):
    rows = texts_with_habits(3, 200)
    model = suffix_tree.fit(spark.createDataFrame([(t,) for _, t in rows], "text string"))
    count = np.array([r.c for r in model.counts.collect()], float)
    assert abs((10 ** model.root(count)).sum() + 10 ** model.root(np.zeros(1))[0] - 1) < 1e-9


@needs_data
def test_scores_on_given_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want, _ = brute_scores([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    got = registry.op13_suffix_tree(spark, SF).collect()
    same_scores(got, want)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
