"""Operators on documents: awkward tables, and results against brute force."""

import collections
import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docsync.llm import decontaminate, langid, licenses, minhash, packing, quality, registry, toxicity
from tests.llm.fixtures import LONG, documents, no_documents, words
from tests.oracle import compare, connect

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def bench(spark):
    return spark.createDataFrame(
        [(1, words(5, 40)), (2, "one two"), (3, None), (4, ""), (2, "one two"), (30, "Alpha never seen ZETA omega psi chi phi rho tau sigma")],
        "item_id long, text string",
    )


# Licences


@needs_data
@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_against_sql(spark, name):
    assert compare(spark, SF, registry.QUERIES[name], registry.ORACLE[name], connect(SF)) is None


def test_licences_awkward_rows(spark):
    rows = licenses.scan(documents(spark)).collect()
    assert len(rows) == 13 and all(r.licenses == [] and r.unmatched == 0 for r in rows)
    assert licenses.scan(no_documents(spark)).count() == 0


def test_licence_sequences(spark):
    mit = (
        "// Permission is hereby granted, free of charge, to any person obtaining a copy\n// of this software and associated "
        "documentation files (the \"Software\"), to deal\n// in the Software without restriction, including without limitation the "
        "rights\n// to use, copy, modify, merge, publish, distribute, sublicense, and/or sell\n// copies of the Software, and to permit "
        "persons to whom the Software is\n// furnished to do so, subject to the following conditions:\n//\n// The above copyright notice and this "
        "permission notice shall be included in all\n// copies or substantial portions of the Software.\n"
    )
    rows = spark.createDataFrame(
        [
            (1, mit), (2, mit + mit), (3, "Some prose\nLicensed under the Apache License, Version 2.0.\nReleased under the MIT License."),
            (4, "You may not use this file except in compliance with the License."), (5, "a licence is licensed under thoughts"),
            (6, LONG + "\nLicensed under CC BY-NC 4.0."),
        ],
        "doc_id long, text string",
    )
    got = {r.doc_id: r for r in licenses.scan(rows).collect()}
    assert got[1].licenses == ["MIT"] and got[1].unmatched == 0
    assert got[2].licenses == ["MIT"] and got[2].sentence_ids == ["MITGrant", "MITNotice"] * 2 and got[2].unmatched == 0
    assert got[3].licenses == ["Apache-2.0", "MIT"]
    assert got[4].licenses == [] and got[4].unmatched == 1
    assert got[5].sentence_ids == []
    assert got[6].licenses == ["CC-BY-NC-4.0"]


GNU = (
    "This {what} is free software{mark} you can redistribute it and/or modify\nit under the terms of the GNU {name} as published by\n"
    "the Free Software Foundation{sep} either version {version} of the License, or\n(at your option) any later version.\n\n"
    "This {what} is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\n"
    "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\nGNU {name} for more details.\n"
)
GPL, LGPL, AGPL = "General Public License", "Lesser General Public License", "Affero General Public License"
BSD = (
    "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n"
    "1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n\n"
    "2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n"
    "   and/or other materials provided with the distribution.\n\n{}"
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\"\nAND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE\n"
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE\nDISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE\n"
)
NAMES_3 = (
    "3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n"
    "   this software without specific prior written permission.\n\n"
)
CC = "This work is licensed under a Creative Commons {} 4.0 International License."
NOTICES = [
    ("GPL-2.0-or-later", GNU.format(what="program", mark=";", sep=";", name=GPL, version=2)),
    ("GPL-3.0-or-later", GNU.format(what="program", mark=":", sep=",", name=GPL, version=3)),
    ("LGPL-2.1-or-later", GNU.format(what="library", mark=";", sep=";", name=LGPL, version="2.1")),
    ("AGPL-3.0-or-later", GNU.format(what="program", mark=":", sep=",", name=AGPL, version=3)),
    ("BSD-2-Clause", BSD.format("")), ("BSD-3-Clause", BSD.format(NAMES_3)),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n"
     "    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software\ndistributed under the License is distributed on an \"AS IS\" BASIS,\n"
     "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.\nSee the License for the specific language governing permissions and\nlimitations under the License.\n"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.\n"),
    ("CC-BY-4.0", CC.format("Attribution")), ("CC-BY-SA-4.0", CC.format("Attribution-ShareAlike")), ("CC-BY-NC-4.0", CC.format("Attribution-NonCommercial")),
    ("CC-BY-NC-SA-4.0", CC.format("Attribution-NonCommercial-ShareAlike")), ("CC-BY-ND-4.0", CC.format("Attribution-NoDerivatives")),
    ("CC0-1.0", "This work is licensed under CC0 1.0 Universal."), ("public domain", "This work has been placed in the public\ndomain."),
    ("MIT", "This project is licensed under the terms of the MIT license."), ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."), ("all rights reserved", "Copyright 2020 A. All rights\nreserved."),
]


def test_each_rule_on_its_published_notice(spark):
    assert {n for n, _ in NOTICES} == {n for n, _ in licenses.RULES}
    ids = [n for n, _ in NOTICES if n not in ("public domain", "all rights reserved")]
    wanted = [*NOTICES, *((n, "# " + "\n# ".join(t.splitlines())) for n, t in NOTICES), *((n, f"// SPDX-License-Identifier: {n}\nint x;") for n in ids)]
    table = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(wanted)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(table).collect()}
    assert {i: got[i].licenses for i in got} == {i: [n] for i, (n, _) in enumerate(wanted)}
    assert all(got[i].unmatched == 0 for i in got)


# Quality


def rated(spark, n=300):
    """Three grades by how much of the text is noise."""
    rng = random.Random(3)
    docs, ratings = [], []
    for i in range(n):
        grade = i % 3
        noise = [1.0, 0.5, 0.0][grade]
        docs.append((i, " ".join(w.upper() + "!!" if rng.random() < noise else w for w in words(i, rng.randint(20, 200)).split())))
        ratings.append((i, grade))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(ratings, "doc_id long, quality int")


def test_quality_orders_grades(spark):
    docs, ratings = rated(spark)
    model = quality.fit(docs, ratings.where("doc_id % 2 = 0"))
    assert len(model.thresholds) == 2 and model.thresholds[0] < model.thresholds[1]
    rows = quality.rate(docs, model).join(ratings, "doc_id").where("doc_id % 2 = 1").collect()
    assert np.mean([round(r.expected_grade) == r.quality for r in rows]) > 0.9
    assert all(0 <= r.tail <= 1 and 0 <= r.expected_grade <= 2 for r in rows)


def test_quality_awkward_rows(spark):
    docs, ratings = rated(spark)
    model = quality.fit(docs, ratings)
    rows = quality.rate(documents(spark), model).collect()
    assert len(rows) == 13
    blank = [r for r in rows if r.doc_id in (1, 2, 3)]
    assert all(r.tail is None and r.expected_grade is None and r.rejected for r in blank)
    kept = quality.select(documents(spark), model)
    assert kept.columns == documents(spark).columns and kept.count() == sum(not r.rejected for r in rows)
    assert quality.rate(no_documents(spark), model).count() == 0
    one = quality.fit(docs, ratings.where("quality = 1"))
    assert {r.tail for r in quality.rate(docs, one).collect()} == {1.0}
    none = quality.fit(no_documents(spark), ratings.limit(0))
    assert quality.rate(docs, none).count() == 300


def test_quality_repeated_and_null_ratings(spark):
    docs, ratings = rated(spark, 60)
    more = ratings.union(ratings).union(spark.createDataFrame([(None, 1), (3, None)], ratings.schema))
    one, two = quality.fit(docs, ratings), quality.fit(docs, more)
    assert np.allclose(one.weights, two.weights)


# Language


def test_language_centroids(spark):
    rng = random.Random(5)
    make = lambda parts, n: " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))
    kinds = {"aa": ["ka", "lo", "mi"], "bb": ["sch", "ung", "er"], "cc": ["éa", "oui", "que"]}
    rows = [(i, make(kinds[l], 60), l) for i, l in enumerate(sorted(kinds) * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(docs).join(docs, "doc_id").collect()
    assert all(r.lang_pred == r.lang and 0 <= r.score <= 1 and not r.rejected for r in got)
    assert {r.held_out for r in got} == {True, False}
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    model = langid.fit(docs)
    strange = spark.createDataFrame([(1, "中文字 日本 " * 100)], "doc_id long, text string")
    assert langid.predict(strange, model).first().rejected


def test_language_fit_collects_counts_that_are_not_zero(spark):
    """A short text costs the driver some bytes for each of its n-grams, not a whole row; rows come back whole."""
    import pyarrow as pa

    texts = ["ab", "Ab ba", "née " * 300]
    out = list(langid._counts([pa.RecordBatch.from_arrays([pa.array(["xx"] * 3), pa.array(texts)], names=["lang", "text"])]))[0]
    assert sum(out.column(i).nbytes for i in range(1, out.num_columns)) < 1000
    want = sorted((langid.count_ngrams(t, langid.letter_table()).astype(np.uint32) for t in texts), key=lambda r: r.tobytes())
    assert np.array_equal(langid._dense(out.column(1).to_pylist(), out.column(2).to_pylist()), np.array(want))


def test_language_awkward_rows(spark):
    model = langid.fit(documents(spark))
    rows = langid.predict(documents(spark), model).collect()
    assert len(rows) == 13
    for r in rows:
        if r.doc_id in (1, 2, 3, 10):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
        else:
            assert r.lang_pred in ("en", "de", "fr")
    assert langid.select(documents(spark), model).columns == documents(spark).columns
    assert langid.predict(no_documents(spark), langid.fit(no_documents(spark))).count() == 0
    assert {r.lang_pred for r in langid.predict(documents(spark), langid.fit(no_documents(spark))).collect()} == {"und"}


def test_emoji_are_not_letters(spark):
    model = langid.fit(documents(spark))
    texts = ["\U0001f600\U0001f680", "12 \U0001f600 3", "\U0001f600" * 300_000, "\U00020000\U00020001 \U0001d400"]
    rows = {r.doc_id: r for r in langid.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    assert all((rows[i].lang_pred, rows[i].score, rows[i].rejected) == ("und", 0.0, True) for i in range(3))
    assert rows[3].lang_pred != "und"
    letters = langid.letter_table()
    assert (langid.count_ngrams("abc \U0001f600 def", letters) == langid.count_ngrams("abc ! def", letters)).all()


def test_long_text_counts_each_ngram_once():
    letters = langid.letter_table()
    text = "abc def " * 50_000
    whole, n = langid.count_ngrams(text, letters), langid.PIECE
    assert len(text) > n
    # Bigrams over all adjacent pairs, trigrams over all adjacent triples, single letters without blanks.
    assert whole.sum() == text.replace(" ", "").__len__() + (len(text) + 1) + len(text)


# Packing


def check_packing(rows, texts):
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for members in by_sequence.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    return by_doc, by_sequence


@needs_data
def test_packing_against_the_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = packing.pack_documents(docs).collect()
    by_doc, by_sequence = check_packing(rows, docs)
    total = 0
    for d in docs.collect():
        ids = np.array([*tokenizer.encode(d.text or "", add_special_tokens=False).ids, 2], "<u4")
        total += len(ids)
        pieces = sorted(by_doc[d.doc_id], key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces)))
        assert all(r.length == 1024 for r in pieces[1:])
        at = 0
        for r in pieces:
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert len(by_sequence) <= -(-total // 1024) + 2


def test_packing_awkward_rows(spark):
    rows = packing.pack_documents(documents(spark)).collect()
    by_doc, _ = check_packing(rows, None)
    assert len(by_doc[7]) == 2 and {r.length for r in by_doc[1]} == {1} and len(by_doc[None]) == 1
    assert sum(r.length for r in by_doc[4]) == max(r.start + r.length for r in by_doc[4])
    assert packing.pack_documents(no_documents(spark)).count() == 0


def test_packing_many_shards_and_json_vocabulary(spark):
    import public_tokenizers

    docs = spark.createDataFrame([(i, words(i, 5 + i % 300)) for i in range(600)], "doc_id long, text string")
    one = packing.token_pieces(docs).orderBy("doc_id", "piece").collect()
    two = packing.token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json")).orderBy("doc_id", "piece").collect()
    assert one == two
    rows = packing.pack(packing.token_pieces(docs), shard_size=100).collect()
    _, by_sequence = check_packing(rows, docs)
    total = sum(r.length for r in rows)
    assert len(rows) == 600 and len(by_sequence) <= -(-total // 1024) + 7


@pytest.mark.parametrize(
    "text",
    ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|", "x<|endoftext|><|endoftext|>\n", "a" + " " * 1_200_000 + "b", "\n" * 1_200_000, "a" + " \n" * 600_000],
)
def test_packing_added_tokens_and_long_blanks(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    wanted = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert packing.load_encoder(packing.ranks_path())(text) == wanted
    assert packing.load_encoder(path)(text) == wanted


def test_packing_spreads_repeated_keys(spark, monkeypatch):
    monkeypatch.setattr(packing, "REPEATS", 64)
    repeats = [(None, 0, 0, 1 + i % 900, i) for i in range(600)] + [(7, 0, 0, 10, 1)] * 600 + [(8, 0, 0, 1024, 1)] * 500
    table = spark.createDataFrame(repeats, "doc_id long, piece int, start long, length long, ids_crc32 long")
    rows = packing.pack(table, shard_size=100).collect()
    check_packing(rows, None)
    assert collections.Counter(tuple(r)[:5] for r in rows) == collections.Counter(repeats)
    for key in (None, 7):
        shards = collections.Counter(r.sequence_id // packing.SHARD_STEP for r in rows if r.doc_id == key)
        assert len(shards) == 12 and max(shards.values()) < 100
    assert len({r.sequence_id for r in rows if r.length == 1024}) == 500


def test_crossover_keeps_every_item():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 1024, 500)
    one, two = (packing.first_solution(lengths, 1024, rng, x) for x in (0.0, 0.3))
    for _ in range(20):
        child = packing.crossover(one, two, lengths, 1024, rng)
        assert len(child) == 500 and np.bincount(child, lengths).max() <= 1024 and (np.bincount(child) > 0).all()


# Near-duplicates


def word_sets(rows):
    sets = []
    for doc, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets.append((doc, frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()))
    return sets


def brute_components(sets, percent):
    parent = {d: d for d, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            inter = len(s & t)
            if inter and 100 * inter >= percent * (len(s) + len(t) - inter):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: root(d) for d, _ in sets}


def near_copies(n, base_words=120, seed=9):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, texts = [], []
    for i in range(n):
        if texts and rng.random() < 0.7:
            own = list(rng.choice(texts))
            for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
        else:
            own = [rng.choice(vocabulary) for _ in range(base_words)]
        texts.append(own)
        rows.append((i + 1, " ".join(own)))
    return rows


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_against_brute_force(spark, percent):
    rows = near_copies(250)
    # Cells smaller than the groups, so that pairs of cells are compared.
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent, cell=16).collect()
    sets = word_sets(rows)
    wanted = brute_components(sets, percent)
    assert {r.doc_id: r.component_id for r in got} == wanted
    assert {r.doc_id: r.n_shingles for r in got} == {d: len(s) for d, s in sets}
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


@needs_data
def test_near_duplicates_on_given_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = registry.QUERIES["op6_minhash"](spark, SF).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_components(word_sets(rows), 85)


def test_near_duplicates_awkward_rows(spark):
    got = minhash.near_duplicates(documents(spark)).collect()
    assert len(got) == 13
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert [(r.n_shingles, r.component_id) for i in (1, 2, 3) for r in by[i]] == [(0, 1), (0, 2), (0, 3)]
    assert by[6][0].component_id == 5 and not by[6][0].kept and by[5][0].kept
    assert len(by[7]) == 2 and by[9][0].n_shingles == 1 and by[None][0].component_id is None and by[None][0].kept
    kept = minhash.drop_near_duplicates(documents(spark))
    assert kept.columns == documents(spark).columns
    assert sorted(str(r.doc_id) for r in kept.select("doc_id").collect()) == sorted(map(str, [1, 2, 3, 4, 5, 7, None, 9, 10, 11, 12]))
    assert minhash.near_duplicates(no_documents(spark)).count() == 0
    assert minhash.drop_near_duplicates(no_documents(spark)).count() == 0


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 2**63, 500).astype(np.uint64)
    b = np.concatenate((a[:400], rng.integers(0, 2**63, 100).astype(np.uint64)))
    s = minhash.superminhash(np.concatenate((a, b)), np.array([0, 500, 1000]), 120)
    assert abs((s[0] == s[1]).mean() - 400 / 600) < 0.15
    # Each place gets its least value whatever the order of the elements.
    t = minhash.superminhash(a[::-1].copy(), np.array([0, 500]), 120)
    assert (t[0] == s[0]).all()
    # A set smaller than the signature fills all places.
    assert (minhash.superminhash(a[:1], np.array([0, 1]), 120) < 120 << 24).all()
    assert (minhash.bands_for(85), minhash.bands_for(80), minhash.bands_for(100)) == (24, 35, 1)
    with pytest.raises(ValueError):
        minhash.bands_for(50)


# Decontamination


def brute_leaks(docs, items):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: pattern.findall((t or "").translate(LOWER))
    windows = collections.defaultdict(set)
    for item, text in items:
        w = split(text)
        n = min(len(w), 10)
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i : i + n])].add(item)
    lengths = {len(w) for w in windows}
    for doc, text in docs:
        w, hit, found = split(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                items = windows.get(tuple(w[i : i + n]))
                if items:
                    hit |= set(range(i, i + n))
                    found |= items
        ids = ",".join(sorted(map(str, found)))
        yield doc, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)


def test_leaks_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in documents(spark).collect()]
    docs += [(50, "Alpha; never SEEN zeta. omega psi chi phi rho tau sigma"), (51, "never seen zeta omega psi"), (52, "One  TWO three")]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    items = [tuple(r) for r in bench(spark).collect()]
    got = [tuple(r) for r in decontaminate.leak_report(table, bench(spark)).collect()]
    assert sorted(got, key=repr) == sorted(brute_leaks(docs, items), key=repr)


def test_decontaminate_removes_documents_or_spans(spark):
    docs = documents(spark).union(documents(spark).where("doc_id = 9").withColumn("doc_id", F.lit(50).cast("long")).withColumn("text", F.lit("Well, one two: three. One two!")))
    clean = decontaminate.decontaminate(docs, bench(spark))
    assert clean.columns == docs.columns
    assert sorted(str(r.doc_id) for r in clean.select("doc_id").collect()) == sorted(map(str, [1, 2, 3, 4, 7, 7, 10, 11, 12]))
    cut = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, bench(spark), remove="spans").collect()}
    assert cut[9] == "three" and cut[50] == "Well, three. " and cut[5] == "" and cut[4] == LONG and cut[1] is None
    with pytest.raises(ValueError):
        decontaminate.decontaminate(docs, bench(spark), remove="all")


def test_leaks_of_empty_tables(spark):
    assert decontaminate.leak_report(no_documents(spark), bench(spark)).count() == 0
    rows = decontaminate.leak_report(documents(spark), bench(spark).limit(0)).collect()
    assert len(rows) == 13 and not any(r.contaminated for r in rows)


def test_decontamination_runs_no_python(spark):
    plan = decontaminate.leak_report(documents(spark), bench(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# Toxicity


def toxic_table(spark, n=600):
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        own = words(i, rng.randint(10, 80)).split()
        if toxic:
            for _ in range(rng.randint(1, 4)):
                own.insert(rng.randrange(len(own)), rng.choice(["vermin", "scum", "grubling", "grubby", "grubbed"]))
        docs.append((i, " ".join(own)))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_held_out(spark):
    docs, labels = toxic_table(spark)
    rows = toxicity.assess(docs, labels).join(labels, "doc_id").collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == r.toxic for r in held]) > 0.95


def test_label_model_finds_accurate_and_correlated_voters():
    rng = np.random.default_rng(2)
    truth = rng.random(4000) < 0.2
    fire = lambda on, off: np.where(truth, rng.random(4000) < on, rng.random(4000) < off).astype(float)
    one = fire(0.6, 0.02)
    copy = np.where(rng.random(4000) < 0.95, one, 1 - one)
    votes = np.stack([one, copy, fire(0.5, 0.02), fire(0.5, 0.01), fire(0.05, 0.05)], axis=1)
    votes = np.concatenate((votes, votes[:, :4].sum(axis=1, keepdims=True) == 0), axis=1)
    model = toxicity.fit_label_model(votes, 0.2, np.array([True, True, True, True, False, False]))
    assert model.on_toxic[2] > 0.3 and model.on_clean[2] < 0.1
    assert model.correlation[0, 1] > 2 * model.correlation[2, 3]
    assert ((model.posterior(votes) > 0.5) == truth).mean() > 0.85


def test_toxicity_awkward_rows(spark):
    docs, labels = toxic_table(spark, 120)
    model = toxicity.fit(docs, labels)
    rows = {str(r.doc_id): r for r in toxicity.score(documents(spark), model).collect()}
    assert toxicity.score(documents(spark), model).count() == 13
    assert rows["1"].score == rows["2"].score == rows["3"].score < 0.5
    assert toxicity.score(no_documents(spark), model).count() == 0
    for some in (labels.where("toxic = 0"), labels.limit(0)):
        assert {r.predicted for r in toxicity.score(docs, toxicity.fit(docs, some)).collect()} == {0}
