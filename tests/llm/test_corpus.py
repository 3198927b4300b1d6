"""Mixing, licences, decontamination, the pipeline, and the SQL of this subpackage."""

import math
import random
import textwrap
import time
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from lectern.llm import registry
from lectern.llm.decontaminate import common_subsequence, decontaminate, find_contamination
from lectern.llm.licenses import CUES, SENTENCES, scan_licenses
from lectern.llm.mixing import mix_sources, pfair, whole_weights
from lectern.llm.words import FOLDED, Words
from pyspark.sql import functions as F

from ..oracle import both
from .fixtures import awkward, empty, sentence

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, name):
    mine, theirs = both(spark, SF, registry.queries()[name], registry.oracle_sql()[name])
    assert mine == theirs


def plain_schedule(weights, blocks):
    """Slot by slot over all sources that have a block left, in fractions: of the released blocks the one due first, then by name."""
    total, done, out, slot = sum(map(Fraction, weights.values())), dict.fromkeys(weights, 0), [], 0
    while any(done[s] < blocks[s] for s in weights):
        window = {s: (math.floor(done[s] * total / Fraction(w)), math.ceil((done[s] + 1) * total / Fraction(w))) for s, w in weights.items() if done[s] < blocks[s]}
        released = [(d, s) for s, (r, d) in window.items() if r <= slot]
        if released:
            _, s = min(released)
            out.append((s, done[s], slot, *window[s]))
            done[s] += 1
        slot += 1
    return out


@pytest.mark.parametrize("weights", [{"a": 1, "b": 1}, {"a": 5, "b": 3, "c": 2}, {"a": 1, "b": 0.01}, {"x": 0.3, "y": 1 / 3, "z": 2.7}, {chr(97 + i): i + 1 for i in range(12)}])
def test_schedule_against_plain_python(weights):
    total = sum(map(Fraction, weights.values()))
    blocks = {s: 1 + int(400 * Fraction(w) / total) for s, w in weights.items()}
    for have in (blocks, {s: n if i else n // 3 for i, (s, n) in enumerate(blocks.items())}):
        assert list(pfair(whole_weights(weights), have)) == plain_schedule(weights, have)
    plan = list(pfair(whole_weights(weights), blocks))
    done = Counter()
    for s, _, slot, release, deadline in plan:
        assert release <= slot < deadline
        done[s] += 1
    assert done == blocks


def test_mix_is_whole_and_in_order(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 7}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string").withColumn("block", F.lit(1)).withColumn("rank", F.lit("x"))
    got = mix_sources(docs, weights={"hot": 3, "s0": 1}, block=8, slots_at_once=100, rows_per_bucket=200).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(3000))
    assert len({r["position"] for r in got}) == 3000
    per_block = Counter((r["source"], r["block"]) for r in got)
    last = {s: max(b for t, b in per_block if t == s) for s in {r["source"] for r in got}}
    assert all(n == 8 for (s, b), n in per_block.items() if b < last[s])
    whole = {s: {"hot": 3, "s0": 1}.get(s, 1) for s in last}
    for r in got:
        j, w, total = r["block"], whole[r["source"]], sum(whole.values())
        assert r["release"] == j * total // w <= r["slot"] < r["deadline"] == -(-(j + 1) * total // w)


@pytest.mark.parametrize("weights", [{"big": 100.0} | {f"s{i:03}": 1.0 for i in range(200)}, {"hot": 500.0} | {f"s{i:03}": 1.0 for i in range(499)}, {"hot": 3.1, "a": 1 / 3, "b": 0.7}])
def test_lag_against_the_weights_given(spark, weights):
    """Every slot of two periods and more: no source is ever a block or more off its exact share."""
    rows = [(s, n) for s, w in weights.items() for n in range(int(2500 * w / sum(weights.values())) + 1)]
    docs = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(rows)], "doc_id long, source string")
    got = sorted((r["slot"], r["source"]) for r in mix_sources(docs, weights=weights, block=1).collect())
    assert len({t for t, _ in got}) == len(got) == len(rows)
    done, total, at = Counter(), sum(weights.values()), 0
    for slot in range(2400):
        while at < len(got) and got[at][0] <= slot:
            done[got[at][1]] += 1
            at += 1
        assert all(abs(done[s] - (slot + 1) * w / total) < 1 + 1e-9 for s, w in weights.items())


def test_mix_keeps_rows_of_a_source_far_below_its_weight(spark):
    docs = spark.createDataFrame([(i, "rare" if i < 50 else "none" if i < 60 else "most") for i in range(90)], "doc_id long, source string")
    got = mix_sources(docs, weights={"rare": 1e-9, "most": 1.0, "none": 0.0}, block=1).collect()
    assert len({r["position"] for r in got}) == 90 and all(r["release"] <= r["slot"] < r["deadline"] for r in got)


def test_mix_awkward(spark):
    assert mix_sources(awkward(spark)).count() == awkward(spark).count()
    assert {r["source"] for r in mix_sources(awkward(spark)).collect()} == {"", "s1", "s2"}
    assert mix_sources(empty(spark)).count() == 0
    twice = spark.createDataFrame([(1, "a"), (1, "a")], "doc_id long, source string")
    assert sorted(r["position"] for r in mix_sources(twice).collect()) == [0, 1]


def test_many_notices_in_one_text(spark):
    """A file of a thousand two-clause notices, none of which completes the rule of three clauses."""
    by_id = {v: k for k, v in SENTENCES.items()}
    notice = ". ".join(by_id[i] for i in ("bsd-grant", "bsd-source", "bsd-binary")) + ".\n\n"
    docs = spark.createDataFrame([(1, notice * 1000), (2, notice * 999 + by_id["bsd-names"] + ".")], "doc_id long, text string")
    scan_licenses(docs.where("doc_id = 0")).collect()
    began = time.time()
    got = {r["doc_id"]: (r["licenses"], r["n_sentences"]) for r in scan_licenses(docs).collect()}
    assert got == {1: ("BSD-2-Clause", 3000), 2: ("BSD-3-Clause", 2998)} and time.time() - began < 20


def test_licence_rules(spark):
    by_id = {v: k for k, v in SENTENCES.items()}
    mit = [by_id[k] for k in ("mit-grant", "mit-condition", "mit-warranty", "mit-liability")]
    bsd = [by_id[k] for k in ("bsd-grant", "bsd-source", "bsd-binary")]
    cases = {
        1: (". ".join(mit) + ".", "MIT"), 2: (". ".join(reversed(mit)), ""), 3: ("\n".join([mit[0], "Some other line.", *mit[1:]]), "MIT"), 4: (";\n".join(bsd), "BSD-2-Clause"),
        5: (";\n".join([*bsd, by_id["bsd-names"]]), "BSD-3-Clause"), 6: ("Text. Released under the MIT License.", "MIT"), 7: ("a licence to drive", ""), 8: (None, ""), 9: ("", ""),
        10: ("LICENSED under the Apache   License, Version 2.0.\nAll rights reserved", "Apache-2.0,Proprietary"),
    }
    docs = spark.createDataFrame([(k, t, "x") for k, (t, _) in cases.items()], "doc_id long, text string, ids string")
    assert {r["doc_id"]: r["licenses"] for r in scan_licenses(docs).collect()} == {k: want for k, (_, want) in cases.items()}
    assert scan_licenses(awkward(spark)).count() == awkward(spark).count()
    assert scan_licenses(empty(spark)).count() == 0


MIT = """Copyright (c) 2020 Someone
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("mark", ["", "# ", " * ", "// ", ";; "])
def test_wrapped_licences(spark, mark, end):
    """The texts as they ship: wrapped at several widths, behind comment marks, amid other lines."""
    rows, want = [], {}
    for name, text in {"MIT": MIT, "Apache-2.0": APACHE, "BSD-3-Clause": BSD}.items():
        for width in (40, 72, 79):
            lines = [line for paragraph in text.split("\n") for line in textwrap.wrap(paragraph, width) or [""]]
            want[len(rows)] = name
            rows.append((len(rows), end.join(["import os", "", *(mark + line for line in lines), "", "x = 1"])))
    rows.append((len(rows), "Licensed under the\n\nMIT License. This is licensed. Under the\nMIT License."))
    want[len(rows) - 1] = ""
    assert {r["doc_id"]: r["licenses"] for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want


NOTICES = {
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details.""",
    "GPL-2.0": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
    "LGPL-2.1": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
    "AGPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:""",
}


def test_notices_and_identifier_lines(spark):
    rows, want = [], {}
    for name, text in NOTICES.items():
        for width, mark in ((60, ""), (79, "# "), (72, " * ")):
            lines = [line for paragraph in text.split("\n") for line in textwrap.wrap(paragraph, width) or [""]]
            want[len(rows)] = name
            rows.append((len(rows), "\n".join(["import os", "", *(mark + line for line in lines), "", "x = 1"])))
    lines = {"MIT": "MIT", "Apache-2.0": "Apache-2.0", "GPL-3.0-or-later": "GPL-3.0", "LGPL-2.1-only": "LGPL-2.1", "BSD-3-Clause": "BSD-3-Clause", "NoSuch-1.0": "", "MIT-0": ""}
    for spdx, name in lines.items():
        for line in (f"// SPDX-License-Identifier: {spdx}\nint x;", f"/* SPDX-License-Identifier: {spdx} */"):
            want[len(rows)] = name
            rows.append((len(rows), line))
    assert {r["doc_id"]: r["licenses"] for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want


def test_long_items_with_words_put_in_between(spark):
    """An item of hundreds of words, with one word put in after every third, stands in a longer stretch than its own."""
    rng = np.random.default_rng(3)
    item = [f"w{k}" for k in rng.integers(0, 500, 400)]
    inside = [x for k, w in enumerate(item) for x in ((w, f"r{k}") if k % 3 == 2 else (w,))]
    around = [f"q{k}" for k in rng.integers(0, 100_000, 300)]
    docs = spark.createDataFrame([(1, " ".join(around + inside + around)), (2, " ".join(around))], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in find_contamination(docs, items).collect()] == [(1, 7)]


def test_blocks_by_words_share_scans(spark):
    docs, items, _ = leaky(spark)
    whole = sorted((r["doc_id"], r["item_id"]) for r in find_contamination(docs, items).collect())
    for options in ({"words_at_once": 100}, {"items_at_once": 3, "blocks_a_scan": 2}):
        assert sorted((r["doc_id"], r["item_id"]) for r in find_contamination(docs, items, **options).collect()) == whole


def test_cues_are_implied_by_the_sentences(spark):
    assert not [c for c in CUES if " " in c] and not [k for k in SENTENCES if not any(c in w for w in k.split() for c in CUES)]
    texts = ["All rights  reserved.", "All rights\u00a0reserved", "# all rights\n# reserved\n"]
    got = scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [r["licenses"] for r in got] == ["Proprietary"] * 3


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_common_subsequence():
    rng = np.random.default_rng(4)
    for _ in range(50):
        a, b = rng.integers(0, 6, rng.integers(1, 80)), rng.integers(0, 6, rng.integers(0, 120))
        assert common_subsequence(a.astype(np.uint64), b.astype(np.uint64)) == brute_lcs(a, b)


def leaky(spark):
    rng = random.Random(8)
    items = [(i, sentence(rng, rng.randrange(12, 60))) for i in range(30)]
    rows, truth = [], set()
    for d in range(400):
        text = sentence(rng, rng.randrange(5, 300)).split()
        if d % 4 == 0:
            i = rng.randrange(30)
            words = items[i][1].split()
            if d % 8 == 0:  # a paraphrase: one word in eight is another
                words = [w if k % 8 != 3 else "other" for k, w in enumerate(words)]
            at = rng.randrange(len(text) + 1)
            text[at:at] = words
            truth.add((d, i))
        rows.append((d, " ".join(text).capitalize()))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), truth


def test_leaks_are_found_and_clean_documents_kept(spark):
    docs, items, truth = leaky(spark)
    got = {(r["doc_id"], r["item_id"]) for r in find_contamination(docs, items).collect()}
    assert len(got & truth) >= 0.95 * len(truth)
    assert not got - truth
    kept = {r["doc_id"] for r in decontaminate(docs, items).collect()}
    assert kept == set(range(400)) - {d for d, _ in got}


def test_items_in_blocks(spark):
    docs, items, _ = leaky(spark)
    whole, parts = (sorted((r["doc_id"], r["item_id"]) for r in find_contamination(docs, items, items_at_once=n).collect()) for n in (512, 7))
    assert whole == parts


def zipf_text(rng, n):
    return " ".join(f"w{k}" for k in np.minimum(rng.zipf(1.2, n), 200_000))


@pytest.mark.parametrize("n", [300, 512, 1500])
def test_every_item_of_a_large_benchmark_is_found(spark, n):
    rng = np.random.default_rng(n)
    items = [(i, zipf_text(rng, int(rng.integers(15, 60)))) for i in range(n)]
    docs = [(i, f"{zipf_text(rng, int(rng.integers(0, 90)))} {t} {zipf_text(rng, int(rng.integers(0, 90)))}") for i, t in items]
    got = find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {r["item_id"] for r in got if r["doc_id"] == r["item_id"]}
    assert len(found) == n, f"{n - len(found)} items missed"


def test_short_and_common_items_are_found_in_longer_texts(spark):
    """Whole short items, and long ones of frequent words with a fifth changed, in passages of rarer words."""
    rng = np.random.default_rng(9)
    items = [(i, zipf_text(rng, 1 + i % 7)) for i in range(280)]
    items += [(i, " ".join(f"w{k}" for k in rng.integers(1, 40, 8 + i % 20))) for i in range(280, 340)]
    docs = []
    for i, text in items:
        words = text.split()
        if i >= 280:  # places that leave the answer, the last words, as it is
            words = [w if k % 5 != 2 or k >= len(words) - 7 else "other" for k, w in enumerate(words)]
        around = [[f"r{k}" for k in rng.integers(0, 1_000_000, rng.integers(40, 200))] for _ in range(2)]
        docs.append((i, " ".join(around[0] + words + around[1])))
    docs += [(1000 + d, zipf_text(rng, 400)) for d in range(300)]
    got = {(r["doc_id"], r["item_id"]) for r in find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    short = {(d, i) for d, text in docs for i, item in items[:280] if f" {item} " in f" {text} "}
    assert short == {(d, i) for d, i in got if i < 280}
    assert {(i, i) for i in range(280, 340)} <= got


def test_search_against_brute_force(spark):
    """All pairs of a real table in which most five-word runs of an item stand in the document."""
    docs, items = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    runs = lambda t: {tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(len(w) - 4)}
    where = defaultdict(set)
    wanted = {r["item_id"]: runs(r["text"]) for r in items.collect()}
    for i, s in wanted.items():
        for g in s:
            where[g].add(i)
    truth = set()
    for r in docs.collect():
        hits = Counter(i for g in runs(r["text"]) for i in where.get(g, ()))
        truth |= {(r["doc_id"], i) for i, n in hits.items() if n >= 0.6 * len(wanted[i])}
    got = {(r["doc_id"], r["item_id"]) for r in find_contamination(docs, items).collect()}
    assert truth and len(got & truth) >= 0.95 * len(truth)
    assert not got - truth


def test_contamination_awkward(spark):
    items = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "one two three", 1), (None, "x", 1)], "item_id long, text string, doc_id long")
    got = {(r["doc_id"], r["item_id"]) for r in find_contamination(awkward(spark), items).collect()}
    assert got == {(8, 3), (9, 3)}
    assert find_contamination(empty(spark), items).count() == 0
    assert find_contamination(awkward(spark), items.limit(0)).count() == 0


def test_pipeline_stages_take_effect(spark):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.01"
    docs, sizes = spark.read.parquet(f"{sf}/documents.parquet"), []
    columns = docs.columns
    for name, stage in p.STAGES[:-1]:
        before = {r["doc_id"] for r in docs.select("doc_id").collect()}
        docs = stage(spark, docs, sf).cache()
        after = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert docs.columns == columns and after < before, name
        sizes.append(len(after))
    assert p.STAGES[-1][1](spark, docs, sf).count() == sizes[-1]
    bodies = [r["text"] for r in docs.select("text").collect()]
    assert len({"".join(b.split()) for b in bodies}) == len(bodies)
    assert p.run(spark, sf).count() == sizes[-1]


def test_latent_space_is_fitted_on_all_documents(spark):
    """The products of columns are those of every block of every text, however the rows lie in tasks."""
    from lectern.llm import decontaminate as dc

    rng = random.Random(3)
    texts = [" ".join(rng.choice(["ab", "cd", "ef", "gh", "zz"]) for _ in range(rng.randrange(120))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    items, _ = dc._items([{"item_id": 1, "text": "ab cd ef"}, {"item_id": 2, "text": "gh ab"}], dc.inverse_frequencies(docs))
    got = {(r["part"], r["i"], r["j"]): r["value"] for r in dc.column_products(docs, [items]).collect()}
    want = np.zeros((4, 4))
    for text in texts:
        words = text.split()
        for at in range(0, len(words), dc.BLOCK):
            hashes = Words(pa.array([" ".join(words[at : at + dc.BLOCK])]), fold=FOLDED).hash
            x, col = np.zeros(5), items.columns(hashes)
            np.add.at(x, col, items.weights[(hashes & dc._MASK).astype(np.int64)])
            want += np.outer(x[:4], x[:4])
    assert {(0, i, j) for i in range(4) for j in range(4)} == set(got)
    assert all(got[0, i, j] == pytest.approx(want[i, j]) for i in range(4) for j in range(4))


def test_pairs_of_many_columns_add_up_like_those_of_few():
    from lectern.llm import decontaminate as dc

    few, many, rng = dc._Pairs(50), dc._Pairs(50), np.random.default_rng(2)
    many.square, many.value = False, np.zeros(0)
    for _ in range(5):
        key, value = rng.integers(0, 2500, 400), rng.random(400)
        few.add(key, value), many.add(key, value)
    (a, x), (b, y) = few.taken(), many.taken()
    assert (a == b).all() and np.allclose(x, y)


def test_products_of_columns_travel_packed_and_add_up_exactly(spark):
    """A task sends hundreds of pairs in a row, and the sums are the same to the last bit however the rows lie in tasks."""
    from types import SimpleNamespace

    from lectern.llm import decontaminate as dc

    rng = np.random.default_rng(6)
    texts = [zipf_text(rng, int(n)) for n in rng.integers(0, 400, 200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items, _ = dc._items([{"item_id": k, "text": zipf_text(rng, 40)} for k in range(12)], dc.inverse_frequencies(docs))
    one, many = ({(r["i"], r["j"]): r["value"] for r in dc.column_products(docs.repartition(n), [items]).collect()} for n in (1, 7))
    assert one == many
    sent = list(dc._column_counts(SimpleNamespace(value=[items]), False)(iter([pa.record_batch({"text": texts})])))
    columns = len(items.column_hash)
    assert sum(b.num_rows for b in sent) <= len(one) / 2 / dc.PACKED + columns / dc.ROWS + 1

    counted = np.zeros((columns, columns))
    for text in texts:
        words = text.split()
        for at in range(0, len(words), dc.BLOCK):
            col = items.columns(Words(pa.array([" ".join(words[at : at + dc.BLOCK])]), fold=FOLDED).hash)
            x = np.bincount(col[col >= 0], minlength=columns)
            counted += np.outer(x, x)
    got = np.zeros((columns, columns))
    for b in sent:
        for first, place, times in zip(*(b.column(c).to_pylist() for c in ("first", "place", "times")), strict=True):
            at = np.frombuffer(place, "<u4")
            got[first + at // columns, at % columns] += np.frombuffer(times, f"<u{len(times) // len(at)}")
    assert (got == np.triu(counted)).all()
    assert set(one) == set(zip(*(x.tolist() for x in np.nonzero(counted)), strict=True))


def test_rows_of_few_columns_multiply_like_whole_ones(monkeypatch):
    """Partial products add up to the whole product when a task holds more rows and pairs than it may at once."""
    from types import SimpleNamespace

    from lectern.llm import decontaminate as dc

    rng = np.random.default_rng(1)
    table, matrix = rng.random((60, 60)) * (rng.random((60, 60)) < 0.4), rng.random((60, 9))
    i, j = np.nonzero(table)
    order = rng.permutation(len(i))
    batches = [pa.record_batch({"i": i[k].astype(np.int32), "j": j[k].astype(np.int32), "value": table[i[k], j[k]]}) for k in np.array_split(order, 13)]
    monkeypatch.setattr(dc, "PAIRS", 200)
    product = np.zeros_like(matrix)
    for b in dc._times(SimpleNamespace(value=matrix))(iter(batches)):
        for name, row in zip(b.column("i").to_pylist(), b.column("product").to_pylist(), strict=True):
            product[name] += np.frombuffer(row)
    assert np.allclose(product, table @ matrix)
