"""Operators on small cases with known answers."""

import random

import numpy as np
import pytest
from lectern.functions import english
from lectern.functions import identifiers as ids
from lectern.functions import json as js
from lectern.functions import text as tx
from lectern.functions.vector import cosine, vector_literal
from lectern.operators import chunking, dml, library, matching, reading, search, state, training
from lectern.sources.tables import scoped, write_documents
from lectern.streaming import streams
from pyspark.sql import functions as F


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("page", "boosted"), [(5, 0.88), (6, 0.872), (4, 0.872), (15, 0.8), (40, 0.8)])
def test_proximity_boost(spark, page, boosted):
    rows = spark.createDataFrame([(1, page, 0.8)], "id long, page int, score double")
    assert search.proximity_boost(rows, "page", 5, "score", 10).first()["score"] == pytest.approx(boosted)


def test_boost_makes_a_negative_score_lower(spark):
    rows = spark.createDataFrame([(1, 5, -0.5)], "id long, page int, score double")
    assert search.proximity_boost(rows, "page", 5, "score", 10).first()["score"] == pytest.approx(-0.55)


def test_cosine_of_zero_and_null(spark):
    assert one(spark, cosine(vector_literal([0, 0]), vector_literal([1, 0]))) is None
    assert one(spark, cosine(F.lit(None).cast("array<double>"), vector_literal([1.0]))) is None
    assert one(spark, cosine(vector_literal([1, 1]), vector_literal([2, 2]))) == pytest.approx(1.0)


def test_keyword_side_needs_every_term(spark):
    rows = spark.createDataFrame([(1, "red and then, far off, a fox"), (2, "red red fox dog"), (3, "fox"), (4, "fox red")], "id long, content string")
    assert [r["id"] for r in search.keyword_top_k(search.keyword_matches(rows, ["red", "fox"]), 5).collect()] == [2, 4, 1]
    assert search.keyword_matches(rows, []).count() == 0


def test_cap_and_best(spark):
    rows = spark.createDataFrame([(i, i % 2, 1.0 - i / 100) for i in range(20)], "id long, pdf long, score double")
    assert search.cap_per_document(rows, "pdf", "score", 6).count() == 12
    assert [r["id"] for r in search.best_per_document(rows, "pdf", "score", 5).collect()] == [0, 1]


def test_context_budget_cuts_the_last(spark):
    rows = spark.createDataFrame([("a", i, "x" * 400, 1, 0, None) for i in range(5)], "g string, k int, content string, page int, end int, section string")
    kept = search.assemble_context(rows, "g", "k", "content", "page", "end", "section", budget=260).orderBy("k").collect()
    assert [len(r["piece"]) for r in kept] == [409, 409, (260 - 204) * 4]
    assert len(search.assemble_context(rows, "g", "k", "content", "page", "end", "section", budget=250).collect()) == 2


def test_page_sets(spark):
    overlap = search.pages_overlap(F.lit(2), F.lit(0), [2])
    assert one(spark, overlap) is True
    assert one(spark, search.pages_overlap(F.lit(2), F.lit(4), [5])) is False
    assert one(spark, search.pages_overlap(F.lit(2), F.lit(4), [])) is True


def test_scoped_skips_absent_filters(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, kind string")
    assert scoped(rows, kind=None, id=[]).count() == 2
    assert scoped(rows, kind=["a"]).count() == 1


def test_sort_whitelist(spark):
    rows = spark.createDataFrame([(1, None), (2, 5), (3, 1)], "id long, size int")
    order = lambda s: [r["id"] for r in library.list_library(rows, sort=s, allowed={"size": "size"}, key="id").collect()]
    assert order("size") == [3, 2, 1]
    assert order("-size") == [1, 2, 3]
    with pytest.raises(ValueError, match="unknown sort"):
        order("password")


def test_cycle_guard(spark):
    tree = spark.createDataFrame([("b", "a"), ("c", "b"), ("a", None)], "node string, parent string")
    assert library.makes_cycle(spark, tree, "a", "c")
    assert library.makes_cycle(spark, tree, "a", "a")
    assert not library.makes_cycle(spark, tree, "c", "a")
    loop = spark.createDataFrame([("b", "a"), ("a", "b")], "node string, parent string")
    assert library.tree_closure(spark, loop).count() == 4


@pytest.mark.parametrize(
    ("raw", "clean"), [("see 10.1000/xyz(1). next", "10.1000/xyz(1)"), ("(10.1000/abc)", "10.1000/abc"), ("10.1000/a;", "10.1000/a"), ("none", None)]
)
def test_doi(spark, raw, clean):
    assert one(spark, ids.extract_doi(F.lit(raw))) == clean


@pytest.mark.parametrize(("isbn", "valid"), [("0-306-40615-2", "0306406152"), ("978-0-306-40615-7", "9780306406157"), ("080442957X", "080442957X"), ("0306406153", None), ("12", None)])
def test_isbn(spark, isbn, valid):
    assert one(spark, ids.valid_isbn(F.lit(isbn))) == valid


def test_ranges_and_urls(spark):
    assert one(spark, ids.expand_ranges(F.lit("1-3,7"))) == [1, 2, 3, 7]
    assert one(spark, ids.expand_ranges(F.lit("x"))) is None
    assert one(spark, ids.is_safe_url(F.lit("http://10.0.0.1/a"))) is False
    assert one(spark, ids.is_safe_url(F.lit("https://example.org/a"))) is True
    assert one(spark, ids.masked_key(F.lit("sk-12345678"))) == "••••5678"


def test_year_is_not_taken_from_an_identifier(spark):
    assert one(spark, ids.first_year(F.lit("See (doi:10.1234/AB.1990). Also arXiv:1901.2001v2 of 2013."))) == 2013
    assert one(spark, ids.first_year(F.lit("Only 10.1234/2001"))) is None and one(spark, ids.first_year(F.lit("(1999), 2001"))) == 1999


def test_title_rules(spark):
    assert one(spark, tx.title_matches(F.lit("deep nets"), F.lit("On Deep Nets, again"))) is True
    assert one(spark, tx.title_matches(F.lit("deep cats sing"), F.lit("Deep nets"))) is False
    assert one(spark, tx.title_similarity(F.lit(""), F.lit("a b"))) == 0


def test_tolerant_json(spark):
    assert one(spark, js.tolerant_json(F.lit('```json\n{"a": "x\ny"}\n```'), "a string"))["a"] in ("x y", "x\ny")
    assert one(spark, js.index_list(F.array(*(F.lit(x) for x in ("2", "2", "0", "q", "3"))), F.lit(3))) == [2, 3]


def block(kind, content, page=1, path=()):
    return {"block_type": kind, "content": content, "page_number": page, "section_path": list(path)}


SENTENCE = "This sentence has quite enough words to be kept as a chunk of its own, surely. "


def test_tables_are_atomic_and_captions_attach():
    out = chunking.chunks_of([block("paragraph", SENTENCE), block("table", "| a |"), block("caption", "Table 1: a", 2), block("caption", "Figure 2: b", 3)])
    assert [c["chunk_type"] for c in out] == ["paragraph", "table"]
    assert out[1]["content"].endswith("Figure 2: b")
    assert out[1]["end_page_number"] == 3


def test_references_are_skipped_until_an_appendix():
    out = chunking.chunks_of([block("heading", "", path=["References"]), block("paragraph", SENTENCE), block("heading", "", path=["Appendix A"]), block("paragraph", SENTENCE, 9)])
    assert [c["page_number"] for c in out] == [9]


def test_overlap_carries_the_last_paragraph():
    paragraphs = [block("paragraph", f"{i} " + SENTENCE * 8, i) for i in range(4)]
    out = chunking.chunks_of(paragraphs)
    assert len(out) > 1
    assert out[1]["content"].startswith(out[0]["content"].split("\n\n")[-1])


def test_lists_may_run_to_twice_the_size():
    items = [block("paragraph", "- " + SENTENCE * 5) for _ in range(6)]
    assert len(chunking.chunks_of(items)) == 1


def test_oversize_titles_fall_back():
    out = chunking.chunks_of([block("paragraph", SENTENCE, path=["Intro", "x" * 300])])
    assert (out[0]["section_title"], out[0]["section_level"]) == ("Intro", 1)


def test_blocks_by_line(spark):
    got = one(spark, chunking.text_blocks(F.lit("# T\n12\n\n| a | b |\nFigure 3. x\nplain text")))
    assert [b["block_type"] for b in got] == ["heading", "table", "caption", "paragraph"]


@pytest.mark.parametrize(
    ("quote", "method"),
    [("quick brown", "exact"), ("QUICK  Brown", "normalized"), ("hyphenated words", "dehyphenated"), ("xx brown fox jumps yy", "core"), ("quikc brwn fox jmps over", "char-lcs"), ("zzzzzzzzzzzz qqqqqqqqq", None)],
)
def test_quote_tiers(quote, method):
    got = matching.find_quote("The quick brown fox jumps over hyphen- ated words here", quote)
    assert (got and got[0]) == method


def test_quote_offsets_are_original():
    text = "A  ﬁne   day"
    method, _, a, b = matching.find_quote(text, "fine day")
    assert (method, text[a:b]) == ("normalized", "ﬁne   day")


def test_keep_first(spark):
    words = " ".join(f"w{i}" for i in range(30))
    rows = spark.createDataFrame([(1, 1, words), (1, 2, words + " extra"), (1, 3, "other"), (1, 4, "")], "g long, k long, t string")
    assert sorted(r["k"] for r in matching.keep_first(rows, "g", "k", "t").collect()) == [1, 3]


def test_verified_highlights(spark):
    rows = spark.createDataFrame([(1, "exact phrase here", "an exact  phrase here now"), (2, "exact phrase hexx", "an exact phrase here"), (3, "short", "short"), (4, "nothing alike at all", "zzz")], "id long, q string, p string")
    assert {r["id"]: r["verified"] for r in matching.verified_highlights(rows, "id", "q", "p").collect()} == {1: True, 2: True, 3: False, 4: False}


def interaction(spark, reply, chunks, scope="single_pdf"):
    return spark.createDataFrame([(1, reply, scope, chunks)], "id long, reply string, scope string, retrieved array<struct<chunk_id:string,title:string,page_number:int,end_page_number:int>>")


@pytest.mark.parametrize(
    ("reply", "chunks", "status"),
    [("x [p.3]", [("a", "T", 2, 4)], "parsed"), ("x [p.3]", [("a", "T", 3, 0), ("b", "T", 2, 4)], "ambiguous"), ("x [p.9]", [("a", "T", 2, 4)], "partial"), ("x", [("a", "T", 2, 4)], "no_citations")],
)
def test_citation_status(spark, reply, chunks, status):
    rows = interaction(spark, reply, chunks)
    assert training.parse_status(rows, training.citation_events(rows)).first()["parse_status"] == status


def test_citation_order_and_scope(spark):
    rows = interaction(spark, "[p.1] then [Deep Nets, p. 2]", [("a", "deep nets", 1, 2), ("b", "cats", 1, 2)], "collection")
    got = training.citation_events(rows).orderBy("citation_rank").collect()
    assert [(r["title"], r["page"], r["matched"]) for r in got] == [("Deep Nets", 2, ["a"]), (None, 1, [])]


def test_dml(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id long, v string")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(dml.upsert(old, new, ["id"])) == [(1, "a"), (2, "c"), (3, "d")]
    assert rows(dml.insert_missing(old, new, ["id"])) == [(1, "a"), (2, "b"), (3, "d")]
    assert {r["v"]: r["f"] for r in dml.set_null_on_delete(old.withColumnRenamed("id", "f"), "f", new, "id").collect()} == {"a": 1, "b": None}
    assert dml.check_violations(old, v=["a"]).count() == 1
    kept = dml.update_fields(spark.createDataFrame([("x", "y", ["a"])], "a string, b string, edited array<string>"), {"a": "1", "b": "2"}, "edited").first()
    assert (kept["a"], kept["b"]) == ("x", "2")


def test_job_steps(spark):
    rows = spark.createDataFrame([(1, 1, "pending", "2024-01-01 00:00:00"), (1, 2, "running", "2024-01-01 00:01:00"), (1, 3, "running", "2024-01-01 00:20:00"), (1, 4, "pending", "2024-01-01 00:21:00")], "job long, k long, s string, t string").withColumn("t", F.col("t").cast("timestamp"))
    got = state.job_states(rows, "job", "s", "t", "k").orderBy("k").collect()
    assert [(r["legal"], r["stale"]) for r in got] == [(True, False), (True, False), (True, True), (False, False)]


def test_partial_quota_reset(spark):
    rows = spark.createDataFrame([(1, 0, 0, "2024-01-01")], "u long, chat int, explain int, d string").withColumn("d", F.col("d").cast("date"))
    got = state.reset_stale(rows, {"chat": 20, "explain": 10}, "d", F.lit("2024-01-02").cast("date"), only="chat").first()
    assert (got["chat"], got["explain"], str(got["d"])) == (20, 0, "2024-01-02")


def test_sse_skips_noise(spark):
    lines = spark.createDataFrame([("m", 'data: {"kind":"token","seq":2,"token":"b"}'), ("m", "data: {oops"), ("m", ": ping"), ("m", 'data: {"kind":"token","seq":1,"token":"a"}'), ("m", "data: [DONE]")], "m string, line string")
    assert streams.reassemble(streams.sse_events(lines), "m").first()["text"] == "ab"


def test_documents_are_replaced_by_key(spark, tmp_path):
    path = str(tmp_path / "chunks")
    write_documents(spark.createDataFrame([(1, "old"), (2, "stays")], "doc long, t string"), path, "doc")
    write_documents(spark.createDataFrame([(1, "new")], "doc long, t string"), path, "doc")
    assert sorted((r["doc"], r["t"]) for r in spark.read.parquet(path).collect()) == [(1, "new"), (2, "stays")]


def test_intervals(spark):
    rows = spark.createDataFrame([(1, 0, 5), (1, 3, 8), (1, 10, 12), (2, 0, 1)], "g int, low int, high int")
    got = sorted((r["g"], r["low"], r["high"], r["n"]) for r in library.merge_intervals(rows, "g", "low", "high").collect())
    assert got == [(1, 0, 8, 2), (1, 10, 12, 1), (2, 0, 1, 1)]


@pytest.mark.parametrize(("word", "stemmed"), [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("hopping", "hop"), ("filing", "file"), ("happily", "happili"), ("relational", "relat"), ("generously", "generous"), ("sensibility", "sensibl"), ("dying", "die"), ("knees", "knee"), ("communism", "communism"), ("controlling", "control"), ("by", "by")])
def test_stems(word, stemmed):
    assert english.stem(word) == stemmed


def test_full_text_matches_forms_and_no_stop_words(spark):
    rows = spark.createDataFrame([(1, "The thing was running"), (2, "Things run, and the runs thing."), (3, "nothing runs"), (4, None)], "id long, content string")
    assert english.query_terms("The things that ran and RUN") == ["thing", "ran", "run"]
    assert {r["id"] for r in search.keyword_matches(rows, english.query_terms("a running thing")).collect()} == {1, 2}
    assert search.keyword_matches(rows, english.query_terms("it was the")).count() == 0


def brute_char_span(hay, needle, least=0.65):
    m, n = len(hay), len(needle)
    if n < 4 or not m:
        return None
    table = [[0] * (n + 1) for _ in range(m + 1)]
    for i in range(m):
        for j in range(n):
            table[i + 1][j + 1] = table[i][j] + 1 if hay[i] == needle[j] else max(table[i][j + 1], table[i + 1][j])
    if table[m][n] < least * n:
        return None
    i, j, used = m, n, []
    while i and j:
        if hay[i - 1] == needle[j - 1]:
            used.append(i - 1)
            i, j = i - 1, j - 1
        elif table[i - 1][j] >= table[i][j - 1]:
            i -= 1
        else:
            j -= 1
    low, high = min(used), max(used) + 1
    return (low, high) if 0.4 * n <= high - low <= 2.5 * n else None


def test_character_spans_against_the_whole_table():
    rng = random.Random(5)
    for _ in range(300):
        hay, needle = ("".join(rng.choices("abcd ", k=rng.randrange(lo, hi))) for lo, hi in ((0, 60), (2, 30)))
        assert matching.char_span(hay, needle) == brute_char_span(hay, needle)


@pytest.mark.parametrize("block", [1024, 3])
def test_near_duplicate_pairs_in_blocks(spark, block):
    rng = random.Random(9)
    rows = [(i, i % 2, [rng.random() for _ in range(4)]) for i in range(40)] + [(40, 0, [0.0] * 4), (41, 1, None)]
    frame = spark.createDataFrame(rows, "id long, pdf int, v array<float>")
    unit = {i: (p, np.array(v) / np.linalg.norm(v)) for i, p, v in rows if v and any(v)}
    want = sorted((-round(float(unit[a][1] @ unit[b][1]), 6), a, b) for a in unit for b in unit if a < b and unit[a][0] == unit[b][0] and unit[a][1] @ unit[b][1] >= 0.9)[:25]
    got = [(-r["similarity"], r["id_a"], r["id_b"]) for r in library.near_duplicate_pairs(frame, "pdf", "id", "v", 0.9, 25, block=block).collect()]
    assert [g[1:] for g in got] == [w[1:] for w in want] and np.allclose([g[0] for g in got], [w[0] for w in want], atol=2e-6)


def test_sentence_starts(spark):
    text = "One ends. Two has e.g. Seven. Three goes on. and Four"
    start = lambda low, high, skip: one(spark, reading.sentence_start(F.lit(text), F.lit(low), F.lit(high), skip))
    assert start(0, 26, True) == text.index("Two") and start(0, 26, False) == text.index("Seven")
    assert start(12, 60, True) == text.index("Three") and start(0, 5, True) == -1
    assert start(21, 26, True) == -1 and start(21, 26, False) == text.index("Seven")


def test_headings(spark):
    text = "[HEADING L3] Marked\nx\n\n2.1 Inner Part\n\nmethods\n\nA Title Of Some Length\n\nnot A Title at all here\n\n" + "Running\n\n".join(["x\n\nResults\n\n"] * 4)
    got = [(r["title"], r["level"]) for r in reading.headings(spark.createDataFrame([(1, text), (2, None)], "id long, t string"), "id", "t").orderBy("at").collect()]
    assert got == [("Marked", 3), ("Inner Part", 2), ("Methods", 1), ("A Title Of Some Length", 2)]


def test_deep_trees(spark):
    rng = random.Random(8)
    ids = list(range(10_000))
    rng.shuffle(ids)
    chain = spark.createDataFrame([(a, b) for a, b in zip(ids[1:], ids)] + [(-1, -2), (-2, -3), (-3, -2)], "node long, parent long")
    got = {r["node"]: (r["root"], r["depth"]) for r in library.tree_levels(spark, chain).collect()}
    assert all(got[x] == (ids[0], k) for k, x in enumerate(ids)) and {got[-1], got[-2], got[-3]} == {(None, None)} and len(got) == 10_003
    assert library.makes_cycle(spark, chain, ids[3], ids[9000]) and not library.makes_cycle(spark, chain, ids[9000], ids[3])
    assert library.makes_cycle(spark, chain, -3, -1) and not library.makes_cycle(spark, chain, -1, -3)


def test_closure_of_a_deep_tree(spark):
    rng = random.Random(9)
    ids = list(range(1000))
    rng.shuffle(ids)
    chain = spark.createDataFrame([(a, b) for a, b in zip(ids[1:], ids)], "node long, parent long")
    out = library.tree_closure(spark, chain)
    place = {x: k for k, x in enumerate(ids)}
    assert out.count() == 1000 * 999 // 2
    assert all(place[r["node"]] - place[r["ancestor"]] == r["depth"] for r in out.where("node % 97 = 0").collect())


def test_chunks_of_more_documents_than_are_objects_at_once(spark):
    """Documents pass in pieces of a batch; a piece's rows leave before the next is read."""
    assert chunking.DOCS_AT_ONCE < 200
    text = F.concat(F.lit("A sentence of a good many words for number "), F.col("id").cast("string"), F.lit(", which is worth keeping as a chunk."))
    docs = spark.range(0, 200, 1, 1).select(F.col("id").alias("doc_id"), chunking.text_blocks(text).alias("blocks"))
    got = sorted((r["doc_id"], r["chunk_index"], r["page_number"], r["section_level"]) for r in chunking.chunk_documents(docs).collect())
    assert got == [(i, 0, 1, None) for i in range(200)]


@pytest.mark.parametrize("compared", [tx.title_similarity, tx.title_matches])
def test_titles_are_normalised_once(spark, compared):
    """Each title is lower-cased once in the plan, however often the comparison uses it."""
    rows = spark.createDataFrame([("A b c d", "a B x"), (None, "a"), ("", "")], "a string, b string")
    plan = rows.select(compared(F.col("a"), F.col("b")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 2
    assert [one(spark, tx.title_similarity(F.lit("A b c d"), F.lit("a B x"))), one(spark, tx.title_matches(F.lit("A b c d"), F.lit("a B x")))] == [0.4, True]


def test_common_length_of_characters():
    rng = random.Random(8)
    for _ in range(60):
        a, b = ("".join(rng.choice("abcé ") for _ in range(rng.randrange(1, 40))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            old, new = row, [0]
            for j, y in enumerate(b):
                new.append(old[j] + 1 if x == y else max(new[-1], old[j + 1]))
            row = new
        assert matching.common_length(a, b) == row[-1]
