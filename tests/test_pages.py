"""Blocks of Markdown and marked pages, elements in order, ranges as rectangles, quotes found again: plain versions and cases."""

import math
import random

import duckdb
import pytest
from lectern.functions import geometry as geo
from lectern.functions import text as tx
from lectern.operators import blocks, dml, matching
from lectern.plans import pages as plans
from pyspark.sql import functions as F


def markdown(spark, *pages):
    rows = [(1, i, t) for i, t in enumerate(pages, 1)]
    out = blocks.markdown_blocks(spark.createDataFrame(rows, "doc long, page int, text string"), "doc", "page", "text")
    return [(r["block_type"], r["content"], " > ".join(r["section_path"])) for r in out.orderBy("place").collect()]


def test_blocks_of_several_lines(spark):
    assert markdown(spark, "para one\nstill one\n\n| a | b |\n|:--|--:|\n| 1 | 2 |\n| 3 | 4 |\nnot a row\n\nafter") == [
        ("paragraph", "para one\nstill one", ""), ("table", "| a | b |\n|:--|--:|\n| 1 | 2 |\n| 3 | 4 |\nnot a row", ""), ("paragraph", "after", ""),
    ]
    assert markdown(spark, "```\n# no heading\n\n| a | b |\n|---|---|\n```\ntext") == [("code", "# no heading\n\n| a | b |\n|---|---|\n", ""), ("paragraph", "text", "")]
    assert markdown(spark, "```\nleft open\n\nto the end") == [("code", "left open\n\nto the end\n", "")]
    assert markdown(spark, "- one\n- two\n  more\n\n1. three\n") == [("paragraph", "- one", ""), ("paragraph", "- two\n  more", ""), ("paragraph", "1. three", "")]
    assert markdown(spark, None, "", "   \n\n", "7") == []


def test_headings_stay_open_over_pages(spark):
    got = markdown(spark, "# A\nintro\n## B ##\ntext", "deep\n\nC\n===\n### D\nunder\n\nE\n---\n***\nlast")
    assert got == [
        ("heading", "# A", "A"), ("paragraph", "intro", "A"), ("heading", "## B ##", "A > B"), ("paragraph", "text", "A > B"), ("paragraph", "deep", "A > B"), ("heading", "C\n===", "C"),
        ("heading", "### D", "C > D"), ("paragraph", "under", "C > D"), ("heading", "E\n---", "C > E"), ("paragraph", "last", "C > E"),
    ]


@pytest.mark.parametrize(
    ("line", "caption"),
    [("Figure 1: a", True), ("fig. 2) b", True), ("Tab 3 - c", True), ("TABLE 12. d", True), ("Fig 4 e", True), ("Figure 1A shows", False), ("Table 3", False), ("Figures 1: a", False), ("see Figure 1: a", False)],
)
def test_captions(spark, line, caption):
    assert spark.range(1).select(tx.is_caption(F.lit(line)).alias("x")).first()["x"] is caption


def test_marked_blocks(spark):
    text = "[HEADING L2]  A \n\n[TABLE]\n| x |\n\n[HEADING L1] B\n\n[TABLE]\n| y |\n[/TABLE]\n\n[TABLE CAPTION] Table 1: z\n\n \n\nplain"
    out = blocks.marked_blocks(spark.createDataFrame([(1, 1, text), (1, 2, "more"), (2, 1, None)], "doc long, page int, text string"), "doc", "page", "text")
    assert [(r["block_type"], r["content"], " > ".join(r["section_path"])) for r in out.orderBy("place").collect()] == [
        ("heading", "[HEADING L2]  A", "A"), ("table", "[TABLE]\n| x |", "A"), ("heading", "[HEADING L1] B", "B"), ("table", "| y |", "B"), ("caption", "[TABLE CAPTION] Table 1: z", "B"), ("paragraph", "plain", "B"), ("paragraph", "more", "B"),
    ]


def test_structure_goes_before_the_first_text_at_or_below_it(spark):
    rng = random.Random(11)
    rows = [(i, rng.randrange(6), rng.choice(["text", "text", "table", "heading"]), rng.randrange(40)) for i in range(300)]
    numbered = {}
    for page in range(6):
        for no, r in enumerate(rng.sample([r for r in rows if r[1] == page and r[2] == "text"], sum(r[1] == page and r[2] == "text" for r in rows)), 1):
            numbered[r[0]] = no
    df = spark.createDataFrame([(*r, numbered.get(r[0])) for r in rows], "id long, page int, kind string, y int, no int")
    got = {}
    for r in blocks.merge_elements(df, "page", "kind", "y", "no", "id").orderBy("page", "merged_no").collect():
        got.setdefault(r["page"], []).append(r["id"])
    for page in range(6):
        text = sorted((r for r in rows if r[1] == page and r[2] == "text"), key=lambda r: numbered[r[0]])
        rest, want = sorted((r for r in rows if r[1] == page and r[2] != "text"), key=lambda r: (r[3], r[0])), []
        for t in text:
            while rest and rest[0][3] <= t[3]:
                want.append(rest.pop(0)[0])
            want.append(t[0])
        assert got[page] == want + [r[0] for r in rest]


def plain_rects(items, start, end, page_width, page_height):
    out = []
    for low, text, t, width, height in items:
        n, high = len(text), low + len(text)
        if low >= end or high <= start:
            continue
        a, b = max(0, start - low), min(n, end - low)
        a = max(a, n - len(text.lstrip())) if a == 0 else a
        b = min(b, len(text.rstrip())) if b == n else b
        along, across = math.hypot(t[0], t[1]), math.hypot(t[2], t[3])
        if a >= b or not along or not across:
            continue
        tall = height or across
        out.append([(t[4] + a / n * width * t[0] / along) / page_width, (page_height - t[5] - tall) / page_height, (b - a) / n * width / page_width, tall / page_height])
    merged = []
    for x, y, w, h in sorted(out, key=lambda r: (round(r[1], 3), r[0])):
        if merged and abs(merged[-1][1] - y) < 1e-4 and abs(merged[-1][3] - h) < 1e-4 and x <= merged[-1][0] + merged[-1][2] + max(0.005, 4 * h):
            merged[-1][2] = max(merged[-1][0] + merged[-1][2], x + w) - merged[-1][0]
        else:
            merged.append([x, y, w, h])
    return merged


def test_ranges_as_rectangles(spark):
    rng = random.Random(2)
    items, at = [], 0
    for line in range(6):
        for k in range(4):
            text = rng.choice(["word", " a b ", "", "  ", "longer text "])
            turn = rng.choice([(10.0, 0.0, 0.0, 10.0), (0.0, 8.0, -8.0, 0.0), (0.0, 0.0, 0.0, 0.0)] if k == 3 else [(10.0, 0.0, 0.0, 10.0)])
            items.append((at, text, [*turn, 20.0 + 130 * k, 700.0 - 30 * line], 9.0 * len(text), rng.choice([0.0, 10.0])))
            at += len(text) + 1
    rows = spark.createDataFrame([(1, s, s + len(t), t, m, w, h) for s, t, m, w, h in items], "page long, start long, end long, str string, transform array<double>, width double, height double")
    pages = spark.createDataFrame([(1, 600.0, 800.0, 0), (2, 600.0, 800.0, 90)], "page long, page_width double, page_height double, rotation int")
    asked = [(i, rng.randrange(at), rng.randrange(at)) for i in range(60)]
    ranges = spark.createDataFrame([(i, 1, a, b) for i, a, b in asked], "range_id long, page long, from long, to long")
    got = {r["range_id"]: r["rects"] for r in geo.range_rects(ranges, rows, pages).collect()}
    for i, a, b in asked:
        want = plain_rects(items, a, b, 600.0, 800.0) if a < b else []
        assert [[pytest.approx(v) for v in r] for r in want] == [list(r) for r in got.get(i, [])]
    turned = geo.range_rects(ranges.where("to > from").withColumn("page", F.lit(2).cast("long")), rows.withColumn("page", F.lit(2).cast("long")), pages)
    for r in turned.collect():
        flat = got[r["range_id"]]
        assert [list(x) for x in r["rects"]] == [[pytest.approx(v) for v in (1 - f["y"] - f["h"], f["x"], f["h"], f["w"])] for f in flat]


def test_quotes_are_found_on_the_nearest_page(spark):
    pages = spark.createDataFrame([("d", 1, "alpha beta gamma delta epsilon"), ("d", 2, "nothing here"), ("d", 3, "ALPHA BETA GAMMA delta zeta"), ("d", 7, "far away words stand here")], "doc string, page int, text string")
    quotes = spark.createDataFrame([(1, "d", 2, "alpha beta gamma"), (2, "d", 3, "alpha beta gamma"), (3, "d", 4, "far away words stand"), (4, "d", 5, "far away words stand"), (5, "x", 1, "alpha"), (6, "d", 1, None)], "id long, doc string, page int, quote string")
    got = {r["id"]: (r["page"], r["method"], r["start"], r["end"], r["prefix"], r["suffix"]) for r in matching.relocate_quotes(quotes, pages, "id").collect()}
    # the page before wins over the page after; the own page wins even where it has the quote less exactly
    assert got == {1: (1, "exact", 0, 16, "", " delta epsilon"), 2: (3, "normalized", 0, 16, "", " delta zeta"), 4: (7, "exact", 0, 20, "", " here")}


def test_quotes_over_stretches_of_pages_as_one_by_one(spark):
    rng = random.Random(4)
    words = [f"{rng.choice('abcdefgh')}{k:03}" for k in range(300)]
    texts = {(doc, p): " ".join(rng.choices(words, k=rng.randrange(0, 40))) for doc in ("d", None) for p in rng.sample(range(-5, 150), 130)}
    asked = []
    for k in range(400):
        doc, p = rng.choice(list(texts))
        low = rng.randrange(30)
        quote = texts[doc, p][low : low + rng.randrange(5, 60)]
        asked.append((k, doc, p + rng.randrange(-3, 4), rng.choice([quote, quote.upper(), quote[:-9] + "zz" + quote[-7:], " "])))
    want = {}
    for k, doc, at, quote in asked:
        for p in (at, at - 1, at + 1, at - 2, at + 2):
            if found := matching.find_quote(texts.get((doc, p)), quote):
                want[k] = (p, *found, texts[doc, p][max(0, found[2] - 40) : found[2]], texts[doc, p][found[3] : found[3] + 40])
                break
    pages = spark.createDataFrame([(*k, t) for k, t in texts.items()], "doc string, page int, text string")
    out = matching.relocate_quotes(spark.createDataFrame(asked, "id long, doc string, page int, quote string"), pages, "id")
    assert {r["id"]: tuple(r)[1:] for r in out.collect()} == want
    assert {m for _, m, *_ in want.values()} >= {"exact", "normalized", "char-lcs"}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan  # each text goes to the tasks once, not once a distance


def test_a_page_is_read_once_for_all_quotes(monkeypatch):
    rng, made = random.Random(9), []
    monkeypatch.setattr(matching, "normal_text", lambda t, f=matching.normal_text: made.append(t) or f(t))
    hay = matching.Haystack("  Ŧhe ﬁrst\u00ad page –  " + "".join(rng.choices("abcdef 0123456789", k=900)))
    for _ in range(20):
        quote = "".join(rng.choices("abcdef 0123456789", k=70))
        assert matching.find_in(hay, matching.Needle(quote)) == matching.find_quote(hay.text, quote)
    assert matching.normalise(hay.text)[0] == hay.plain
    assert sum(t == hay.text for t in made) == 1 + 20  # once for the twenty above, once for each of the plain calls


def test_spans_ruled_out_are_not_there():
    rng = random.Random(6)
    some = 0
    for k in range(600):
        letters = "abcd " if k % 2 else "abcdef0123456789 "
        needle = "".join(rng.choices(letters, k=rng.randrange(2, 40))).strip()
        hay = "".join(rng.choices(letters, k=rng.randrange(0, 400)))
        if k % 3 == 0:
            hay = hay[:60] + "".join(c for c in needle if rng.random() < 0.9) + hay[60:] * (1 + k % 2 * 9)
        span = matching.char_span(matching.normal_text(hay), needle)
        some += span is not None
        assert span is None or matching.Haystack(hay).may_have(needle)
    assert some > 50


def test_quotes_of_documents_without_a_source(spark, tmp_path):
    rows = [(k, None if k % 7 == 0 else f"s{k % 2}", None if k % 11 == 0 else f"Text {k} of no great length.") for k in range(80)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["quote_id"], r["page"], r["method"]) for r in plans.quote_pages(spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == {r[:3] for r in con.sql(plans.SQL["quote_pages"]).fetchall()}


def test_backfill(spark):
    rows = spark.createDataFrame([(1, None, None, "b"), (2, None, "a", "b"), (3, "x", "a", None), (4, None, None, None)], "id int, c string, one string, two string")
    assert [r["c"] for r in dml.backfill(rows, "c", "one", "two").orderBy("id").collect()] == ["b", "a", "x", None]
