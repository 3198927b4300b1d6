"""Rows without a doc_id: one defined result for every operator and for the pipeline's stages."""

import random

import pytest
from lectern.llm.decontaminate import decontaminate, find_contamination
from lectern.llm.exact_dedup import exact_dedup
from lectern.llm.jaccard_join import jaccard_join
from lectern.llm.language_id import identify_language
from lectern.llm.licenses import scan_licenses
from lectern.llm.mixing import mix_sources
from lectern.llm.pii import find_pii
from lectern.llm.substring_dedup import substring_dedup
from lectern.llm.toxicity import score_toxicity
from pyspark.sql import functions as F

from .fixtures import sentence
from .test_dedup import grouped, linked, stripped

DDL = "doc_id long, text string, lang string, source string, n_chars long, __score double, key string"
LOW = -1  # the place that a row without an id takes among the others


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(21)
    a, b = sentence(rng, 60), sentence(rng, 40)
    return [(3, a), (None, a), (None, a), (5, a + " more"), (7, b + " " + sentence(rng, 30)), (8, sentence(rng, 9) + " " + b), (9, None), (10, "")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", 1, 0.5, "k") for d, t in rows], DDL)


def placed(rows):
    return [(LOW if d is None else d, t) for d, t in rows]


def shown(x):
    return None if x == LOW else x


def test_substrings(docs, rows):
    want = sorted((repr(shown(d)), *stripped(placed(rows))[d]) for d, _ in placed(rows))
    out = substring_dedup(docs).collect()
    assert sorted((repr(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_text"]) for r in out) == want
    by_id = {r["doc_id"]: r["repeats"] for r in out}
    assert [tuple(x) for x in by_id[3]] == [(0, 60)] and [tuple(x) for x in by_id[8]] == [(9, 40)]


def test_exact(docs, rows):
    want = sorted((repr(shown(d)), repr(shown(grouped(placed(rows))[d][0])), *grouped(placed(rows))[d][1:]) for d, _ in placed(rows))
    for incoming in ("doc_id % 2 = 1", "true", "false"):
        got = exact_dedup(docs, F.expr(incoming), rows_per_bucket=4).collect()
        assert sorted((repr(r["doc_id"]), repr(r["keep_id"]), r["group_size"], r["kept"], r["text_sha256"]) for r in got) == want


def test_join(docs, rows):
    got = {(r["doc_id"], r["rep_id"], r["class_id"]) for r in jaccard_join(docs).collect()}
    want = {(shown(d), shown(linked(placed(rows))[d][0]), shown(linked(placed(rows))[d][1])) for d, _ in placed(rows)}
    assert got == want and jaccard_join(docs).count() == len(rows)


def test_contamination(spark, docs, rows):
    items = spark.createDataFrame([(1, rows[0][1][:200])], "item_id long, text string")
    assert sorted(repr(r["doc_id"]) for r in find_contamination(docs, items).collect()) == ["3", "5", "None"]
    kept = decontaminate(docs, items)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [7, 8, 9, 10]


def test_rows_are_judged_each(spark, docs, rows):
    labels = spark.createDataFrame([(3, 0), (None, 1)], "doc_id long, toxic int")
    for out in (identify_language(docs, F.lit(True)), find_pii(docs), scan_licenses(docs), mix_sources(docs), score_toxicity(docs, labels, F.lit(True))):
        assert sorted(repr(r["doc_id"]) for r in out.collect()) == sorted(repr(d) for d, _ in rows)


@pytest.fixture(scope="module")
def small_tables(spark, tmp_path_factory, rows):
    """A folder of tables with the rows above, one toxic document and one benchmark passage."""
    sf, rng = str(tmp_path_factory.mktemp("tables")), random.Random(2)
    leak = sentence(rng, 30)
    extra = [(100, sentence(rng, 12) + " " + leak), (None, leak), (101, "you idiot you moron"), (102, sentence(rng, 50))]
    taught = [(200 + i, f"you idiot you moron {sentence(rng, 4)}" if i % 2 else sentence(rng, 8)) for i in range(60)]
    spark.createDataFrame([(d, t, "en", None if i % 2 else "s", 1, 0.5, "k") for i, (d, t) in enumerate([*rows, *extra, *taught])], DDL).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(d, 1, int(d % 2)) for d, _ in taught], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    return sf, [*rows, *extra, *taught]


def test_pipeline_against_plain_python(spark, small_tables):
    """Planted cases: toxic rows, exact and near copies with and without ids, a leaked passage; each stage on its own input."""
    import corpus_pipeline as p

    sf, rows = small_tables
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, stages = docs.columns, dict(p.STAGES)
    as_seen = lambda df: sorted((repr(r["doc_id"]), repr(r["text"])) for r in df.collect())

    clean = stages["toxicity"](spark, docs, sf)
    assert clean.columns == columns
    assert as_seen(clean) == sorted((repr(d), repr(t)) for d, t in rows if not (t or "").startswith("you idiot"))

    single = stages["exact_dedup"](spark, clean, sf)
    held = [(r["doc_id"], r["text"]) for r in clean.collect()]
    best = grouped(placed(held))
    assert as_seen(single) == sorted((repr(d), repr(t)) for d, t in held if best[LOW if d is None else d][0] == (LOW if d is None else d) or (d is None and t != rows[0][1]))

    apart = stages["near_duplicates"](spark, single, sf)
    held = [(r["doc_id"], r["text"]) for r in single.collect() if r["doc_id"] is not None]
    heads = {d for d, _ in held if linked(held)[d][1] == d}
    got = [(r["doc_id"], r["text"]) for r in apart.collect()]
    assert {d for d, _ in got if d is not None} == heads - {5}  # 5 is near a row without an id, which stands before it
    assert sum(d is None for d, _ in got) == 3  # the repeated row is there twice, as rows that repeat an id are

    unleaked = stages["decontamination"](spark, apart, sf)
    leak = spark.read.parquet(f"{sf}/benchmark.parquet").first()["text"]
    assert as_seen(unleaked) == sorted((repr(d), repr(t)) for d, t in got if leak not in (t or ""))

    mixed = stages["mixing"](spark, unleaked, sf)
    assert sorted(repr(r["doc_id"]) for r in mixed.collect()) == sorted(repr(r["doc_id"]) for r in unleaked.collect())
    assert sorted(repr(r["doc_id"]) for r in p.run(spark, sf).collect()) == sorted(repr(r["doc_id"]) for r in unleaked.collect())


def test_pipeline_of_empty_tables(spark, small_tables, tmp_path):
    import corpus_pipeline as p

    sf, _ = small_tables
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0


def test_folds_of_rows_without_an_id(spark, small_tables):
    """Queries with folds say of every row whether it was held out; rows without an id count as the id ''."""
    from lectern.llm import q_op2, q_op9, q_op13

    sf, rows = small_tables
    for query, fold in ((q_op2.op2_language_id, False), (q_op9.op9_toxicity, True), (q_op13.op13_lm_score, False)):
        got = [(r["doc_id"], r["held_out"]) for r in query(spark, sf).collect()]
        assert len(got) == len(rows) and all(h in (True, False) for _, h in got) and {h for d, h in got if d is None} == {fold}
