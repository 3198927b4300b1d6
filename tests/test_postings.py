"""The postings index and its rank: worked cases, plain pairs of places, changes by segments."""

import math
import random

import numpy as np
import pytest
from lectern.functions import english
from lectern.operators import postings, search
from lectern.operators.postings import PostingsIndex, rank_positions


def plain_rank(positions):
    """Pair by pair, as the database's documentation of its source has it."""
    if len(positions) == 1:
        return sum(0.1 / (j + 1) ** 2 for j in range(len(positions[0]))) / 1.64493406685
    left = 1.0
    for i, one in enumerate(positions):
        for other in positions[:i]:
            for x in one:
                for y in other:
                    d = abs(x - y)
                    left *= 1 - 0.1 * math.sqrt(1e-30 if d > 100 else 1 / (1.005 + 0.05 * math.exp(d / 1.5 - 2)))
    return 1 - left


def test_rank_of_worked_cases():
    # one place of one term; neighbours; the places where the two words are two and fifty apart
    assert rank_positions([np.array([1])]) == pytest.approx(0.0607927, abs=1e-6)
    assert rank_positions([np.array([1]), np.array([2])]) == pytest.approx(0.0991032, abs=1e-6)
    assert rank_positions([np.array([1]), np.array([3])]) == pytest.approx(0.0985009, abs=1e-6)
    assert 0 < rank_positions([np.array([1]), np.array([500])]) < 1e-14


def test_rank_against_all_pairs():
    rng = random.Random(3)
    for terms in (1, 2, 3):
        for _ in range(20):
            places = rng.sample(range(1, 400), 60)
            split = [np.array(sorted(places[i::terms][: rng.randrange(1, 30)])) for i in range(terms)]
            assert rank_positions(split) == pytest.approx(plain_rank([x.tolist() for x in split]), rel=1e-9, abs=1e-12)
    many = np.arange(1, 200_001)
    assert rank_positions([many[::2], many[1::2]]) == pytest.approx(1)


def test_words_of_any_letters():
    got = postings.lexemes("Élèves naïfs; the RUNNING élèves, état-2 日本語")
    assert got[english.stem("élèves")] == [1, 5] and got["run"] == [4] and got["日本語"] == [8] and "2" in got and "the" not in got


def test_index_is_changed_by_segments(spark, tmp_path):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)] + ["things", "thing", "running"]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(40)))
    now = {i: text() for i in range(200)}
    frame = lambda rows: spark.createDataFrame(list(rows.items()), "id long, content string")
    index = PostingsIndex(spark, str(tmp_path / "index"), buckets=5, spread=2).write(frame(now), 0)
    for segment in (1, 2):
        change = {i: text() for i in rng.sample(range(200), 40)} | {1000 + segment: "w1 thing"} | {i: None for i in rng.sample(range(200), 10)}
        now |= change
        index.write(frame(change), segment)
        index.write(frame(change), segment)  # again, as after a failure
    for asked in ("thing", "w1 w2", "running things w3", "nowhere thing", "the"):
        terms = english.query_terms(asked)
        want = {r["id"]: r["keyword_score"] for r in search.keyword_matches(frame(now), terms).collect()}
        assert {r["id"]: r["keyword_score"] for r in index.matches(terms).collect()} == want
        assert set(want) == {i for i, t in now.items() if terms and all(x in postings.lexemes(t or "") for x in terms)}
    found = index.matches(["thing", "w1"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters")[1].split("]")[0] and "In(lexeme" in plan
