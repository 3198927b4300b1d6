"""Small tables with every awkward case: nulls, blanks, ties, repeated rows, clashing columns, long texts."""

import random

DDL = "doc_id long, text string, lang string, source string, n_chars long, anchor long, rep long, component string, digest string, score double, bucket int"


def sentence(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon".split()) + str(rng.randrange(60)) for _ in range(n))


def awkward(spark, rng=None):
    rng = rng or random.Random(3)
    base, part = sentence(rng, 60), sentence(rng, 25)
    texts = [base, base, base.replace(" ", "  \n", 3), base.rsplit(" ", 1)[0] + " changed", None, "", " \t\n ", "one", "one two three", "one two three", part + " " + sentence(rng, 30), sentence(rng, 10) + " " + part,
             "loop " * 70, sentence(rng, 3000), "日本語 テキスト", "x" * 50_000, "🙂 emoji", "\x1f odd blank"]
    rows = [(i, t, [None, "en", "fr"][i % 3], [None, "s1", "s2"][i % 3], len(t or ""), 1, 1, "c", "d", 0.5, 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DDL)


def empty(spark):
    return spark.createDataFrame([], DDL)
