"""Language, toxicity and personal data: held-out accuracy, grammar cases, brute-force spans."""

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lectern.llm import pii, q_op2, q_op8, q_op9
from lectern.llm.language_id import fit_language_model, identify_language, presence
from lectern.llm.toxicity import GRAMMAR, Lexicon, Scorer, fit_toxicity, score_toxicity
from pyspark.sql import functions as F

from .fixtures import awkward, empty

SF = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas().set_index("doc_id")["lang"]
    out = q_op2.op2_language_id(spark, SF).toPandas()
    assert len(out) == len(docs)
    assert (out["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in out["doc_id"]]).all()
    held = out[out["held_out"]]
    assert (held["lang_pred"].to_numpy() == docs[held["doc_id"]].to_numpy()).mean() > 0.98
    assert out["score"].between(0, 1).all()


def test_presence_is_a_set_of_whole_grams():
    a, b = presence(pa.array(["abab", "ab", "ABAB", None, "bé"]), width=4096), presence(pa.array(["abab"]), width=4096)
    assert (a[0] == b[0]).all() and (a[0] == a[2]).all() and a[3].sum() == 0
    assert a[1].sum() == 3 and (a[1] <= a[0]).all()


def test_language_awkward(spark):
    docs = awkward(spark)
    got = {r["doc_id"]: r["lang_pred"] for r in identify_language(docs, F.lit(True)).collect()}
    assert len(got) == docs.count()
    assert got[4] == got[5] == got[6] == "und"
    assert got[0] == got[1]
    assert identify_language(empty(spark), F.lit(True)).count() == 0
    assert {r["lang_pred"] for r in identify_language(docs, F.lit(False)).collect()} == {"und"}


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"  # smaller tables hold out six toxic rows, too few to tell
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    out = q_op9.op9_toxicity(spark, sf).toPandas()
    assert (out["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in out["doc_id"]]).all()
    held = out[out["held_out"]].merge(labels, on="doc_id")
    tp = ((held["predicted"] == 1) & (held["toxic"] == 1)).sum()
    assert tp / max(1, (held["toxic"] == 1).sum()) >= 0.9
    assert ((held["predicted"] == 1) & (held["toxic"] == 0)).sum() <= 0.01 * len(held)


def written(symbols):
    state, out = 0, []
    for s in symbols:
        state, w = GRAMMAR[state, s]
        out.append(w)
    return out


def test_grammar():
    assert written("oi.") == ["o", "i", "."]
    assert written("toi") == ["o", "o", "it"]
    assert written("iot") == ["i", "o", "itl"]
    assert written("noi") == ["o", "o", "in"]
    assert written("nooooi")[-1] == "i"
    assert written("roti")[-1] == "iq"
    assert written("r.i")[-1] == "i"
    assert written("h.")[0] == "o" and written("th")[-1] == "ht" and written("ht")[-1] == "htl"


def test_scorer_reads_clauses():
    scorer = Scorer(Lexicon(weights={"idiot": 3.0}, known={"idiotic": 0.0}))
    plain, targeted, negated = (scorer.features(t) for t in ("an idiots tale", "you idiots", "not an idiots tale"))
    assert plain[0] > 0 and targeted[1] > 0 and negated[3] > 0
    assert not scorer.features("idiotic").any()
    assert not scorer.features(None).any()


def test_toxicity_learns_words_and_stems():
    rng = random.Random(0)
    clean = [" ".join(rng.choices(["red", "green", "blue", "house", "tree"], k=20)) for _ in range(200)]
    bad = [c + rng.choice([" you moron", " badstemxa now", " badstemyo now", " badstemze now"]) for c in clean[:80]]
    model = fit_toxicity(clean + bad, [0] * 200 + [1] * 80)
    scorer = Scorer(model.lexicon)
    s = model.score(np.array([scorer.features(t) for t in ("blue moron", "badstemqq tree", "green tree")]))
    assert s[0] > 0.5 and s[1] > 0.5 and s[2] < 0.2


def test_toxicity_awkward(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(0, 1), (1, None), (2, 0), (2, 0), (99, 1), (10, 0)], "doc_id long, toxic int")
    out = score_toxicity(docs, labels, F.lit(True)).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out)
    assert {r["predicted"] for r in score_toxicity(docs, labels, F.lit(False)).collect()} == {0}
    assert score_toxicity(empty(spark), labels, F.lit(True)).count() == 0


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_luhn(s):
    d = [int(c) for c in s][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def plain_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(text) if 12 <= len(digits(m[0])) <= 19 and plain_luhn(digits(m[0]))]
    return out + [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]


@given(st.lists(st.sampled_from(["a@b.co", "@", ".", "-", "1.2.3.4", "255", "256", "+1", " ", "(", "4111 1111 1111 1111", "00", "7", "x", "é", "+49 30 123456", "--"]), max_size=14).map("".join))
@settings(max_examples=600, deadline=None)
def test_base_spans_are_those_of_the_patterns(text):
    assert sorted(pii.base_spans(text)) == sorted(plain_spans(text))


def test_base_spans_on_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {r["doc_id"]: sorted(plain_spans(r["text"]), key=lambda x: (x[1], x[0])) for r in docs}
    got = {r["doc_id"]: r for r in q_op8.op8_pii(spark, SF).collect()}
    for d, spans in want.items():
        listed = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in spans)
        assert got[d]["base_sha256"] == __import__("hashlib").sha256(listed.encode()).hexdigest()
        assert [got[d][f"n_{k}"] for k in pii.BASE_KINDS] == [sum(s[0] == i for s in spans) for i in range(4)]


def test_long_texts_take_linear_time():
    for text in ("1" * 200_000, "a" * 200_000, "a@" * 100_000, "1." * 100_000, "1 " * 100_000, "+1" + "(" * 100_000):
        pii.base_spans(text)


def test_em_finds_the_reliable_labelers():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.3
    good = lambda p: np.where(rng.random(4000) < p, truth, ~truth) * 2
    votes = np.stack([good(0.95), good(0.9), good(0.85), good(0.55)], axis=1)
    pattern, inverse, count = np.unique(votes @ [27, 9, 3, 1], return_inverse=True, return_counts=True)
    p, theta = pii.reliabilities(np.zeros(len(pattern), int), pattern, count.astype(float))
    assert ((p[inverse] > 0.5) == truth).mean() > 0.93
    assert theta[1, 0, 2] > 0.9 and theta[1, 3, 2] < 0.7


def test_pii_awkward(spark):
    docs = awkward(spark)
    assert len(pii.find_pii(docs).collect()) == docs.count()
    assert pii.find_pii(empty(spark)).count() == 0
    cases = spark.createDataFrame([(1, "Call Dr. Jane Roe, mail jane@x.org or +1 (555) 555-0100"), (1, None)], "doc_id long, text string")
    spans = [s for r in pii.find_pii(cases).collect() for s in r["spans"]]
    assert {"email", "phone"} <= {s["kind"] for s in spans}


@pytest.mark.parametrize("text", ["@@", "a@b", "a@b.c@d.e", ".@b.c", "a@-.-"])
def test_email_edges(text):
    assert sorted(x for x in pii.base_spans(text) if x[0] == 0) == sorted(x for x in plain_spans(text) if x[0] == 0)


def test_language_of_texts_of_megabytes():
    """Distinct held-out texts of one language, joined to 4 MB (said again where the table has fewer), and short texts."""
    held = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text", "lang"]).to_pylist()
    by_lang = defaultdict(list)
    for r in held:
        if r["lang"] and r["text"]:
            by_lang[r["lang"]].append(r["text"])
    train = [(t, lang) for lang, texts in by_lang.items() for t in texts[:500]]
    model = fit_language_model([t for t, _ in train], [lang for _, lang in train])
    rng = np.random.default_rng(7)
    for lang, texts in by_lang.items():
        body = "\n".join(texts[500:])
        while len(body) < 8_000_000:  # with words of no language, as ids and names are
            body += "\n" + " ".join(f"{t} {rng.integers(1 << 40):x}" for t in texts[500:])
        long = pa.array([body[:4_000_000], body[:8_000_000], texts[500]])
        assert [model.languages[k] for k in model.scores(long).argmax(axis=1)] == [lang] * 3


def test_scores_are_those_of_the_kernel():
    """With every text a landmark, Nystroem features give the exact kernel ridge regression."""
    rng = random.Random(6)
    words = {"xx": "alpha beta gamma delta".split(), "yy": "rho sigma tau upsilon".split(), "zz": "eins zwei drei vier".split()}
    rows = [(" ".join(rng.choices(w, k=6)), lang) for lang, w in words.items() for _ in range(12)]
    texts, langs = [t for t, _ in rows], [lang for _, lang in rows]
    model = fit_language_model(texts, langs, landmarks=len(rows))
    unit = lambda t: (lambda x: x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1)))(presence(pa.array(t)).astype(float))
    seen = ["alpha tau zwei", "drei drei vier eins", "gamma rho", "q"]
    kernel, across = unit(texts) @ unit(texts).T, unit(seen) @ unit(texts).T
    y = np.where(np.array(langs)[:, None] == np.array(model.languages)[None, :], 1.0, -1.0)
    mean = y.mean(axis=0)
    # ridge regression in the features of K is (K + c) a = y on the span of K
    exact = across @ np.linalg.pinv(kernel, hermitian=True, rcond=1e-6) @ kernel @ np.linalg.solve(kernel + 1e-2 * len(rows) / 100 * np.eye(len(rows)), y - mean) + mean
    raw = np.log(model.scores(pa.array(seen))) / model.temperature
    assert np.allclose(raw - raw[:, :1], exact - exact[:, :1], atol=2e-3)


def test_added_spans_by_kind(spark):
    """Planted spans that no base pattern has, among look-alikes: precision and recall of each kind."""
    rng = random.Random(13)
    names, filler = ["Jane Roe", "Karl Meier", "Eva Lopez", "Luc Petit"], "the model was run again and the table shows what came out of it".split()
    rows, truth = [], []
    for i in range(400):
        words = " ".join(rng.choices(filler, k=12))
        kind = i % 8
        hexed = "".join(rng.choices("0123456789abcdef", k=40))
        span = {0: f"{rng.choice(['Dr.', 'Mrs.', 'Prof.'])} {rng.choice(names)}", 1: hexed, 2: f"{rng.randrange(100, 999)}-{rng.randrange(100, 999)}-{rng.randrange(1000, 9999)}"}.get(kind)
        text = {0: f"{words} said {span} yesterday.", 1: f'{words} token = "{span}" {words}', 2: f"{words} my phone {span} or mail.", 3: f"{words} in version 12.4.11 of it.", 4: f"{words} see page 12-15 and figure 33.", 5: f"{words} path: abc/def1/ghi/jkl/mno {words}", 6: f"{words} section 44-12 order.", 7: words}[kind]
        if span:
            truth.append((i, {0: "person", 1: "secret", 2: "number"}[kind], text.index(span), text.index(span) + len(span)))
        rows.append((i, text))
    got = {(r["doc_id"], s["kind"], s["start"], s["end"]) for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect() for s in r["spans"] if not s["base"]}
    for kind in ("person", "secret", "number"):
        mine, want = {x for x in got if x[1] == kind}, {x for x in truth if x[1] == kind}
        assert len(mine & want) >= 0.9 * len(want), (kind, "recall")
        assert len(mine & want) >= 0.9 * len(mine), (kind, "precision")


def test_planted_secrets_of_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {(r["doc_id"], m.start(1), m.end(1)) for r in docs for m in re.finditer(r'token = "([0-9a-f]{40})"', r["text"] or "")}
    got = {(r["doc_id"], *(int(x) for x in s.split(":")[1:])) for r in q_op8.op8_pii(spark, SF).collect() for s in r["spans"].split(",") if s.startswith("secret:")}
    assert want and len(got & want) >= 0.95 * len(want) and len(got & want) >= 0.9 * len(got)
