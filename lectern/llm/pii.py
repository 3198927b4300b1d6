"""Personal data: labelers vote on candidate spans, expectation-maximisation weighs the votes, a classifier decides.

One pass over the texts finds candidate spans (the strict base spans and looser ones), the votes on each of four labelers
that look at different things (the characters around the span, its inner structure, a gazetteer, the words before it), and
hashed features of the span and its surroundings.  Votes are counted by (kind, vote pattern) over the whole corpus: that table
has at most KINDS x 3**4 rows whatever the corpus' size, so expectation-maximisation over it runs on the driver.  It
estimates, without labels, how often each labeler is right.  Its probabilities are the targets of a logistic span classifier
over the features (not the votes), fitted on a bounded sample of each kind's spans, which then keeps or drops every
looser span.  Base spans always stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, only, sample_by_class, written
from .words import text_slices

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "handle", "number", "person", "secret")

# fixed values: gazetteers and context cues of the four languages
TOP_DOMAINS = {"com", "org", "net", "edu", "gov", "io", "info", "de", "fr", "es", "uk", "eu"}
CALLING_CODES = ("1", "33", "34", "44", "49")
TITLES = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Mme", "Mlle", "Sr", "Sra", "Monsieur", "Madame")
PERSONAL_CUES = ("mail", "contact", "phone", "call", "tel", "mobile", "fax", "card", "visa", "iban", "ssn", "passport", "address", "name", "telefon", "anruf", "adresse", "kontakt", "karte", "correo", "contacto", "tarjeta", "courriel", "carte", "ip")
SECRET_CUES = ("token", "secret", "key", "password", "passwd", "passwort", "pwd", "apikey", "bearer", "credential", "contraseña")
SECRET_HEADS = ("AKIA", "ghp_", "sk-", "eyJ", "xox")
DIGEST_LENGTHS = (32, 40, 64)
OTHER_CUES = ("version", "isbn", "page", "figure", "table", "order", "section", "license", "token", "port", "seite", "kapitel", "bild", "página", "número de pedido")

_DIGIT_OR_AT = re.compile(r"[0-9@]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# a match can only start where its run of digits does, so each text is read once however long its runs are
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_HANDLE = re.compile(r"(?<![A-Za-z0-9@._%+-])@[A-Za-z][A-Za-z0-9_]{2,29}(?![A-Za-z0-9_@.])")
_NUMBER = re.compile(r"(?<![0-9])[0-9]{2,6}(?:[ ./-][0-9]{2,6}){1,5}(?![0-9])")
_PERSON = re.compile(r"\b(?:" + "|".join(TITLES) + r")\.? [A-ZÀ-Ý][^\W\d_]+(?: [A-ZÀ-Ý][^\W\d_]+)?")
_SECRET = re.compile(r"[:=][ \t]{0,3}[\"']?([A-Za-z0-9+/_-]{12,})(?![A-Za-z0-9+/_.@-])")
_WORD = re.compile(r"[^\W\d_]+")
FEATURES = 1 << 12


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the strict spans: leftmost, non-overlapping for each kind, failing matches dropped."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((0, start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(map(_octet, m[0].split("."))):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((3, *m.span()))
    return out


def loose_spans(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans that the base formats miss and the labelers are to judge; none overlaps a span of ``taken``."""
    found = [(KINDS.index(k), *m.span()) for k, p, on in (("handle", _HANDLE, "@" in text), ("number", _NUMBER, True), ("person", _PERSON, any(t in text for t in TITLES))) if on for m in p.finditer(text)]
    if "=" in text or ":" in text:
        found += [(KINDS.index("secret"), *m.span(1)) for m in _SECRET.finditer(text) if any(c.isdigit() for c in m[1]) and any(c.isalpha() for c in m[1])]
    spans, out, i, reach = sorted((s, e) for _, s, e in taken), [], 0, 0
    for kind, start, end in sorted(found, key=lambda x: (x[1], -x[2])):
        while i < len(spans) and spans[i][0] < end:
            reach = max(reach, spans[i][1])
            i += 1
        if start >= reach:
            out.append((kind, start, end))
            reach = end
    return out


def _edges(before: str, after: str) -> int:
    """Whether a span stands free: blanks, brackets, quotes or a sentence's end around it, and no longer run of letters and digits."""
    free = (not before or before[-1] in " \t\r\n(<[\"'=:,;|") + (not after or after[0] in " \t\r\n)>]\"',;:|" or after[:2] in (". ", ".\n", ".", "! ", "? "))
    return 2 if free == 2 else 1 if free else 0


def _structure(name: str, span: str, digits: str) -> int:
    if name == "card":
        return 2 if luhn(digits) and len(set(digits)) > 3 else 0
    if name in ("phone", "number"):
        return 2 if 9 <= len(digits) <= 15 and re.search(r"[0-9]{3,4}[ .-][0-9]{4}$", span) else 1 if 7 <= len(digits) <= 15 else 0
    if name == "ip":
        return 2 if not span.startswith(("0.", "255.")) else 0
    if name == "email":
        return 2 if 6 <= len(span) <= 254 and ".." not in span else 0
    if name == "secret":
        turns = sum(a.isdigit() != b.isdigit() for a, b in zip(span, span[1:]))
        return 2 if len(span) >= 16 and turns >= len(span) // 8 and "/" not in span else 1 if turns > 2 else 0
    return 2 if name == "person" and len(span.split()) > 2 else 1


def _gazetteer(name: str, span: str) -> int:
    if name == "email":
        return 2 if span.rsplit(".", 1)[-1].lower() in TOP_DOMAINS else 0
    if name == "phone":
        return 2 if span[1:].startswith(CALLING_CODES) else 0
    if name == "person":
        return 2 if span.split()[0].rstrip(".") in TITLES else 0
    if name == "secret":
        hexed = len(span) in DIGEST_LENGTHS and all(c in "0123456789abcdef" for c in span.lower())
        return 2 if hexed or span.startswith(SECRET_HEADS) else 1
    return 1


def votes(text: str, kind: int, start: int, end: int) -> int:
    """The four labelers' votes (0 against, 1 abstains, 2 for) as a number in base 3: edges, structure, gazetteer, context."""
    span, before, after = text[start:end], text[max(0, start - 40) : start], text[end : end + 2]
    name = KINDS[kind]
    digits = "".join(c for c in span if c in "0123456789")
    words = [w.lower() for w in _WORD.findall(before)][-5:]
    if name == "secret":
        personal, other = any(w.startswith(c) or w.endswith(c) for w in words[-2:] for c in SECRET_CUES), any(w.startswith(c) for w in words[-2:] for c in OTHER_CUES if c != "token")
    else:
        personal = any(w.startswith(c) for w in words for c in PERSONAL_CUES if len(c) > 2 or w == c)
        other = any(w.startswith(c) for w in words for c in OTHER_CUES)
    context = 2 if personal and not other else 0 if other and not personal else 1
    return ((_edges(before, after) * 3 + _structure(name, span, digits)) * 3 + _gazetteer(name, span)) * 3 + context


def _outline(span: str) -> str:
    """Runs of digits as 0, of letters as a or A, other characters as they are."""
    out = []
    for c in span[:64]:
        k = "0" if c.isdigit() else ("A" if c.isupper() else "a") if c.isalpha() else c
        if not out or out[-1] != k or not k.isalnum():
            out.append(k)
    return "".join(out)[:24]


def features(text: str, kind: int, start: int, end: int) -> list[int]:
    """Hashed features of a span and its surroundings: outline, length, ends, words before and after, all with its kind."""
    span, name = text[start:end], KINDS[kind]
    before, after = _WORD.findall(text[max(0, start - 40) : start])[-3:], _WORD.findall(text[end : end + 24])[:1]
    parts = ["", "o" + _outline(span), f"l{min(len(span) // 4, 16)}", "h" + span[:2].lower(), "t" + span[-3:].lower(), "c" + text[max(0, start - 1) : start], "d" + text[end : end + 1]]
    parts += ["b" + w.lower()[:6] for w in before] + ["a" + w.lower()[:6] for w in after]
    return sorted({crc32(f"{name}|{p}".encode()) % FEATURES for p in parts})


_SPANS_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("pattern", pa.int32()), ("features", pa.list_(pa.int32()))]))
_SPANS_DDL = "doc_id long, found array<struct<start:long,kind:int,end:long,pattern:int,features:array<int>>>"


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_slices(batch):
            rows = []
            for text in column(part, "text").to_pylist():
                found = []
                if text and (_DIGIT_OR_AT.search(text) or any(t in text for t in TITLES)):
                    base = base_spans(text)
                    for kind, start, end in base + loose_spans(text, base):
                        found.append({"start": start, "kind": kind, "end": end, "pattern": votes(text, kind, start, end), "features": features(text, kind, start, end)})
                    found.sort(key=lambda x: (x["start"], x["kind"], x["end"]))
                rows.append(found)
            yield pa.RecordBatch.from_arrays([column(part, "doc_id"), pa.array(rows, type=_SPANS_TYPE)], names=["doc_id", "found"])


def _digits3(pattern: np.ndarray) -> np.ndarray:
    return np.stack([pattern // 27 % 3, pattern // 9 % 3, pattern // 3 % 3, pattern % 3], axis=1)


def reliabilities(kind: np.ndarray, pattern: np.ndarray, count: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Two-class expectation-maximisation over counted vote patterns.

    Returns P(personal) for each row and theta[class, labeler, vote].  It starts from the majority of the votes, so the
    class that the votes favour is the personal one; kinds have priors of their own.
    """
    v = _digits3(pattern)
    p = 1 / (1 + np.exp(-(v - 1).sum(axis=1).astype(float)))
    theta = np.full((2, 4, 3), 1 / 3)
    for _ in range(rounds):
        prior = np.array([((count * p)[kind == k].sum() + 1) / (count[kind == k].sum() + 2) if (kind == k).any() else 0.5 for k in range(len(KINDS))])
        for c, w in enumerate((count * (1 - p), count * p)):
            for j in range(4):
                seen = np.bincount(v[:, j], weights=w, minlength=3) + 1
                theta[c, j] = seen / seen.sum()
        logit = np.log(prior[kind]) - np.log1p(-prior[kind])
        for j in range(4):
            logit += np.log(theta[1, j, v[:, j]]) - np.log(theta[0, j, v[:, j]])
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return p, theta


def train_span_classifier(rows: list[list[int]], target: np.ndarray, rounds: int = 300, ridge: float = 1e-3) -> np.ndarray:
    """Weights of the hashed features, by logistic regression (accelerated gradient steps) on the probabilities that EM gives."""
    entry = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    place = np.concatenate([np.asarray(r, dtype=np.int64) for r in rows]) if rows else np.zeros(0, np.int64)
    weights, ahead = np.zeros(FEATURES), np.zeros(FEATURES)
    rate = 4.0 / max(1, max((len(r) for r in rows), default=1))
    for k in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(entry, weights=ahead[place], minlength=len(rows)), -30, 30)))
        gradient = np.bincount(place, weights=(p - target)[entry], minlength=FEATURES) / max(1, len(rows)) + ridge * ahead
        new = ahead - rate * gradient
        ahead, weights = new + k / (k + 3) * (new - weights), new
    return weights


def find_pii(docs: DataFrame, least: float = 0.5, spans_of_kind: int = 2000) -> DataFrame:
    """Personal data in every whole text: doc_id, spans (array of start, kind, end, base), in order of start and kind.

    Offsets are code points, end exclusive.  Spans of the four base kinds always stay; the others stay where the span
    classifier gives ``least`` or more.  ``spans_of_kind`` bounds the spans of each kind that the classifier is fitted on; votes
    are counted over all.  Null and empty texts have no spans; each row that repeats a doc_id, or has none, is judged by
    itself.  Extra columns are ignored; an empty table gives an empty result.
    """
    found = written(only(docs, "doc_id", "text").mapInArrow(_find, _SPANS_DDL), "pii_candidates")
    spans = found.select("doc_id", F.explode("found").alias("s")).select("doc_id", "s.*")
    table = np.array([tuple(r) for r in spans.groupBy("kind", "pattern").count().orderBy("kind", "pattern").collect()], dtype=np.int64).reshape(-1, 3)
    weights = np.zeros(FEATURES)
    if len(table):
        p, _ = reliabilities(table[:, 0], table[:, 1], table[:, 2].astype(float))
        chance = {(k, v): q for (k, v, _), q in zip(table.tolist(), p.tolist(), strict=True)}
        taught = sample_by_class(spans.select("doc_id", "start", "kind", "pattern", "features"), "kind", spans_of_kind).orderBy("kind", "doc_id", "start").collect()
        weights = train_span_classifier([r["features"] for r in taught], np.array([chance[r["kind"], r["pattern"]] for r in taught]))
    spread = F.split(F.lit(",".join(map(repr, weights.tolist()))), ",").cast("array<double>")  # folded into one constant
    bar = float(np.log(least / (1 - least))) if 0 < least < 1 else (-np.inf if least <= 0 else np.inf)

    def stays(s):
        score = F.aggregate(s["features"], F.lit(0.0), lambda total, f: total + F.get(spread, f))
        return (s["kind"] < len(BASE_KINDS)) | (score >= bar)

    names = F.array(*(F.lit(k) for k in KINDS))
    spans_of = F.transform(F.filter("found", stays), lambda s: F.struct(s["start"].alias("start"), F.get(names, s["kind"]).alias("kind"), s["end"].alias("end"), (s["kind"] < len(BASE_KINDS)).alias("base")))
    return found.select("doc_id", spans_of.alias("spans"))
