"""Language identification: blended-spectrum presence kernels, Nystroem landmarks, one-versus-rest kernel ridge.

A text is the set of its character-byte n-grams of lengths 1 to ``longest`` (presence, not counts), hashed to ``width``
places; K(x, y) is the cosine of two such sets.  The model keeps a bounded sample of labelled texts for training and, of
those, ``landmarks`` texts to span the Nystroem features K(x, L) K(L, L)^-1/2, on which one ridge regressor per language
is fitted.  Scoring folds all of that into one matrix: presence (rows x width) times weights (width x languages), so a
slice of texts is scored by one matrix product.  Long texts would fill all places, so the score of a text is the mean over
consecutive windows of ``WINDOW`` bytes at most, which cover all of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from .common import column, only, sample_by_class
from .words import text_bytes, text_slices

WIDTH, LONGEST, WINDOW = 1 << 13, 4, 1 << 16
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def presence(texts: pa.Array, width: int = WIDTH, longest: int = LONGEST) -> np.ndarray:
    """rows x width 0/1 matrix of the hashed n-grams in each text (ASCII case folded)."""
    return _presence(*text_bytes(texts), width, longest)


def _presence(data: np.ndarray, offsets: np.ndarray, width: int, longest: int = LONGEST) -> np.ndarray:
    data = _LOWER[data]
    out = np.zeros((len(offsets) - 1, width), dtype=np.uint8)
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int64), np.diff(offsets)) * width
    flat, gram = out.reshape(-1), np.zeros(len(data), dtype=np.uint32)
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(data))  # bytes to the text's end
    for n in range(1, longest + 1):
        gram = gram[: len(data) - n + 1] * np.uint32(257) + data[n - 1 :] + np.uint32(1)
        if not len(gram):
            break
        place = ((gram * np.uint32(2654435761)) >> np.uint32(16)) % np.uint32(width)
        inside = left[: len(gram)] >= n
        flat[(row[: len(gram)] + place)[inside]] = 1
    return out


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    weights: np.ndarray  # width x languages
    bias: np.ndarray
    temperature: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        """rows x languages, each row a distribution."""
        data, offsets = text_bytes(texts)
        windows = np.maximum(-(-np.diff(offsets) // WINDOW), 1)
        first = np.cumsum(windows) - windows
        text = np.repeat(np.arange(len(texts)), windows)
        inside = np.arange(len(text)) - first[text]
        cuts = np.append(offsets[text] + np.diff(offsets)[text] * inside // windows[text], offsets[-1])  # of even length
        raw = np.zeros((len(texts), self.weights.shape[1]), dtype=np.float64)
        for at in range(0, len(text), 1 << 12):
            some = slice(at, min(at + (1 << 12), len(text)))
            bounds = cuts[at : some.stop + 1]
            sets = _presence(data[bounds[0] : bounds[-1]], bounds - bounds[0], self.weights.shape[0]).astype(np.float32)
            norms = np.sqrt(np.maximum(sets.sum(axis=1, keepdims=True), 1))
            np.add.at(raw, text[some], (sets @ self.weights) / norms)
        raw = raw / windows[:, None] + self.bias
        e = np.exp((raw - raw.max(axis=1, keepdims=True)) * self.temperature)
        return e / e.sum(axis=1, keepdims=True)


def fit_language_model(texts: list[str], langs: list[str], landmarks: int = 256, ridge: float = 1e-2) -> LanguageModel:
    return fit_presence_sets(presence(pa.array(texts)), langs, landmarks, ridge)


def fit_presence_sets(sets: np.ndarray, langs: list[str], landmarks: int = 256, ridge: float = 1e-2) -> LanguageModel:
    """The model from texts' presence sets, a row of 0 and 1 each."""
    languages = tuple(sorted(set(langs)))
    sets = sets.astype(np.float32)
    sets /= np.sqrt(np.maximum(sets.sum(axis=1, keepdims=True), 1))
    # landmarks: every language in turn, in the sample's order, so that a rare one has its share
    seen: dict[str, int] = {}
    turn = []
    for x in langs:
        turn.append(seen.get(x, 0))
        seen[x] = turn[-1] + 1
    order = sorted(range(len(langs)), key=lambda i: (turn[i], i))
    marks = sets[order[:landmarks]]
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    keep = values > 1e-6 * max(values.max(initial=0), 1e-12)
    root = vectors[:, keep] / np.sqrt(values[keep])
    z = (sets @ marks.T).astype(np.float64) @ root
    y = np.where(np.array(langs)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    mean = y.mean(axis=0)
    coef = np.linalg.solve(z.T @ z + ridge * len(langs) / 100 * np.eye(z.shape[1]), z.T @ (y - mean))
    return LanguageModel(languages, (marks.T.astype(np.float64) @ root @ coef).astype(np.float32), mean.astype(np.float32), 4.0)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: LanguageModel | None = model.value
        for batch in batches:
            for part in text_slices(batch, limit=1 << 20):
                texts = column(part, "text")
                known = np.array([t is not None and m is not None and has_letter(t) for t in texts.to_pylist()], dtype=bool)
                best, score = np.zeros(part.num_rows, dtype=np.int64), np.zeros(part.num_rows)
                if known.any():
                    rows = np.flatnonzero(known)
                    for at in range(0, len(rows), 256):
                        some = rows[at : at + 256]
                        p = m.scores(texts.take(pa.array(some)))
                        best[some], score[some] = p.argmax(axis=1), p.max(axis=1)
                names = [m.languages[b] if k else "und" for b, k in zip(best, known, strict=True)]
                yield pa.RecordBatch.from_arrays([column(part, "doc_id"), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The presence set of each text, a bit a place."""
    for batch in batches:
        for part in text_slices(batch, limit=1 << 20):
            sets = np.packbits(presence(column(part, "text")), axis=1)
            yield pa.RecordBatch.from_arrays([column(part, "doc_id"), column(part, "lang"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "lang", "bits"])


def identify_language(docs: DataFrame, labelled: Column, per_language: int = 500, landmarks: int = 256) -> DataFrame:
    """Predict the language of every whole text: doc_id, lang_pred, score (0 to 1).

    Learns from the text and lang of at most ``per_language`` rows of each language among those that ``labelled`` marks
    and whose text and lang are not null.  Texts that are null or have no letter are ``und`` with score 0, as are all
    texts where nothing is labelled.  Equal texts get equal answers; rows that repeat a doc_id, or have none, are judged each.  Extra columns are ignored; an empty table gives an
    empty result.
    """
    known = only(docs.withColumn("__known", labelled), "doc_id", "text", "lang", "__known").where("__known and lang is not null and text is not null")
    # a kilobyte a row, however long its text is
    rows = sample_by_class(known, "lang", per_language).mapInArrow(_packed, "doc_id long, lang string, bits binary").orderBy("doc_id", "lang", "bits").collect()
    sets = np.unpackbits(np.frombuffer(b"".join(bytes(r["bits"]) for r in rows), np.uint8).reshape(len(rows), -1), axis=1) if rows else None
    model = fit_presence_sets(sets, [r["lang"] for r in rows], landmarks) if rows else None
    shared = docs.sparkSession.sparkContext.broadcast(model)  # width x languages floats
    return only(docs, "doc_id", "text").mapInArrow(_predict(shared), "doc_id long, lang_pred string, score double")
