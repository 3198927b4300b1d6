"""Vectorised words against a plain split."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from lectern.llm.words import Words, text_slices

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\t\x1f  日", max_size=30)), max_size=8)


@given(TEXTS)
@settings(max_examples=150, deadline=None)
def test_words_and_grams(texts):
    words = Words(pa.array(texts, pa.string()))
    split = [WORD.findall(t or "") for t in texts]
    assert words.counts.tolist() == [len(s) for s in split]
    assert [words.raw(i).decode() for i in range(len(words.starts))] == [w for s in split for w in s]
    flat = [w for s in split for w in s]
    named: dict = {}
    for w, h in zip(flat, words.hash.tolist()):
        assert named.setdefault(w, h) == h
    assert len(set(named.values())) == len(named)
    grams, seen = words.grams(2), {}
    for i in np.flatnonzero(words.whole(2)):
        assert seen.setdefault((flat[i], flat[i + 1]), grams[i]) == grams[i]
    assert len(set(seen.values())) == len(seen)


@given(TEXTS, st.integers(1, 40))
@settings(max_examples=50, deadline=None)
def test_slices_keep_all_rows(texts, limit):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])
    assert [t for s in text_slices(batch, limit=limit) for t in s.column(1).to_pylist()] == texts


def test_sliced_arrays_hash_alike():
    whole = pa.array(["zz top", "a b c", None, "a b c"])
    assert Words(whole.slice(1, 1)).hash.tolist() == Words(whole.slice(3, 1)).hash.tolist()
