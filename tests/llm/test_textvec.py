import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tracklane.llm.textvec import Words, shingles, slices

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab AB\n\x0b\x1cé。 ", max_size=20)), max_size=12), st.integers(0, 3))
def test_words_and_shingles(texts, skip):
    column = pa.array(texts, pa.string())[min(skip, len(texts)) :]
    expected = [WORD.findall((t or "").translate(LOWER)) for t in column.to_pylist()]
    words = Words(column)
    assert words.counts.tolist() == [len(w) for w in expected]
    flat = [w for own in expected for w in own]
    assert [bytes(words.data[s:e]).decode() for s, e in zip(words.starts, words.ends, strict=True)] == flat
    seen = {}
    assert all(seen.setdefault(w, h) == h for w, h in zip(flat, words.hashes.tolist(), strict=True)) and len(set(seen.values())) == len(seen)
    values, at = shingles(words)
    for own, a, b in zip(expected, at[:-1], at[1:], strict=True):
        assert b - a == len(set(zip(own, own[1:])) if len(own) > 1 else set(own))
        assert (np.diff(values[a:b].astype(object)) > 0).all()


def test_slices_cover_all_rows():
    column = pa.array(["x" * 900_000, "", None, "y" * 3_000_000, "z"] * 3)
    ranges = list(slices(column))
    assert [r for a, b in ranges for r in range(a, b)] == list(range(15)) and list(slices(column.slice(0, 0))) == []
    assert all(b - a <= 2 for a, b in slices(column, 2))
