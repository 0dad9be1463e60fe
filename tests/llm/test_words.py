import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from palimp.llm.words import grams, slices, text_buffer, words


def _plain(texts, commands):
    out = []
    for i, t in enumerate(texts):
        t = t or ""
        if commands:
            t = re.sub(r"\\[A-Za-z]+", " ", t)
        out += [(i, w) for w in re.findall("[a-z0-9]+", "".join(c.lower() if c.isascii() else c for c in t))]
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("abZ9 \\.é日", max_size=30)), max_size=8), st.booleans())
def test_words_as_by_pattern(texts, commands):
    raw, offsets = text_buffer(pa.array(texts, pa.string()))
    h, text, length = words(raw, offsets, commands)
    want = _plain(texts, commands)
    assert text.tolist() == [i for i, _ in want]
    assert length.tolist() == [len(w) for _, w in want]
    by = {}
    for (_, w), x in zip(want, h.tolist()):
        assert by.setdefault(w, x) == x
    assert len(set(by.values())) == len(by)
    g, gt, at = grams(h, text, 2)
    assert len(g) == sum(a[0] == b[0] for a, b in zip(want, want[1:]))
    assert (text[at] == gt).all()


def test_slices_cover_all():
    offsets = np.array([0, 5, 5, 30, 31, 32])
    assert list(slices(offsets, 10)) == [(0, 2), (2, 3), (3, 5)]
    assert list(slices(np.array([0]))) == []
