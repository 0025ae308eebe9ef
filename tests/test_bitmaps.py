from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.operators import bitmaps
from siltstone.operators.bitmaps import Bitmap

sets = st.one_of(st.sets(st.integers(0, 65535), max_size=50), st.builds(lambda a, n: set(range(a, min(65536, a + n))), st.integers(0, 65000), st.integers(0, 9000)), st.builds(lambda s: set(range(0, 65536, s)), st.integers(1, 9)))


@settings(max_examples=80, deadline=None)
@given(sets, sets)
def test_containers_are_sets(a, b):
    x, y = (bitmaps.compress(np.array(sorted(s), np.int64)) for s in (a, b))
    assert set(bitmaps.positions(x).tolist()) == a and bitmaps.count(x) == len(a)
    assert set(bitmaps.positions(bitmaps.and_not(x, y)).tolist()) == a - b
    assert set(bitmaps.positions(bitmaps.both(x, y)).tolist()) == a & b
    assert set(bitmaps.positions(bitmaps.either(x, y)).tolist()) == a | b
    assert len(x) <= 8193


@settings(max_examples=40, deadline=None)
@given(st.sets(st.integers(0, 1 << 40), max_size=200), st.sets(st.integers(0, 1 << 18), max_size=200))
def test_bitmaps_are_sets(a, b):
    x, y = (Bitmap.of(np.array(sorted(s), np.int64)) for s in (a, b))
    assert x.values().tolist() == sorted(a) and len(x) == len(a)
    assert x.and_not(y).values().tolist() == sorted(a - b)
    assert x.both(y).values().tolist() == sorted(a & b)
    assert x.either(y).values().tolist() == sorted(a | b)


@pytest.mark.parametrize(("values", "kind"), [(range(60000), bitmaps.RUNS), (range(0, 60000, 2), bitmaps.BITS), (range(0, 3000, 3), bitmaps.VALUES), ([], bitmaps.VALUES)])
def test_the_smallest_form_is_taken(values, kind):
    assert bitmaps.compress(np.array(list(values), np.int64))[:1] == kind
