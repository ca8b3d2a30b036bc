import numpy as np
import pytest

from siltstone.llm.fmindex import FMIndex, suffix_array


@pytest.mark.parametrize("n, symbols", [(0, 3), (1, 3), (5, 3), (50, 4), (700, 6), (700, 300)])
def test_against_plain_search(n, symbols):
    rng = np.random.default_rng(n)
    s = rng.integers(1, symbols, n).astype(np.uint16)
    text = [*s.tolist(), 0]
    assert suffix_array(np.r_[s, np.uint16(0)]).tolist() == sorted(range(n + 1), key=lambda i: text[i:])
    fm = FMIndex.load(FMIndex.build(s, symbols).dump())
    for _ in range(50):
        p = rng.integers(1, symbols, rng.integers(1, 4))
        lo, hi = fm.start(p[-1:])
        for c in p[-2::-1]:
            lo, hi = fm.step(np.array([c]), lo, hi)
        got = sorted(fm.locate(np.arange(lo[0], hi[0])).tolist())
        assert got == [i for i in range(n) if text[i : i + len(p)] == p.tolist()]


def test_long_repeats():
    s = np.tile(np.array([2, 3, 2, 2], dtype=np.uint16), 400)
    text = [*s.tolist(), 0]
    assert suffix_array(np.r_[s, np.uint16(0)]).tolist() == sorted(range(len(text)), key=lambda i: text[i:])
