"""Pixel kernels and folds against plain loops."""

import numpy as np
import pytest

from storeyline.operators import classify, pixels, raster


def around(m, y, x):
    """From the east, against the clock."""
    h, w = m.shape
    return [bool(0 <= y + dy < h and 0 <= x + dx < w and m[y + dy, x + dx]) for dy, dx in ((0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1))]


def slow_thin(mask):
    m = mask.copy()
    while True:
        before = m.sum()
        for half in (1, 2):
            gone = []
            for y, x in zip(*np.nonzero(m)):
                p = [None, *around(m, y, x)]  # p[1] .. p[8] as in the survey
                q = lambda i: p[(i - 1) % 8 + 1]  # noqa: B023, E731
                crossing = sum(not q(2 * i - 1) and (q(2 * i) or q(2 * i + 1)) for i in range(1, 5))
                n1, n2 = sum(q(2 * i - 1) or q(2 * i) for i in range(1, 5)), sum(q(2 * i) or q(2 * i + 1) for i in range(1, 5))
                third = (q(2) or q(3) or not q(8)) and q(1) if half == 1 else (q(6) or q(7) or not q(4)) and q(5)
                if crossing == 1 and 2 <= min(n1, n2) <= 3 and not third:
                    gone.append((y, x))
            for y, x in gone:
                m[y, x] = False
        if m.sum() == before:
            return m


@pytest.mark.parametrize("seed", range(6))
def test_thin(seed):
    r = np.random.default_rng(seed)
    m = raster.thin(np.zeros((3, 3), bool))
    assert not m.any()
    m = pixels.dilated(r.random((25, 30)) < 0.06, 3, 3)
    assert (raster.thin(m) == slow_thin(m)).all()
    line = np.zeros((24, 24), bool)
    for i in range(20):
        line[i + 2, i + 1 : i + 3] = True
    assert raster.thin(line).sum() >= 16 and raster.thin(np.ones((2, 2), bool)).sum() == 1


def test_windows_and_distances():
    r = np.random.default_rng(0)
    for _ in range(20):
        a = r.random((13, 17)) < 0.7
        ky, kx = map(int, r.integers(1, 6, 2))

        def least(m, oy, ox):
            out = np.ones_like(m)
            for y, x in np.ndindex(*m.shape):
                own = m[max(0, y - oy) : max(0, y - oy + ky), max(0, x - ox) : max(0, x - ox + kx)]
                out[y, x] = own.all()
            return out

        eroded = least(a, ky // 2, kx // 2)
        assert (pixels.eroded(a, ky, kx) == eroded).all()
        assert (pixels.opened(a, ky, kx) == ~least(~eroded, ky - 1 - ky // 2, kx - 1 - kx // 2)).all()
        zeros = np.argwhere(~a)
        want = [[0 if not a[y, x] else np.hypot(*(zeros - (y, x)).T).min() for x in range(17)] for y in range(13)]
        assert np.allclose(pixels.distance(a), want)


def test_components_and_ground():
    m = np.zeros((12, 12), bool)
    m[2:10, 2:10] = True
    m[4:8, 4:8] = False
    m[5, 2:4] = False  # a gap of one
    label, table = pixels.components(m)
    assert len(table) == 1 and table["area"][0] == int(m.sum()) == int((label == 1).sum())
    assert pixels.covered(m, 3)[5, 5] and pixels.covered(m, 3).sum() == 64
    assert pixels.components(np.zeros((3, 3), bool))[1].empty


def slow_run(at, least, most):
    best = []
    for i in range(len(at)):
        run, step = [i], None
        for j in range(i + 1, len(at)):
            gap = at[j] - at[run[-1]]
            if gap < least:
                continue
            if gap > most or (step and abs(gap - step) > 0.25 * step):
                break
            step = step or gap
            run.append(j)
        best = max(best, run, key=len)
    return best


def test_regular_runs():
    r = np.random.default_rng(1)
    for _ in range(300):
        at = np.sort(np.round(r.random(int(r.integers(0, 15))) * 60, 1))
        assert len(classify.regular_run(at, 2.0, 12.0)) == len(slow_run(at, 2.0, 12.0))
        assert classify.regular_run(at, 2.0, 12.0).tolist() == slow_run(at, 2.0, 12.0)


def test_traced_lines_meet_at_the_junction():
    m = np.zeros((60, 120), bool)
    m[30:32, 10:110], m[10:30, 60:62] = True, True
    found = [e[1:5] for e in pixels.traced(m) if e[0] == "line"]
    ends = [p for a, b, c, d in found for p in ((round(a, 1), round(b, 1)), (round(c, 1), round(d, 1)))]
    assert max(ends.count(e) for e in ends) >= 3 and pixels.traced(np.zeros((5, 5), bool)) == []
