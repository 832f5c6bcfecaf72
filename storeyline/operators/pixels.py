"""Pictures to masks, masks to walls, rooms and paths: numpy by plan, one plan's pixels in memory.

Grey pictures and masks travel as (plan_id, width, height, data), a byte a pixel. Rectangular opening
and closing count pixels in windows by cumulative sums, so their cost does not grow with the window.
Rules on what was measured are columns, in ``walls``."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from storeyline.operators.raster import MASKS, labelled, runs, simplify, thin

RECTS = "plan_id long, seq long, x0 double, y0 double, x1 double, y1 double, orient string"
RUNS = "plan_id long, label long, y int, xa int, xb int"


def picture(r) -> np.ndarray:
    return np.frombuffer(r.data, np.uint8).reshape(r.height, r.width)


def _each(table: DataFrame, made: Callable[..., pd.DataFrame | None], schema: str, *more: str) -> DataFrame:
    """``made`` of every row's picture (and further columns); rows without pixels give nothing."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                if r.data is not None and len(r.data):
                    out = made(picture(r), *(getattr(r, c) for c in more))
                    if out is not None and len(out):
                        yield out.assign(plan_id=r.plan_id)[[c.split()[0] for c in schema.split(", ")]]

    return table.select("plan_id", "width", "height", "data", *more).mapInPandas(run, schema)


def _mask_row(mask: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"width": [mask.shape[1]], "height": [mask.shape[0]], "data": [mask.astype(np.uint8).tobytes()]})


# -- windows


def _inked(mask: np.ndarray, ky: int, kx: int, outside: bool = False) -> np.ndarray:
    """The number of set pixels in the window of ky x kx around each pixel."""
    y, x = ky // 2, kx // 2
    m = np.pad(mask.astype(np.int64), ((y + 1, ky - 1 - y), (x + 1, kx - 1 - x)), constant_values=int(outside))
    m[0], m[:, 0] = 0, 0
    c = m.cumsum(0).cumsum(1)
    return c[ky:, kx:] - c[:-ky, kx:] - c[ky:, :-kx] + c[:-ky, :-kx]


def dilated(mask: np.ndarray, ky: int, kx: int) -> np.ndarray:
    return _inked(mask, ky, kx) > 0


def eroded(mask: np.ndarray, ky: int, kx: int) -> np.ndarray:
    """Pixels beyond the picture do not erode it."""
    return _inked(~mask, ky, kx) == 0


def opened(mask: np.ndarray, ky: int, kx: int) -> np.ndarray:
    return dilated(eroded(mask, ky, kx)[::-1, ::-1], ky, kx)[::-1, ::-1]


def closed(mask: np.ndarray, ky: int, kx: int) -> np.ndarray:
    return eroded(dilated(mask, ky, kx)[::-1, ::-1], ky, kx)[::-1, ::-1]


def distance(mask: np.ndarray) -> np.ndarray:
    """Euclidean distance of set pixels to the nearest one that is not set."""
    h, w = mask.shape
    far = float(h + w)
    up = np.zeros((h, w))
    for y in range(h):
        up[y] = np.where(mask[y], (up[y - 1] if y else far) + 1, 0)
    down = np.zeros((h, w))
    for y in range(h - 1, -1, -1):
        down[y] = np.where(mask[y], (down[y + 1] if y < h - 1 else far) + 1, 0)
    column = np.minimum(up, down) ** 2
    out, dx = column.copy(), 1
    while dx < w and dx * dx < out.max():
        out[:, dx:] = np.minimum(out[:, dx:], column[:, :-dx] + dx * dx)
        out[:, :-dx] = np.minimum(out[:, :-dx], column[:, dx:] + dx * dx)
        dx += 1
    return np.sqrt(out)


def components(mask: np.ndarray, diagonal: bool = False) -> tuple[np.ndarray, pd.DataFrame]:
    """(label of each pixel, table of label, area, left, top, width, height)."""
    r, label = labelled(mask, diagonal)
    out = np.zeros(mask.shape, np.int64)
    if not len(r):
        return out, pd.DataFrame({c: np.zeros(0, np.int64) for c in ("label", "area", "left", "top", "width", "height")})
    size = r[:, 2] - r[:, 1] + 1
    at = np.repeat(r[:, 0] * mask.shape[1] + r[:, 1] - np.cumsum(size) + size, size) + np.arange(size.sum())
    out.ravel()[at] = np.repeat(label, size)
    t = pd.DataFrame({"label": label, "area": size, "top": r[:, 0], "left": r[:, 1], "right": r[:, 2] + 1, "bottom": r[:, 0] + 1}).groupby("label", as_index=False).agg({"area": "sum", "left": "min", "top": "min", "right": "max", "bottom": "max"})
    return out, t.assign(width=t["right"] - t["left"], height=t["bottom"] - t["top"])


def kept(mask: np.ndarray, rule: Callable[[pd.DataFrame], pd.Series], diagonal: bool = True) -> np.ndarray:
    """The components whose row satisfies the rule."""
    label, t = components(mask, diagonal)
    good = np.zeros(int(label.max()) + 1, bool)
    good[t.loc[rule(t), "label"].to_numpy()] = True
    good[0] = False
    return good[label]


# -- grey pictures


def otsu_level(grey: np.ndarray) -> int:
    n = np.bincount(grey.ravel(), minlength=256).astype(float)
    w, s = np.cumsum(n), np.cumsum(n * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = w * (w[-1] - w) * (s / w - (s[-1] - s) / (w[-1] - w)) ** 2
    return int(np.argmax(np.nan_to_num(np.round(between, 3), nan=-1)))


def _smoothed(grey: np.ndarray, size: int) -> np.ndarray:
    """Gaussian mean over ``size`` pixels, borders repeated."""
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    k = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma * sigma))
    out = grey.astype(float)
    for axis in (0, 1):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (size // 2, size // 2)
        padded, n = np.pad(out, pad, mode="edge"), out.shape[axis]
        out = sum(v * padded.take(range(i, i + n), axis) for i, v in enumerate(k / k.sum()))
    return out


def ink(grey: np.ndarray, offset: float = 12.0) -> np.ndarray:
    """Below Otsu's level, or clearly darker than around and not as light as paper."""
    level = otsu_level(grey)
    weak = (grey <= _smoothed(grey, max(31, (max(grey.shape) // 90) | 1)) - offset) & (grey < min(235.0, level + 40))
    return (grey <= level) | weak


def without_dust(mask: np.ndarray) -> np.ndarray:
    """Small gaps closed; components of some area or extent."""
    least = max(8, int((max(mask.shape) / 1000.0) ** 2 * 5))
    return kept(closed(mask, 3, 3), lambda t: (t["area"] >= least) | (t[["width", "height"]].max(axis=1) >= 12))


def binarized(pictures: DataFrame) -> DataFrame:
    return _each(pictures, lambda g: _mask_row(without_dust(ink(g))), MASKS)


def picture_stats(pictures: DataFrame) -> DataFrame:
    """(plan_id, width, height, median, light, blur): what the checks of a picture read; ``blur`` is the variance
    of the Laplacian at half size, ``light`` the 98th percentile."""

    def made(g: np.ndarray) -> pd.DataFrame:
        h, w = g.shape[0] // 2 * 2, g.shape[1] // 2 * 2
        small = g[:h, :w].reshape(h // 2, 2, w // 2, 2).mean((1, 3))
        p = np.pad(small, 1, mode="reflect") if min(small.shape) > 1 else np.pad(small, 1, mode="edge")
        lap = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * small
        return pd.DataFrame({"width": [g.shape[1]], "height": [g.shape[0]], "median": [float(np.median(g))], "light": [float(np.percentile(g, 98))], "blur": [float(lap.var())]})

    return _each(pictures, made, "plan_id long, width int, height int, median double, light double, blur double")


# -- walls


def thickness(mask: np.ndarray) -> float:
    """Twice the median distance to the edge along the middle line; beyond 2000 px at half size."""
    if not mask.any():
        return 0.0
    if max(mask.shape) > 2000:
        return 2.0 * thickness(mask[::2, ::2])
    v = 2 * distance(mask)[thin(mask)]
    return float(np.median(v)) if v.size else 0.0


def thicknesses(masks: DataFrame) -> DataFrame:
    return _each(masks, lambda m: pd.DataFrame({"thickness": [thickness(m > 0)]}), "plan_id long, thickness double")


def decomposed(mask: np.ndarray, least: float, t: float | None = None) -> list[tuple[float, float, float, float, str]]:
    """A wall mask as boxes along the axes. Where two walls cross, the thicker one goes through.

    A wall is what survives an opening along its direction; of a component's lines the median thickness
    and middle make the box. What is left and fills its box is a box too."""
    t = t or thickness(mask) or 10.0
    size = int(max(3 * t, least))
    flat, steep = opened(mask, 1, size), opened(mask, size, 1)
    label, cross = components(flat & steep)
    upright = np.zeros(int(label.max()) + 1, bool)
    upright[cross.loc[cross["width"] > 1.25 * cross["height"], "label"].to_numpy()] = True
    flat, steep = flat & ~upright[label], steep & ~((label > 0) & ~upright[label])
    out = []
    for part, orient in ((flat, "h"), (steep.T, "v")):
        label, table = components(part)
        for c in table.itertuples():
            if c.area < 0.25 * t * t:
                continue
            own = label[c.top : c.top + c.height, c.left : c.left + c.width] == c.label
            n = own.sum(0)
            middle = float(np.median((own * np.arange(c.height)[:, None]).sum(0) / n)) + c.top + 0.5
            half = float(np.median(n)) / 2
            box = (float(c.left), middle - half, float(c.left + c.width), middle + half)
            out.append((*box, "h") if orient == "h" else (box[1], box[0], box[3], box[2], "v"))
    rest = opened(mask & ~flat & ~steep, 3, 3)
    for c in components(rest)[1].itertuples():
        if c.area >= 0.5 * t * t and max(c.width, c.height) >= 0.8 * t and c.area > 0.75 * c.width * c.height:
            out.append((float(c.left), float(c.top), float(c.left + c.width), float(c.top + c.height), "h" if c.width >= c.height else "v"))
    return out


def boxes(masks: DataFrame, least: float = 12.0) -> DataFrame:
    def made(m: np.ndarray) -> pd.DataFrame:
        rows = decomposed(m > 0, least)
        return pd.DataFrame([(i, *r) for i, r in enumerate(rows)], columns=["seq", "x0", "y0", "x1", "y1", "orient"])

    return _each(masks, made, RECTS)


def covered(mask: np.ndarray, gap: int) -> np.ndarray:
    """The ground that walls enclose, gaps up to ``gap`` px closed: what no way leads to from outside."""
    k = max(3, gap | 1)
    wide = np.pad(closed(np.pad(mask, k), k, k)[k:-k, k:-k], 1)
    label, _ = components(~wide)
    return (label != label[0, 0])[1:-1, 1:-1]


def _run_rows(mask: np.ndarray, label: np.ndarray | None = None) -> pd.DataFrame:
    r = runs(mask)
    return pd.DataFrame({"label": label[r[:, 0], r[:, 1]] if label is not None else 1, "y": r[:, 0], "xa": r[:, 1], "xb": r[:, 2]})


def footprints(masks: DataFrame, gap: int) -> DataFrame:
    """The covered ground as run-length rows."""
    return _each(masks, lambda m: _run_rows(covered(m > 0, gap)), RUNS)


def rooms(masks: DataFrame, gap: int) -> DataFrame:
    """Run-length rows of the rooms: free ground inside of at least (4 t)^2 px, t being ``wall_px``. ``masks``
    holds walls and openings."""

    def made(m: np.ndarray, t: float) -> pd.DataFrame:
        wall = m > 0
        free = covered(wall, gap) & ~dilated(wall, 3, 3)
        label, table = components(free)
        big = np.isin(label, table.loc[table["area"] >= (4 * t) ** 2, "label"].to_numpy())
        return _run_rows(big, label)

    return _each(masks, made, RUNS, "wall_px")


def stroke_width(mask: np.ndarray, near: np.ndarray, t: float) -> float:
    """The usual width of long axis lines near walls: the first clear peak of the smoothed histogram of their
    cross sections; 2 where there are too few."""
    size = int(max(15, 2.0 * t))
    across = []
    for lines in (opened(mask, 1, size) & near, (opened(mask, size, 1) & near)):
        r = runs(lines.T if not across else lines)
        across.append(r[:, 2] - r[:, 1] + 1)
    n = np.concatenate(across)
    n = n[n <= max(3, 0.5 * t)]
    if len(n) < 20:
        return 2.0
    h = np.convolve(np.bincount(n).astype(float), [0.25, 0.5, 0.25], mode="same")
    i = int(np.argmax(h >= 0.5 * h.max()))
    rise = np.flatnonzero(np.diff(h[i:]) <= 0)
    i += int(rise[0]) if len(rise) else len(h) - 1 - i
    return float(min(14, max(1, i)))


def stroke_widths(masks: DataFrame) -> DataFrame:
    """``wall`` is the walls' mask as bytes, ``wall_px`` their thickness."""

    def made(m: np.ndarray, wall: bytes, t: float) -> pd.DataFrame:
        near = dilated(np.frombuffer(wall, np.uint8).reshape(m.shape) > 0, 7, 7)
        return pd.DataFrame({"stroke": [stroke_width(m > 0, near, t)]})

    return _each(masks, made, "plan_id long, stroke double", "wall", "wall_px")


# -- paths


def branches(skeleton: np.ndarray) -> list[tuple[np.ndarray, bool]]:
    """(points, closed) of a skeleton's branches: its pixels without junctions, in the order of a walk from an
    end, drawn to the middle of the junctions they touch."""
    h, w = skeleton.shape
    p = np.pad(skeleton, 1)
    around = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]
    count = sum(p[1 + dy : h + 1 + dy, 1 + dx : w + 1 + dx].astype(int) for dy, dx in around)
    joint = skeleton & (count >= 3)
    joint_label, joints = components(joint, True)
    y, x = np.nonzero(joint)
    centre = {k: (float(g["x"].mean()), float(g["y"].mean())) for k, g in pd.DataFrame({"k": joint_label[y, x], "x": x, "y": y}).groupby("k")}
    label, _ = components(skeleton & ~joint, True)
    y, x = np.nonzero(label)
    found = []
    for _, g in pd.DataFrame({"k": label[y, x], "x": x, "y": y}).groupby("k"):
        left = set(zip(g["x"].tolist(), g["y"].tolist(), strict=True))
        beside = lambda q: [(q[0] + dx, q[1] + dy) for dy, dx in sorted(around, key=lambda o: abs(o[0]) + abs(o[1])) if (q[0] + dx, q[1] + dy) in left]  # noqa: B023, E731
        ends = [q for q in sorted(left) if len(beside(q)) <= 1]
        here = ends[0] if ends else min(left)
        way = []
        while here is not None:
            way.append(here)
            left.discard(here)
            here = next(iter(beside(here)), None)
        ring = not ends and len(way) > 8
        points = [(float(a), float(b)) for a, b in way]
        if ring:
            points.append(points[0])
        else:
            touch = lambda q: next((int(joint_label[q[1] + dy, q[0] + dx]) for dy, dx in around if 0 <= q[1] + dy < h and 0 <= q[0] + dx < w and joint_label[q[1] + dy, q[0] + dx]), 0)
            first, last = touch(way[0]), touch(way[-1])
            points = ([centre[first]] if first else []) + points + ([centre[last]] if last and (last != first or len(way) > 1) else [])
        found.append((np.array(points), ring))
    return found


def arc_of(points: np.ndarray, thin_w: float, most: float) -> tuple[float, float, float, float, float] | None:
    """(cx, cy, r, start, end) in degrees if the points follow one arc: a good circle, passed in one sense, over 30
    degrees or more; from 340 on a whole circle."""
    x, y = points.T
    (a, b, c), *_ = np.linalg.lstsq(np.stack([2 * x, 2 * y, np.ones(len(x))], 1), x * x + y * y, rcond=None)
    r = math.sqrt(max(0.0, c + a * a + b * b))
    if not 3 * thin_w <= r <= most or np.sqrt(np.mean((np.hypot(x - a, y - b) - r) ** 2)) > max(1.0, 0.02 * r):
        return None
    turn = np.degrees(np.unwrap(np.arctan2(y - b, x - a)))
    sense = 1.0 if turn[-1] >= turn[0] else -1.0
    sweep = abs(turn[-1] - turn[0])
    if sweep < 30 or np.mean(np.radians(np.diff(turn)) * sense < -0.02) > 0.1:
        return None
    return (a, b, r, 0.0, 360.0) if sweep >= 340 else (a, b, r, float(min(turn[0], turn[-1])), float(max(turn[0], turn[-1])))


def traced(mask: np.ndarray) -> list[tuple]:
    """('line', x1, y1, x2, y2, width) and ('arc', cx, cy, r, start, end): thin lines of a mask without walls."""
    if not mask.any():
        return []
    depth, bones = distance(mask), thin(mask)
    thin_w = float(max(1.5, np.percentile(2 * depth[bones], 35)))
    k = int(round(max(5.0, 2.8 * thin_w))) | 1
    wall = mask & dilated(opened(mask, k, k), 3, 3)
    wall = kept(wall, lambda t: (t["area"] >= 4 * k * k) & (t[["width", "height"]].max(axis=1) >= 4 * k))
    grow = 2 * (math.ceil(thin_w * 0.75) + 1) + 1
    bones = thin(mask & ~dilated(wall, grow, grow))
    least = max(5, int(2.5 * thin_w))
    bones = kept(bones, lambda t: np.hypot(t["width"], t["height"]) >= least)
    out: list[tuple] = []
    for points, _ in branches(bones):
        if len(points) < 2 or np.hypot(*np.diff(points, axis=0).T).sum() < least:
            continue
        at = np.clip(np.rint(points).astype(int), 0, np.array(mask.shape[::-1]) - 1)
        width = float(np.median(2 * depth[at[:, 1], at[:, 0]]))
        index = simplify(points, max(1.0, 0.45 * thin_w))
        step = np.diff(points[index], axis=0)
        bend = np.degrees(np.arctan2(step[:, 1], step[:, 0]))
        corner = np.flatnonzero(np.abs((np.diff(bend) + 180) % 360 - 180) > 40) + 1
        cuts = [0, *corner.tolist(), len(index) - 1]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            arc = arc_of(points[index[a] : index[b] + 1], thin_w, 0.6 * max(mask.shape)) if b - a >= 3 and index[b] - index[a] >= 12 else None
            if arc:
                out.append(("arc", *arc))
                continue
            for i in range(a, b):
                (x1, y1), (x2, y2) = points[index[i]], points[index[i + 1]]
                if math.hypot(x2 - x1, y2 - y1) >= 1.5:
                    out.append(("line", x1, y1, x2, y2, width))
    return out


def vectors(masks: DataFrame) -> DataFrame:
    """(plan_id, seq, kind, v): lines as x1, y1, x2, y2, width, arcs as cx, cy, r, start, end."""
    made = lambda m: pd.DataFrame([(i, e[0], [float(x) for x in e[1:]]) for i, e in enumerate(traced(m > 0))], columns=["seq", "kind", "v"])
    return _each(masks, made, "plan_id long, seq long, kind string, v array<double>")
