"""Kernels over one plan's pixels, in numpy; plans run apart from one another.

Masks travel as (plan_id, width, height, data) with one byte a pixel. Whatever follows from pixel
statistics (histograms, thresholds, components as run-length rows) comes back as tables."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MASKS = "plan_id long, width int, height int, data binary"


def _mask(r) -> np.ndarray:
    return np.frombuffer(r.data, np.uint8).reshape(r.height, r.width) > 0


def thin(mask: np.ndarray, rounds: int = 500) -> np.ndarray:
    """One-pixel skeleton by the two-step thinning of Guo and Hall in the form of Lam, Lee and Suen's survey.

    x[0] .. x[7] are the neighbours from the east, against the clock. A pixel goes if exactly one
    run of neighbours meets it, if it is at an edge but no line's end, and, step by step, if it faces
    north-east or south-west."""
    m = np.pad(mask.astype(bool), 1)
    for _ in range(rounds):
        gone = 0
        for half in (0, 4):
            x = [m[1:-1, 2:], m[:-2, 2:], m[:-2, 1:-1], m[:-2, :-2], m[1:-1, :-2], m[2:, :-2], m[2:, 1:-1], m[2:, 2:]]
            runs_met = sum((~x[i] & (x[i + 1] | x[(i + 2) % 8])).astype(np.int8) for i in (0, 2, 4, 6))
            pairs = [sum((x[i] | x[(i + s) % 8]).astype(np.int8) for i in (0, 2, 4, 6)) for s in (1, -1)]
            few = np.minimum(*pairs)
            faces = ~((x[1 + half] | x[2 + half] | ~x[(7 + half) % 8]) & x[half])
            drop = m[1:-1, 1:-1] & (runs_met == 1) & (few >= 2) & (few <= 3) & faces
            m[1:-1, 1:-1] &= ~drop
            gone += int(drop.sum())
        if not gone:
            break
    return m[1:-1, 1:-1]


def runs(mask: np.ndarray) -> np.ndarray:
    """(y, xa, xb) of the horizontal runs, ends inclusive."""
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    y, xa = np.nonzero(edge == 1)
    return np.stack([y, xa, np.nonzero(edge == -1)[1] - 1], 1)


def labelled(mask: np.ndarray, diagonal: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(runs, label of each): connected components, numbered from 1 in reading order."""
    r = runs(mask)
    up = np.arange(len(r))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    row = np.searchsorted(r[:, 0], np.arange(mask.shape[0] + 1))
    reach = int(diagonal)
    for y in range(1, mask.shape[0]):
        i, j = row[y - 1], row[y]
        while i < row[y] and j < row[y + 1]:
            if r[i, 1] <= r[j, 2] + reach and r[j, 1] <= r[i, 2] + reach:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
            if r[i, 2] < r[j, 2]:
                i += 1
            else:
                j += 1
    roots = np.array([root(i) for i in range(len(r))], int)
    return r, np.unique(roots, return_inverse=True)[1] + 1 if len(r) else roots


def simplify(points: np.ndarray, tol: float) -> np.ndarray:
    """Indices of the points that keep a path within ``tol`` (recursive splitting at the farthest)."""
    keep, todo = {0, len(points) - 1}, [(0, len(points) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        p, d = points[a + 1 : b] - points[a], points[b] - points[a]
        size = np.hypot(*d)
        far = np.abs(p[:, 0] * d[1] - p[:, 1] * d[0]) / size if size else np.hypot(*p.T)
        k = int(np.argmax(far))
        if far[k] > tol:
            keep.add(a + 1 + k)
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return np.array(sorted(keep))


def skeletons(masks: DataFrame) -> DataFrame:
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(data=[thin(_mask(r)).astype(np.uint8).tobytes() for r in pdf.itertuples()])

    return masks.select("plan_id", "width", "height", "data").mapInPandas(run, MASKS)


def component_runs(masks: DataFrame, diagonal: bool = False) -> DataFrame:
    """(plan_id, label, y, xa, xb)."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                rows, label = labelled(_mask(r), diagonal)
                yield pd.DataFrame({"plan_id": r.plan_id, "label": label, "y": rows[:, 0], "xa": rows[:, 1], "xb": rows[:, 2]})

    return masks.select("plan_id", "width", "height", "data").mapInPandas(run, "plan_id long, label long, y int, xa int, xb int")


def component_stats(component: DataFrame) -> DataFrame:
    """(plan_id, label, area, top, left, right, bottom, cx, cy, diag) from run-length rows."""
    n = F.col("xb") - F.col("xa") + 1
    g = component.groupBy("plan_id", "label").agg(F.sum(n).alias("area"), F.min("y").alias("top"), F.min("xa").alias("left"), F.max("xb").alias("right"), F.max("y").alias("bottom"), (F.sum((F.col("xa") + F.col("xb")) / 2 * n) / F.sum(n)).alias("cx"), (F.sum(F.col("y") * n) / F.sum(n)).alias("cy"))
    return g.withColumn("diag", F.hypot(F.col("right") - F.col("left") + 1, F.col("bottom") - F.col("top") + 1))


def simplified(paths: DataFrame, tol: float) -> DataFrame:
    """(plan_id, path, i, x, y) of what is left of (plan_id, path, i, x, y)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i").reset_index(drop=True)
        return pdf.iloc[simplify(pdf[["x", "y"]].to_numpy(float), tol)]

    return paths.groupBy("plan_id", "path").applyInPandas(run, paths.select("plan_id", "path", "i", "x", "y").schema)


def circles(points: DataFrame, by: list[str]) -> DataFrame:
    """(by, cx, cy, r, rms): least-squares circles in closed form, from sums alone: one aggregation."""
    m = points.groupBy(*by).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    u, v = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    s = points.join(m, by).groupBy(*by, "mx", "my").agg(*(F.sum(e).alias(n) for e, n in ((u * u, "uu"), (v * v, "vv"), (u * v, "uv"), (u * u * u, "uuu"), (v * v * v, "vvv"), (u * v * v, "uvv"), (u * u * v, "uuv"))), F.count("*").alias("n"))
    det = F.col("uu") * F.col("vv") - F.col("uv") * F.col("uv")
    p, q = (F.col("uuu") + F.col("uvv")) / 2, (F.col("vvv") + F.col("uuv")) / 2
    s = s.where(F.abs(det) > 1e-9).withColumns({"a": (p * F.col("vv") - q * F.col("uv")) / det, "b": (q * F.col("uu") - p * F.col("uv")) / det})
    s = s.select(*by, (F.col("mx") + F.col("a")).alias("cx"), (F.col("my") + F.col("b")).alias("cy"), F.sqrt(F.col("a") ** 2 + F.col("b") ** 2 + (F.col("uu") + F.col("vv")) / F.col("n")).alias("r"))
    off = F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")) - F.col("r")
    return points.join(s, by).groupBy(*by, "cx", "cy", "r").agg(F.sqrt(F.avg(off * off)).alias("rms"))


def otsu(histogram: DataFrame) -> DataFrame:
    """(plan_id, threshold): the grey value that parts (plan_id, value, n) with the largest variance
    between the parts; the first of equals."""
    by = Window.partitionBy("plan_id")
    run = by.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    h = histogram.withColumns({"w0": F.sum("n").over(run), "s0": F.sum(F.col("n") * F.col("value")).over(run), "w": F.sum("n").over(by), "s": F.sum(F.col("n") * F.col("value")).over(by)})
    w1 = F.col("w") - F.col("w0")
    between = F.when(w1 > 0, F.col("w0") * w1 * (F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / w1) ** 2)
    h = h.withColumn("between", F.round(between, 6)).where("between is not null")
    return h.groupBy("plan_id").agg(F.min(F.struct((-F.col("between")).alias("b"), F.col("value"))).alias("m")).select("plan_id", F.col("m.value").alias("threshold"))


def wall_rects(masks: DataFrame) -> DataFrame:
    """(plan_id, seq, x0, y0, x1, y1, orient): a wall mask as boxes: equal runs in successive rows are one."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                open_, out = {}, []
                rows = runs(_mask(r))
                for y in range(r.height + 1):
                    here = {(int(a), int(b)) for _, a, b in rows[np.searchsorted(rows[:, 0], y) : np.searchsorted(rows[:, 0], y + 1)]}
                    for k in [k for k in open_ if k not in here]:
                        out.append((k[0], open_.pop(k), k[1] + 1, y))
                    for k in here:
                        open_.setdefault(k, y)
                out.sort(key=lambda b: (b[1], b[0]))
                yield pd.DataFrame([(r.plan_id, i, *map(float, b), "h" if b[2] - b[0] >= b[3] - b[1] else "v") for i, b in enumerate(out)], columns=["plan_id", "seq", "x0", "y0", "x1", "y1", "orient"])

    return masks.select("plan_id", "width", "height", "data").mapInPandas(run, "plan_id long, seq long, x0 double, y0 double, x1 double, y1 double, orient string")


def merged_rects(rects: DataFrame, gap: float) -> DataFrame:
    """Boxes of one direction in line, of like thickness and at most ``gap`` apart become one until none is
    left to join: the first such pair in order each time. Centre and thickness are means by length."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        flat = pdf["orient"].iloc[0] == "h"
        c = ["x0", "x1", "y0", "y1"] if flat else ["y0", "y1", "x0", "x1"]
        v, seqs = pdf[c].to_numpy(float), pdf["seq"].to_numpy()
        low, high, mid, thick = v[:, 0], v[:, 1], (v[:, 2] + v[:, 3]) / 2, v[:, 3] - v[:, 2]
        while True:
            off, other = np.abs(mid[:, None] - mid), np.abs(thick[:, None] - thick)
            fits = (off <= 0.5 * np.minimum(thick[:, None], thick)) & (other <= 0.6 * np.maximum(thick[:, None], thick)) & (np.maximum(low[:, None], low) - np.minimum(high[:, None], high) <= gap)
            pair = np.flatnonzero(np.triu(fits, 1))
            if not len(pair):
                break
            i, j = divmod(int(pair[0]), len(mid))
            size = high - low
            part = size[[i, j]] / max(size[i] + size[j], 1e-9)
            mid[i], thick[i] = part @ mid[[i, j]], part @ thick[[i, j]]
            low[i], high[i] = min(low[i], low[j]), max(high[i], high[j])
            low, high, mid, thick, seqs = (np.delete(x, j) for x in (low, high, mid, thick, seqs))
        out = pd.DataFrame(dict(zip(c, (low, high, mid - thick / 2, mid + thick / 2), strict=True)))
        return out.assign(plan_id=pdf["plan_id"].iloc[0], seq=seqs, orient=pdf["orient"].iloc[0])[["plan_id", "seq", "x0", "y0", "x1", "y1", "orient"]]

    return rects.groupBy("plan_id", "orient").applyInPandas(run, "plan_id long, seq long, x0 double, y0 double, x1 double, y1 double, orient string")
