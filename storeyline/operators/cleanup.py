"""Cleaning of traced lines. Set rules are DataFrame plans; rules that feed on their own results
run plan by plan in pandas, whose groups are one plan's lines."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storeyline.functions import scalars as S
from storeyline.operators.helpers import band_join
from storeyline.sources.schemas import LINES

def _xy() -> list:
    return [F.col(c) for c in ("x1", "y1", "x2", "y2")]


def geometry(lines: DataFrame) -> DataFrame:
    """Adds len, ang, is_h, is_v, fx (an axis line's fixed coordinate), a0 and a1 (its interval)."""
    is_h, is_v = (F.col("y1") == F.col("y2")), (F.col("x1") == F.col("x2"))
    lines = lines.withColumns({"len": S.length(*_xy()), "ang": S.angle(*_xy()), "is_h": is_h, "is_v": is_v & ~is_h})
    return lines.withColumns({"fx": F.when(F.col("is_h"), F.col("y1")).when(F.col("is_v"), F.col("x1")), "a0": F.when(F.col("is_v"), F.least("y1", "y2")).otherwise(F.least("x1", "x2")), "a1": F.when(F.col("is_v"), F.greatest("y1", "y2")).otherwise(F.greatest("x1", "x2"))})


def snap_axis(lines: DataFrame, degrees: float = 3.0) -> DataFrame:
    """Lines within some degrees of an axis get one shared coordinate, the mean."""
    a = S.angle(*_xy())
    h, v = (a < degrees) | (a > 180 - degrees), F.abs(a - 90) < degrees
    y, x = (F.col("y1") + F.col("y2")) / 2, (F.col("x1") + F.col("x2")) / 2
    v = v & ~h
    return lines.withColumn("__h", h).withColumn("__v", v).withColumns({"y1": F.when(F.col("__h"), y).otherwise(F.col("y1")), "y2": F.when(F.col("__h"), y).otherwise(F.col("y2")), "x1": F.when(F.col("__v"), x).otherwise(F.col("x1")), "x2": F.when(F.col("__v"), x).otherwise(F.col("x2"))}).drop("__h", "__v")


def drop_short(lines: DataFrame, least: float) -> DataFrame:
    return lines.where(S.length(*_xy()) >= least)


def drop_bridges(lines: DataFrame, longest: float, tol: float) -> DataFrame:
    """Short slanted lines go if each end lies on some other axis line."""
    g = geometry(lines)
    axis = g.where("is_h or is_v").select("plan_id", F.col("seq").alias("b_seq"), "is_h", F.col("fx").alias("b_fx"), F.col("a0").alias("b_a0"), F.col("a1").alias("b_a1"))
    stubs = g.where(f"not is_h and not is_v and len < {longest}").select("plan_id", "seq", F.explode(F.array(*(F.struct(F.lit(i).alias("end"), F.col(f"x{i}").alias("x"), F.col(f"y{i}").alias("y")) for i in (1, 2)))).alias("p")).select("plan_id", "seq", "p.*")
    met = None
    for h, at, along in ((True, "y", "x"), (False, "x", "y")):
        on = F.col(along).between(F.col("b_a0") - tol, F.col("b_a1") + tol) & (F.col("seq") != F.col("b_seq"))
        part = band_join(stubs, axis.where(F.col("is_h") == h).drop("is_h"), ["plan_id"], at, "b_fx", -tol, tol, condition=on).select("plan_id", "seq", "end")
        met = part if met is None else met.unionByName(part)
    both = met.distinct().groupBy("plan_id", "seq").agg(F.count("*").alias("n")).where("n = 2")
    return lines.join(both, ["plan_id", "seq"], "left_anti")


def _arrays(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    p = pdf[["x1", "y1"]].to_numpy(float)
    q = pdf[["x2", "y2"]].to_numpy(float)
    return p, q, np.hypot(*(q - p).T)


def _merge_once(pdf: pd.DataFrame, dist_tol: float, gap_tol: float, ang_tol: float) -> pd.DataFrame:
    p, q, size = _arrays(pdf)
    ang = np.degrees(np.arctan2(q[:, 1] - p[:, 1], q[:, 0] - p[:, 0])) % 180
    is_h, is_v = p[:, 1] == q[:, 1], p[:, 0] == q[:, 0]
    free, rows = np.ones(len(pdf), bool), []
    cell = np.floor(ang / 3.0)  # only lines of the same or next 3 degrees meet, as in the convention
    for i in np.argsort(-size, kind="stable"):
        if not free[i]:
            continue
        u = np.array([np.cos(np.radians(ang[i])), np.sin(np.radians(ang[i]))])
        n = np.array([-u[1], u[0]])
        turn = np.abs(ang - ang[i])
        rho = p[i] @ n
        wide = max(1.0, 2 * dist_tol)
        own_rho = np.floor((-np.sin(np.radians(ang)) * p[:, 0] + np.cos(np.radians(ang)) * p[:, 1]) / wide)
        near = free & (np.minimum(turn, 180 - turn) <= ang_tol) & (np.abs(p @ n - rho) <= dist_tol) & (np.abs(q @ n - rho) <= dist_tol)
        near &= (np.abs(own_rho - own_rho[i]) <= 1) & np.isin((cell - cell[i]) % 60, (0, 1, 59))
        near[i] = True
        idx = np.flatnonzero(near)
        s, e = np.minimum(p[idx] @ u, q[idx] @ u), np.maximum(p[idx] @ u, q[idx] @ u)
        own = int(np.flatnonzero(idx == i)[0])
        low, high, taken = s[own], e[own], np.zeros(len(idx), bool)
        taken[own] = True
        while True:  # grows while anything touches the range
            more = ~taken & (e >= low - gap_tol) & (s <= high + gap_tol)
            if not more.any():
                break
            taken |= more
            low, high = min(low, s[more].min()), max(high, e[more].max())
        members = idx[taken]
        free[members] = False
        row = pdf.iloc[i].to_dict()
        if len(members) > 1:
            w = size[members] + 1e-6
            if is_h[i]:
                y = float(np.average(p[members, 1], weights=w))
                a, b = (low, y), (high, y)
            elif is_v[i]:
                x = float(np.average(p[members, 0], weights=w))
                a, b = (x, low), (x, high)
            else:
                a, b = u * low + n * rho, u * high + n * rho
            row |= {"x1": a[0], "y1": a[1], "x2": b[0], "y2": b[1], "width": float(np.average(pdf["width"].to_numpy(float)[members], weights=w))}
        rows.append(row)
    return pd.DataFrame(rows, columns=pdf.columns)


def merge_collinear(lines: DataFrame, dist_tol: float, gap_tol: float, ang_tol: float = 2.0) -> DataFrame:
    """Collinear pieces that overlap or nearly meet become one; the longest leads. At most three passes."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq").reset_index(drop=True)
        for _ in range(3):
            before = len(pdf)
            pdf = _merge_once(pdf, dist_tol, gap_tol, ang_tol)
            if len(pdf) == before:
                break
        return pdf

    return lines.groupBy("plan_id").applyInPandas(run, LINES)


def connect_orthogonal(lines: DataFrame, tol: float) -> DataFrame:
    """Ends of axis lines move onto the nearest crossing axis line within ``tol``, which is made to
    reach them; horizontal lines first. Later lines see what earlier ones moved."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq").reset_index(drop=True)
        xy = pdf[["x1", "y1", "x2", "y2"]].to_numpy(float)
        flat = xy[:, 1] == xy[:, 3]
        up = (xy[:, 0] == xy[:, 2]) & ~flat
        for movers, others, along in ((flat, up, 0), (up, flat, 1)):
            across = 1 - along
            there = np.flatnonzero(others)
            there = there[np.argsort(xy[there, along], kind="stable")]
            if not len(there):
                continue
            for i in np.flatnonzero(movers):
                ends = xy[i].reshape(2, 2).copy()
                for k in range(2):
                    pos = ends[k]
                    t = xy[there]
                    low, high = np.minimum(t[:, across], t[:, 2 + across]), np.maximum(t[:, across], t[:, 2 + across])
                    far = np.abs(t[:, along] - pos[along])
                    ok = (far <= tol) & (low - tol <= pos[across]) & (pos[across] <= high + tol)
                    if not ok.any():
                        continue
                    best = int(np.argmin(np.where(ok, far, np.inf)))
                    j, to = there[best], t[best, along]
                    if abs(to - ends[1 - k][along]) < 1.0:
                        continue
                    pos[along] = to
                    if not low[best] <= pos[across] <= high[best]:
                        near = 0 if abs(xy[j, across] - pos[across]) < abs(xy[j, 2 + across] - pos[across]) else 2
                        xy[j, near + across] = pos[across]
                xy[i] = ends.ravel()
        pdf[["x1", "y1", "x2", "y2"]] = xy
        return pdf

    return lines.groupBy("plan_id").applyInPandas(run, LINES)


def snap_free_ends(lines: DataFrame, tol: float) -> DataFrame:
    """Ends of slanted lines move to the nearest other end within ``tol``, an axis line's if there is one."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq").reset_index(drop=True)
        xy = pdf[["x1", "y1", "x2", "y2"]].to_numpy(float)
        start = xy.copy()  # cells are those of the ends as they were
        cs = max(1.0, tol)
        for i in range(len(xy)):
            if xy[i, 1] == xy[i, 3] or xy[i, 0] == xy[i, 2]:
                continue
            ends = xy[i].reshape(2, 2).copy()
            for k in range(2):
                p, best, reach, on_axis = ends[k].copy(), None, tol, False
                home = np.floor(p / cs)
                near = np.abs(np.floor(start.reshape(-1, 2) / cs) - home).max(1) <= 1
                near[2 * i : 2 * i + 2] = False
                ids = np.flatnonzero(near)
                cells = np.floor(start.reshape(-1, 2)[ids] / cs) - home
                for e in ids[np.lexsort((ids, cells[:, 1], cells[:, 0]))]:
                    j = e // 2
                    other = xy[j].reshape(2, 2)[e % 2]
                    d = float(np.hypot(*(other - p)))
                    axis = xy[j, 1] == xy[j, 3] or xy[j, 0] == xy[j, 2]
                    if d < reach or (axis and not on_axis and d <= tol):
                        best, reach, on_axis = other.copy(), d, axis
                if best is not None:
                    ends[k] = best
            xy[i] = ends.ravel()
        pdf[["x1", "y1", "x2", "y2"]] = xy
        return pdf

    return lines.groupBy("plan_id").applyInPandas(run, LINES)


def clean(lines: DataFrame, dist_tol: float, gap_tol: float, corner_tol: float, shortest: float) -> DataFrame:
    """The whole sequence; its order matters."""
    out = merge_collinear(snap_axis(lines), dist_tol, gap_tol)
    out = snap_free_ends(connect_orthogonal(out, corner_tol), corner_tol)
    return drop_short(drop_bridges(merge_collinear(out, dist_tol, gap_tol), 3 * corner_tol, dist_tol), shortest)
