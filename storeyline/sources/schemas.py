"""Schemas of the plan tables. ``plan_id`` and ``seq`` identify every row of a child table."""

from __future__ import annotations

POINT = "struct<x:double,y:double>"
PLANS = "plan_id long, width double, height double, source string, dpi double, warped boolean, thin_w double, wall_px double, calibrated_mm_px double, resize_factor double"
LINES = "plan_id long, seq long, x1 double, y1 double, x2 double, y2 double, layer string, width double, comp int"
ARCS = "plan_id long, seq long, cx double, cy double, r double, start double, end double, layer string"
CIRCLES = "plan_id long, seq long, cx double, cy double, r double, layer string"
TEXTS = "plan_id long, seq long, text string, x0 double, y0 double, x1 double, y1 double, rotation int, conf double, layer string, cap double, grp long"
RECTS = "plan_id long, seq long, x0 double, y0 double, x1 double, y1 double, orient string"
OPENINGS = "plan_id long, seq long, kind string, x0 double, y0 double, x1 double, y1 double, orient string"
ROOM_RUNS = "plan_id long, label long, y int, xa int, xb int"
STOREYS = "plan_id long, i int, name string, height double"
OCR_WORDS = "plan_id long, rotation int, seq long, level int, page_num int, block_num int, par_num int, line_num int, word_num int, left int, top int, width int, height int, conf double, text string"

# The drawing layers in drawing order, with colour and line weight in mm.
LAYERS = {
    "HATCH": ("#8c8c8c", 0.13), "WALLS": ("#000000", 0.5), "WINDOWS": ("#1f6fb2", 0.25), "DOORS": ("#b25a1f", 0.25), "STAIRS": ("#5a5a5a", 0.18),
    "LINES": ("#333333", 0.18), "SYMBOLS": ("#6b6b6b", 0.13), "DIMENSIONS": ("#2e7d32", 0.13), "TEXT": ("#000000", 0.18), "ROOMS": ("#000000", 0.18),
}
