"""Scalar functions over text and geometry columns, all as JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# They must equal those of the plans' conventions.
COMMON_SCALES = (1, 2, 5, 10, 20, 25, 50, 100, 200, 250, 500, 1000, 2000, 2500, 5000)
SCALE_WORDS = "M|Mst|Massstab|Maßstab|Scale"
SUPERSCRIPTS = "⁰¹²³⁴⁵⁶⁷⁸⁹"
AREA_PREFIXES = "F|BF|NF|HNF|NGF|GF"
STOREY_NAMES = {"erdgeschoss": "EG", "obergeschoss": "OG", "untergeschoss": "UG", "dachgeschoss": "DG", "kellergeschoss": "UG", "kg": "UG"}
UMLAUTS = {
    "kuche": "Küche", "kueche": "Küche", "buro": "Büro", "bueroe": "Büro", "gaste": "Gäste", "gastezimmer": "Gästezimmer",
    "gaste-wc": "Gäste-WC", "geratraum": "Geräteraum", "gerate": "Geräte", "schlafzimmer": "Schlafzimmer",
    "wohnkuche": "Wohnküche", "essküche": "Essküche", "esskuche": "Essküche", "kuhlraum": "Kühlraum",
    "vorratsraum": "Vorratsraum", "waschkuche": "Waschküche", "buhne": "Bühne", "dachboden": "Dachboden",
    "trockenraum": "Trockenraum", "kinderzimmer": "Kinderzimmer",
}
# Patterns of the plans' notations, which decide what counts as a number, a scale, an area, a room number or a storey.
DIMENSION_PATTERN = r"^(\d{1,3})(?:[.,](\d{1,3}))?$"
SCALE_PATTERN = rf"(?iu)(?:\b(?:{SCALE_WORDS})\.?\s*)?1\s*[:/]\s*(\d{{1,4}})\b"
SCALE_PREFIX_PATTERN = rf"(?iu)\b(?:{SCALE_WORDS})\.?\s*1\s*[:/]"
NUMERIC_PATTERN = rf"^\d{{1,3}}([.,]\d{{1,3}})?[{SUPERSCRIPTS}]*$"
AREA_PATTERN = rf"(?iu)(?:\b(?:{AREA_PREFIXES})\s*[=:]?\s*(\d{{1,3}}(?:[.,]\d{{1,2}})?)(?![\d.,]))|(?:(\d{{1,3}}(?:[.,]\d{{1,2}})?)\s*(?:m\s*[2²]|qm))"
BARE_AREA_PATTERN = r"^(\d{1,3}[.,]\d{1,2})$"
NAME_PATTERN = r"[A-Za-zÄÖÜäöüéèàç]{3,}"
ROOM_NUMBER_PATTERN = r"^[Oo]?(\d{1,3}(?:\.\d{1,2})?)\b\s*(.*)$"
STOREY_PATTERN = r"(?iu)\b(UG|KG|EG|DG|[1-9]\s?\.?\s?OG|OG|Erdgeschoss|Obergeschoss|Untergeschoss|Dachgeschoss|Kellergeschoss)\b"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def decimal(c: Column | str) -> Column:
    """A number written with a point or a comma; null if it is none."""
    return F.replace(F.trim(_col(c)), F.lit(","), F.lit(".")).try_cast("double")


# -- texts


def dimension_mm(c: Column | str) -> Column:
    """``4.50`` is 4500 mm (metres with two decimals), ``80`` is 800 mm (centimetres); 50..60000 or null."""
    t = F.rtrim(F.replace(F.trim(_col(c)), F.lit(" "), F.lit("")), F.lit(SUPERSCRIPTS))
    whole, part = F.regexp_extract(t, DIMENSION_PATTERN, 1), F.regexp_extract(t, DIMENSION_PATTERN, 2)
    value = F.when(whole == "", None).when(part == "", whole.try_cast("double") * 10).when(F.length(part) == 2, F.concat(whole, F.lit("."), part).try_cast("double") * 1000)
    return F.when(value.between(50, 60000), value)


def scale_ratios(c: Column | str) -> Column:
    """All common ratios n of ``1:n`` or ``1/n`` in a text, in order."""
    found = F.regexp_extract_all(_col(c), F.lit(SCALE_PATTERN), F.lit(1))
    return F.filter(F.transform(found, lambda n: n.cast("int")), lambda n: n.isin(*COMMON_SCALES))


def scale_prefixed(c: Column | str) -> Column:
    """Whether a scale word stands before the ratio."""
    return _col(c).rlike(SCALE_PREFIX_PATTERN)


def is_numeric_token(c: Column | str) -> Column:
    """Digits with an optional decimal part and superscripts."""
    return F.trim(_col(c)).rlike(NUMERIC_PATTERN)


def area_m2(c: Column | str) -> Column:
    """An area text (prefix F, NF, ... or suffix m², m2, qm), or a bare number with decimals."""
    def read(t: Column) -> Column:
        first, second = F.regexp_extract(t, AREA_PATTERN, 1), F.regexp_extract(t, AREA_PATTERN, 2)
        return F.when(first != "", decimal(first)).when(second != "", decimal(second))

    bare = F.regexp_extract(F.trim(_col(c)), BARE_AREA_PATTERN, 1)
    return F.coalesce(read(F.replace(_col(c), F.lit(" "), F.lit(""))), read(_col(c)), F.when(bare != "", decimal(bare)))


def has_area_mark(c: Column | str) -> Column:
    """Whether a text holds an area with its prefix or unit."""
    return area_m2(F.concat(_col(c), F.lit(" #"))).isNotNull()  # the mark spoils a bare number


def area_text(c: Column | str) -> Column:
    """One decimal where that is exact, else two."""
    v = _col(c)
    return F.when(F.abs(v * 10 - F.round(v * 10)) < 1e-6, F.format_string("%.1f m²", v)).otherwise(F.format_string("%.2f m²", v))


def digit_drops(value: Column, measured: Column) -> Column:
    """The nearest number to ``measured`` (within 5 %) that dropping one digit of ``value`` gives."""
    raw = F.when(value == F.floor(value), F.format_string("%.1f", value)).otherwise(F.regexp_replace(F.format_string("%.2f", value), r"0+$", ""))
    raw = F.regexp_replace(raw, r"\.0$", "")
    made = F.transform(F.sequence(F.lit(1), F.length(raw)), lambda i: F.when(F.substring(raw, i, F.lit(1)).rlike(r"\d"), F.concat(F.substring(raw, F.lit(1), i - 1), F.substring(raw, i + 1, F.length(raw))).try_cast("double")))
    good = F.filter(made, lambda a: a.isNotNull() & (a > 0) & (F.abs(a - measured) <= 0.05 * measured))
    return F.array_min(F.transform(good, lambda a: F.struct(F.abs(a - measured).alias("d"), a.alias("v"))))["v"]


def is_name(text: Column | str, conf: Column | str) -> Column:
    """A word of three letters or more, mostly letters, read with some confidence."""
    t = F.trim(_col(text))
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
    return t.rlike(NAME_PATTERN) & (letters >= 0.6 * F.length(F.replace(t, F.lit(" "), F.lit("")))) & (_col(conf) >= 55)


def stamp_line(c: Column | str) -> Column:
    """A stamp's line with frequent misreadings put right."""
    t = F.replace(F.replace(F.trim(_col(c)), F.lit("m2"), F.lit("m²")), F.lit("qm"), F.lit("m²"))
    t = F.regexp_replace(F.regexp_replace(t, r"\bO(\d)", "0$1"), r"^0(\d{2})\b", "$1")
    table = F.create_map(*(F.lit(x) for pair in UMLAUTS.items() for x in pair))
    return F.array_join(F.transform(F.split(t, " "), lambda w: F.coalesce(F.try_element_at(table, F.lower(w)), w)), " ")


def number_prefix(c: Column | str) -> Column:
    """struct(number, rest) of ``O02 Küche`` and the like; number null if there is none."""
    return F.struct(F.nullif(F.regexp_extract(_col(c), ROOM_NUMBER_PATTERN, 1), F.lit("")).alias("number"), F.regexp_extract(_col(c), ROOM_NUMBER_PATTERN, 2).alias("rest"))


def storey_of(c: Column | str) -> Column:
    """The storey a text names, in short form; null if none."""
    raw = F.regexp_extract(_col(c), STOREY_PATTERN, 1)
    table = F.create_map(*(F.lit(x) for pair in STOREY_NAMES.items() for x in pair))
    return F.when(raw != "", F.coalesce(F.try_element_at(table, F.lower(raw)), F.replace(F.upper(raw), F.lit(" "), F.lit(""))))


def storey_score(c: Column | str) -> Column:
    """2 for a text that looks like a plan's title, else 1."""
    return F.when(_col(c).rlike("(?iu)grundriss|geschoss"), 2).otherwise(1)


def safe_stem(c: Column | str) -> Column:
    """A file name's stem without characters that file systems dislike, at most 80 long."""
    stem = F.regexp_replace(F.regexp_replace(_col(c), r"^.*[/\\]", ""), r"\.[^.]*$", "")
    clean = F.substring(F.btrim(F.regexp_replace(stem, r"[^\p{L}\p{N}_\-. ]+", "_"), F.lit("_ .")), 1, 80)
    return F.when(clean == "", F.lit("plan")).otherwise(clean)


def xml_escape(c: Column | str) -> Column:
    out = _col(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


# -- geometry


def length(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.hypot(x2 - x1, y2 - y1)


def angle(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Degrees in [0, 180)."""
    return F.pmod(F.degrees(F.atan2(y2 - y1, x2 - x1)), F.lit(180.0))


def frame(line_angle: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """struct(rho, t0, t1): distance from the origin and range along the direction."""
    ux, uy = F.cos(F.radians(line_angle)), F.sin(F.radians(line_angle))
    a, b = x1 * ux + y1 * uy, x2 * ux + y2 * uy
    return F.struct((y1 * ux - x1 * uy).alias("rho"), F.least(a, b).alias("t0"), F.greatest(a, b).alias("t1"))


def point_segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    t = F.when(square == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / square)))
    return F.hypot(px - ax - t * dx, py - ay - t * dy)


def homography(m: Column, x: Column, y: Column) -> Column:
    """struct(x, y) of a point under a row-major 3x3 matrix."""
    at = lambda i: F.element_at(m, i + 1)
    w = at(6) * x + at(7) * y + at(8)
    return F.struct(((at(0) * x + at(1) * y + at(2)) / w).alias("x"), ((at(3) * x + at(4) * y + at(5)) / w).alias("y"))


def ring_area(points: Column) -> Column:
    """Area of a ring of struct(x, y), by the shoelace sum."""
    after = F.concat(F.slice(points, 2, F.size(points)), F.slice(points, 1, 1))
    cross = F.zip_with(points, after, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda a, b: a + b)) / 2


def arc_points(cx: Column, cy: Column, r: Column, start: Column, end: Column) -> Column:
    """Points of an arc, one for each three degrees and at least eight steps."""
    n = F.greatest(F.lit(8), F.floor((end - start) / 3).cast("int"))
    at = lambda i: F.radians(start + (end - start) * i / n)
    return F.transform(F.sequence(F.lit(0), n), lambda i: F.struct((cx + r * F.cos(at(i))).alias("x"), (cy + r * F.sin(at(i))).alias("y")))


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Shared length of two intervals, negative if they are apart."""
    return F.least(a1, b1) - F.greatest(a0, b0)


def box_overlap(a: list[Column], b: list[Column]) -> Column:
    """Shared area of two boxes (x0, y0, x1, y1)."""
    return F.greatest(F.lit(0.0), overlap(a[0], a[2], b[0], b[2])) * F.greatest(F.lit(0.0), overlap(a[1], a[3], b[1], b[3]))
