"""Every query with an oracle gives the oracle's rows; the others run and have a stable schema."""

import os

import duckdb
import pytest

from storeyline.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "0" if abs(v) < 1e-9 else f"{v:.6g}"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    mine = sorted(tuple(shown(r[c]) for c in columns) for r in df.collect())
    answer = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    theirs = sorted(tuple(shown(row[names.index(c)]) for c in columns) for row in answer.fetchall())
    assert mine == theirs


def test_cleanup_closes_corners_and_drops_stumps(spark):
    rows = {r.seq: r for r in registry.queries()["geo_cleanup"](spark, SF).collect()}
    assert set(rows) == {1, 3, 4, 7, 8}
    assert (rows[1].x1, rows[1].x2) == (0.0, 204.0)  # two pieces in line, drawn to the corner
    assert rows[3].y1 == rows[1].y1  # the other wall reaches it
    assert rows[4].x2 == 204.0


def test_empty_inputs(spark):
    from storeyline.operators import classify, cleanup, scale
    from storeyline.sources.schemas import LINES

    none = spark.createDataFrame([], LINES)
    frame = spark.createDataFrame([], "plan_id long, short double, thin_w double, text_h double, mm_per_px double")
    assert cleanup.clean(none, 1.0, 2.0, 3.0, 1.0).count() == 0
    assert classify.wall_pairs(none, frame).count() == 0
    assert scale.chain_scale(spark.createDataFrame([], "plan_id long, mm_per_px double")).count() == 0


def test_plan_files(spark, tmp_path):
    from storeyline.sources.readers import plan_files

    (tmp_path / "a.PNG").write_bytes(b"x")
    (tmp_path / "b.txt").write_bytes(b"x")
    (tmp_path / "c.pdf").write_bytes(b"")
    rows = {r.extension: r.error for r in plan_files(spark, str(tmp_path)).collect()}
    assert rows == {"png": None, "txt": "unsupported file type: txt"}


def test_stream_of_ocr_tables(spark, tmp_path):
    from storeyline.plans.fixtures import TSV
    from storeyline.sources.readers import ocr_words
    from storeyline.streaming.watch import ocr_stream, run_batches

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "7_0.tsv").write_text(TSV)
    (tmp_path / "in" / "notes.txt").write_text("x")
    q = run_batches(ocr_stream(spark, str(tmp_path / "in")), ocr_words, str(tmp_path / "out"), str(tmp_path / "ck"), once=True)
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).where("plan_id = 7").count() == 8


def test_step_values(spark):
    from pyspark.sql import functions as F

    from storeyline.sinks import ifc

    said = spark.createDataFrame([("Tür 'a'\\",), ("😀",), ("",)], "t string").select(ifc.text(F.col("t")).alias("s")).collect()
    assert [r.s for r in said] == ["'T\\X2\\00FC\\X0\\r ''a''\\\\'", "'\\X2\\D83DDE00\\X0\\'", "''"]
    reals = spark.createDataFrame([(-0.0000001,), (1.5,), (float("nan"),), (12.0,), (-3.25,)], "v double").select(ifc.real(F.col("v")).alias("s")).collect()
    assert [r.s for r in reals] == ["0.", "1.5", "0.", "12.", "-3.25"]
    ids = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "plan_id long, k string").select(ifc._identifier(F.col("k")).alias("s")).collect()
    assert len({r.s for r in ids}) == 3 and all(len(r.s) == 24 and r.s[1] in "0123" for r in ids)


def test_ifc_references_are_whole(spark):
    import re

    from storeyline.plans.fixtures import _ifc

    text = _ifc(spark).first().ifc
    lines = text.split("\n")
    assert "\x01" not in text and lines[0] == "ISO-10303-21;" and lines[-2:] == ["END-ISO-10303-21;", ""]
    kinds = dict(re.match(r"#(\d+)=([A-Z0-9]+)\(", x).groups() for x in lines if x.startswith("#"))
    assert list(map(int, kinds)) == list(range(1, len(kinds) + 1))
    for x in lines:
        if m := re.match(r"#\d+=IFCRELVOIDSELEMENT\('[^']{22}',\$,\$,\$,#(\d+),#(\d+)\);", x):
            assert (kinds[m[1]], kinds[m[2]]) == ("IFCWALL", "IFCOPENINGELEMENT")
        if "IFCRELCONTAINEDINSPATIALSTRUCTURE" in x:
            held = re.search(r"\(((?:#\d+,?)+)\),#(\d+)\)", x)
            assert sorted(kinds[i] for i in re.findall(r"\d+", held[1])) == sorted(["IFCWALL"] * 4 + ["IFCDOOR"] + ["IFCWINDOW"] * 2 + ["IFCSLAB", "IFCSTAIR"]) and kinds[held[2]] == "IFCBUILDINGSTOREY"


def test_entry_is_whole_without_llm(tmp_path):
    """The training-data folders and the pipeline may be deleted: the rest imports, with all its queries."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "storeyline", tmp_path / "storeyline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert {'kern_wall_pairs', 'geo_scale', 'geo_ifc'} <= set(q) and set(o) <= set(q); print(len(q), [k for k in q if k.startswith('op') or k == 'pipeline'])"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120, check=True).stdout.split()
    assert int(said[0]) == len(registry.queries()) and said[1] == "[]"


def test_host_of_odd_intervals(spark, tmp_path):
    """Long, fractional, empty and endless intervals, days without orders, equal days, keys in any order."""
    import random
    from datetime import datetime, timedelta

    import pyarrow as pa
    import pyarrow.parquet as pq

    r, day = random.Random(3), lambda d: datetime(1992, 1, 1) + timedelta(days=d)
    lengths = [-3.0, 0.0, 0.25, 1.0, 29.5, 30.0, 30.25, 50.0, 60.0, 75.5, 200.0, 5000.0, float("inf")]
    lines = [(i, i % 3, r.randrange(4), i % 7, r.choice(lengths), day(r.choice([0, 40, 90, 150, 400, 9000]) + r.randrange(60))) for i in range(600)]
    names = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_shipdate"]
    pq.write_table(pa.table(dict(zip(names, zip(*lines)))), tmp_path / "lineitem.parquet")
    orders = [(k, r.randrange(4), day(r.choice([10, 45, 60, 130, 380, 9020]) + r.randrange(25))) for k in r.sample(range(10**6), 150)]
    orders += [(2 * 10**6 + k, 100, day(3 * k)) for k in range(150)]  # numbers that rise with the days
    pq.write_table(pa.table(dict(zip(["o_orderkey", "o_custkey", "o_orderdate"], zip(*orders)))), tmp_path / "orders.parquet")
    c = duckdb.connect()
    for t in ("lineitem", "orders"):
        c.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet')")
    theirs = sorted(c.execute(f"select plan_id, seq, host, shared from ({registry.oracle_sql()['kern_host']})").fetchall())
    assert sorted(tuple(x) for x in registry.queries()["kern_host"](spark, str(tmp_path)).collect()) == theirs


def test_host_ranks_no_pairs(spark):
    """The rows that overlap grow with the square of a table: none may be sorted to find the best."""
    plan = registry.queries()["kern_host"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("row_number") == 1 and "Window [row_number() windowspecdefinition(plan_id" not in plan  # the numbering of segments
