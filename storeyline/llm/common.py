"""What the operators of this subpackage share: table access and tables cut from their lineage."""

from __future__ import annotations

import atexit
import contextlib
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField

_SCRATCH: list[tuple[SparkSession, str]] = []


_HELD: dict[Any, Any] = {}


def held(key: Any, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps from task to task: one operator's tables at a time, so that a worker
    that serves several operators in turn does not add them up."""
    if key not in _HELD:
        _HELD.clear()
        gc.collect()
        _HELD[key] = make()
    return _HELD[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Where that setting is absent (tests on one machine) a folder of the session is set once.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not base:
        base = tempfile.mkdtemp(prefix="storeyline-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/storeyline-{uuid.uuid4().hex}"
    _SCRATCH.append((spark, path))
    return path


def released(spark: SparkSession) -> None:
    """Has the driver's JVM collect its garbage and give freed native memory back to the system.

    A driver that plans many queries from many threads keeps freed memory in as many native heaps, several
    hundred MB of it; HotSpot's diagnostic command hands it back. Other JVMs do not have the command."""
    jvm = spark._jvm
    jvm.System.gc()
    make = spark.sparkContext._gateway.new_array
    of = jvm.java.lang.Class.forName
    types, none, names = make(jvm.java.lang.Class, 4), make(jvm.java.lang.Object, 0), make(jvm.java.lang.String, 0)
    types[0], types[1], types[2], types[3] = of("javax.management.ObjectName"), of("java.lang.String"), none.getClass(), names.getClass()
    bean = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    values = make(jvm.java.lang.Object, 4)
    values[0], values[1], values[2], values[3] = bean, "systemTrimNativeHeap", none, names
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    with contextlib.suppress(Py4JJavaError):
        of("javax.management.MBeanServer").getMethod("invoke", types).invoke(server, values)


@contextlib.contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def stored(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """``written`` and a function that deletes the table, for tables that are done with early.

    Left to itself, Spark deletes the shuffle files of a finished query when its plan is collected as
    garbage on the driver, which listeners that still hold the plan put off; so it is told to delete
    them when the query ends. Collecting garbage keeps driver memory at what one step needs."""
    path = scratch_dir(df.sparkSession)
    with _setting(df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.option("compression", "zstd").parquet(path)
    released(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path), lambda: _delete(df.sparkSession, path)


def written(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in shared storage and read back: its lineage ends there, and
    a lost executor costs a re-read instead of the work before it."""
    return stored(df)[0]


def _delete(spark: SparkSession, path: str) -> None:
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _SCRATCH:
        try:
            _delete(spark, path)
        except Exception:  # the session has ended: the folder goes with the cluster's retention
            return


def crc_mod(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null ids count as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def positional(df: DataFrame, keys: list[Column], text: Column) -> tuple[DataFrame, list[StructField]]:
    """(the keys and the text as a string under names by place, the keys' fields): no names can clash."""
    named = df.select(*keys, text.cast("string"))
    return named.toDF(*(f"c{i}" for i in range(len(named.columns)))), named.schema.fields[:-1]


def column_or_null(df: DataFrame, name: str, kind: str) -> Column:
    """The column cast to ``kind``, or nulls if the frame has none of that name."""
    return F.col(f"`{name}`").cast(kind) if name in df.columns else F.lit(None).cast(kind)


def bounded_batches(spark: SparkSession) -> SparkSession:
    """Arrow batches small enough for long texts, unless the session says otherwise."""
    for key, value in {"spark.sql.execution.arrow.maxRecordsPerBatch": "400", "spark.sql.execution.arrow.maxBytesPerBatch": str(2 << 20)}.items():
        if spark.conf.get(key, None) in (None, "10000", "-1", "67108864", "64MB", "256MB", str(256 << 20)):
            spark.conf.set(key, value)
    return spark
