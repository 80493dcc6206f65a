"""Helpers shared by the training-data operators: work tables, batching, segments."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import time
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from contextlib import AbstractContextManager, ExitStack, contextmanager, suppress
from pathlib import Path

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphweave.sources.pin import shared_dir

#: Bound on an Arrow batch of texts on its way to a Python worker.
BYTES_PER_BATCH = 2 << 20
#: Parquet looks at the sizes of pages and row groups from the first row on, not after a hundred, which can be gigabytes.
LONG_ROWS = {"parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1", "parquet.block.size": str(16 << 20)}
#: The driver is relieved no more often than every so many seconds, and its heap collected when more than this share of it is in use or reserved.
RELIEF_EVERY, HEAP_SHARE = 5.0, 0.5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session for what is computed within."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def materialize(df: DataFrame, label: str, narrow: bool = False, long: bool = False) -> DataFrame:
    """Cuts the lineage: writes ``df`` to the shared folder and reads it back. The write's shuffle files go when it has ended.

    ``narrow`` tables, of a few numbers a row, are written in no more files than the cluster has cores.
    ``long``: ``df`` reads or has texts or sets, and one may take megabytes. Its tables are then read
    row by row rather than thousands at once, and it is written in pages that end by their size.
    """
    spark, path = df.sparkSession, work_path(df.sparkSession, label)
    if narrow:
        df = df.coalesce(spark.sparkContext.defaultParallelism)
    with ExitStack() as stack:
        stack.enter_context(setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"))
        if long:
            stack.enter_context(setting(spark, "spark.sql.parquet.enableVectorizedReader", "false"))
        df.write.options(**LONG_ROWS if long else {}).parquet(path)
    read = spark.read.schema(df.schema).parquet(path)
    read.work_path = path
    relieve(spark)
    return read


_relieved = 0.0


def relieve(spark: SparkSession) -> None:
    """Has the driver's JVM drop what ended queries left there, and return what it has freed.

    Queries with many stages leave plans, broadcasts and task results to a heap that grows rather
    than collect them, and freed memory in the pools of the C library's many threads.
    """
    global _relieved
    if time.monotonic() - _relieved < RELIEF_EVERY:
        return
    heap = spark._jvm.java.lang.Runtime.getRuntime()
    if heap.totalMemory() > HEAP_SHARE * heap.maxMemory():
        spark._jvm.java.lang.System.gc()
    trim(spark)
    _relieved = time.monotonic()


def trim(spark: SparkSession) -> str | None:
    """The driver's JVM returns freed native memory to the system, and says how much; None where it can't."""
    jvm, new = spark._jvm, spark.sparkContext._gateway.new_array
    with suppress(Py4JError):  # JVMs before 17.0.9, and others, have no such command
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        # the server's own class is not open to reflection, its interface is
        kinds = new(jvm.java.lang.Class, 4)
        for k, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[k] = jvm.java.lang.Class.forName(kind)
        values = new(jvm.java.lang.Object, 4)
        values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        return jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(server, values)
    return None


def discard(*tables: DataFrame) -> None:
    """Deletes work tables of ``materialize`` that nothing will read again; those that a result reads stay until the cluster's shared folder is cleaned."""
    for table in tables:
        jvm, path = table.sparkSession._jvm, table.work_path
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, unless they find it by PYTHONPATH or the working folder anyway."""
    root, context = Path(__file__).resolve().parents[2], spark.sparkContext
    known = {Path(p).resolve() for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)] if p}
    if context.applicationId in _shipped or root in known or not root.is_dir():
        return
    _shipped.add(context.applicationId)
    target = Path(os.path.realpath(tempfile.mkdtemp(prefix="graphweave-"))) / "graphweave_package.zip"
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted((root / "graphweave").rglob("*.py")):
            out.write(path, path.relative_to(root))
    context.addPyFile(str(target))


def bounded_batches(spark: SparkSession, size: int = BYTES_PER_BATCH) -> None:
    """Keeps Arrow batches small in bytes, however long the texts are, so that a Python worker holds few of them at once.

    Frames are lazy and the session's setting counts when they are computed, so it stays; a smaller one is left as it is.
    """
    ship(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    found = re.fullmatch(r"(\d+)([a-z]*)", spark.conf.get(key).lower())
    units = {"": 1, "b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30}
    if not found or not 0 < int(found[1]) * units.get(found[2], 1 << 40) <= size:
        spark.conf.set(key, str(size))


def batches_of(spark: SparkSession, rows: int) -> AbstractContextManager[None]:
    """Larger Arrow batches for what is computed within, where rows are a few numbers."""
    return setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def joined(batches: Iterable[pa.RecordBatch], size: int = 6 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive batches put together to about ``size`` bytes; a batch that is larger comes alone."""
    held: list[pa.RecordBatch] = []
    total = 0
    for batch in batches:
        if held and total + batch.nbytes > size:
            yield pa.concat_batches(held)
            held, total = [], 0
        held.append(batch)
        total += batch.nbytes
    if held:
        yield pa.concat_batches(held)


_kept: dict[tuple, object] = {}


def once(build: Callable, *args):
    """One object for each worker process, until the worker turns to other work."""
    if (key := (build, *args)) not in _kept:
        _kept[key] = build(*args)
    return _kept[key]


def give_back() -> None:
    """Returns what Python and Arrow have freed to the system; workers live on and share their executor's memory."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # other C libraries keep what they like
        ctypes.CDLL(None).malloc_trim(0)


def tidied(run: Callable[[Iterator], Iterator], keeps: bool = False) -> Callable[[Iterator], Iterator]:
    """A function for ``mapInPandas`` or ``mapInArrow`` that leaves its worker small; ``keeps``: what ``once`` built stays."""

    def tidy(batches: Iterator) -> Iterator:
        if not keeps:
            _kept.clear()
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidy


def with_results(docs: DataFrame, text: str, keep: Sequence[str], results: Mapping[str, str | T.DataType], make: Callable[[], Callable[[list[str | None]], Sequence[pa.Array]]]) -> DataFrame:
    """The columns ``keep`` of ``docs`` and the columns ``results`` (name to type) that the function of ``make`` gives for a list of texts.

    ``make`` is called once for each task. What is kept passes through Arrow untouched, whatever its
    type, nulls and name; a kept column that is named as a result gives way to it.
    """
    bounded_batches(docs.sparkSession)
    kept = [c for c in keep if c not in results]
    places = {c: f"keep_{k}" for k, c in enumerate(kept)}
    inner = docs.select(*[F.col(f"`{c}`").alias(a) for c, a in places.items()], F.col(text).alias("whole_text"))
    out = inner.drop("whole_text").schema
    for name, kind in results.items():
        out = out.add(f"result_{name}", kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in batches:
            found = function(batch.column("whole_text").to_pylist())
            yield pa.RecordBatch.from_arrays([*[batch.column(a) for a in places.values()], *found], names=out.names)

    done = inner.mapInArrow(tidied(run), out)
    return done.select(*[F.col(a).alias(c) for c, a in places.items()], *[F.col(f"result_{name}").alias(name) for name in results])


def learns(doc_id: str = "doc_id") -> Column:
    """Rows that a model may learn from; the others are held out."""
    return F.crc32(F.col(doc_id).cast("string")) % 5 != 0


def held_out(doc_id: str = "doc_id") -> Column:
    """A null id hashes to nothing and counts as not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def by_size(texts: Sequence[str], chars: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``chars`` characters together, one text at least."""
    begin = total = 0
    for k, text in enumerate(texts):
        total += len(text)
        if total >= chars:
            yield begin, k + 1
            begin, total = k + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``begin[i], begin[i]+1, ...`` (``count[i]`` numbers) for each i, one after another."""
    ends = np.cumsum(count, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if total < 2**31 and (not len(begin) or int(begin.max()) < 2**31) else np.int64
    out = np.repeat((np.asarray(begin, np.int64) - (ends - count)).astype(kind), count)
    out += np.arange(total, dtype=kind)
    return out


def texts_of(values: Iterable) -> list[str]:
    """Null texts count as empty."""
    return [v if v is not None else "" for v in values]
