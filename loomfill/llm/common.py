"""Shared helpers: written tables, ASCII case folding and word rules."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import tempfile
import time
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the contracts: words are runs of anything but these bytes.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Tables of up to so many bytes, as measured, are broadcast; larger ones are shuffled.
BROADCAST_BYTES = 32 << 20
#: A key is hot when it holds more than this share of all rows, so there are no more than 4,096 of them.
HOT_KEYS = 4_096

_folders: dict[str, str] = {}
_trims: dict[str, tuple | None] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """This application's folder inside ``spark.checkpoint.dir``, or else the context's checkpoint folder.

    Only a session on one machine may do without either; it gets a private
    temporary folder. Elsewhere every executor would write to its own disk, so
    that is refused.
    """
    context = spark.sparkContext
    app = context.applicationId
    if app not in _folders:
        top = spark.conf.get("spark.checkpoint.dir", None)
        if not top and (named := context._jsc.sc().getCheckpointDir()).isDefined():
            top = named.get()
        if not top:
            if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            top = "file://" + tempfile.mkdtemp(prefix="loomfill-")
        _folders[app] = f"{top.rstrip('/')}/loomfill-{app}"
        atexit.register(_remove, spark, _folders[app])
    return _folders[app]


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session may be gone; the folder is then left to the cluster
        pass


def few(spark: SparkSession, share: int) -> int:
    """One file for so many shuffle partitions."""
    return max(4, int(spark.conf.get("spark.sql.shuffle.partitions")) // share)


def written(df: DataFrame, name: str, share: int = 1) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, and
    any executor can reread the files when another one is lost.

    With ``share``, a table that is small beside its input is dealt out again,
    after all its steps, to one file for so many shuffle partitions.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    schema = df.schema
    if share > 1:
        df = df.repartition(few(spark, share))
    df.write.parquet(path)
    trim_driver(spark)
    return spark.read.schema(schema).parquet(path)


def trim_driver(spark: SparkSession) -> bool:
    """Have the driver's JVM give back what it has freed outside its heap, some 100 MB
    after many plans: glibc keeps it otherwise. False where a JVM knows no such command."""
    app = spark.sparkContext.applicationId
    try:
        if app not in _trims:
            jvm, _trims[app] = spark._jvm, None
            # By reflection, as the server's own class is not public.
            methods = jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods()
            invoke = next(m for m in methods if m.getName() == "invoke")
            args = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
            args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
            server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
            invoke.invoke(server, args)
            _trims[app] = invoke, server, args
        elif _trims[app]:
            invoke, server, args = _trims[app]
            invoke.invoke(server, args)
    except Exception:  # another JVM, or an older one
        _trims[app] = None
    return _trims[app] is not None


def bounded(table: DataFrame) -> bool:
    """Whether a written table is within ``BROADCAST_BYTES``: 24 bytes for each value besides what strings and lists hold."""
    size = F.lit(24 * len(table.columns))
    for name, kind in table.dtypes:
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(name), F.lit(0))
        elif not kind.startswith(("tinyint", "smallint", "int", "bigint", "double", "float", "boolean", "date", "timestamp", "decimal")):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(name))), F.lit(0))
    return (table.agg(F.sum(size.cast("long")).alias("size")).first().size or 0) <= BROADCAST_BYTES


def either(table: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it is within the bound."""
    return F.broadcast(table) if bounded(table) else table


def only_keys(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """``df``'s rows with a key in the written table ``keys``; broadcast only after measuring."""
    return df.join(either(keys.select(on)), on, "left_semi").select(*df.columns)


def look_up(rows: DataFrame, found: DataFrame, on: list[str], count: str, spread: Column | None = None) -> DataFrame:
    """Inner join of ``rows`` with the written table ``found``, which has one row for each of its
    keys and in ``count`` how many of ``rows`` hold it; keys are never null.

    Hot keys, ``HOT_KEYS`` at most, are broadcast. In the shuffled part, their rows
    are spread evenly by ``spread``, a whole number, or else by their place in
    ``rows``, which then is a scan, so that every attempt numbers it alike.
    """
    total = found.agg(F.sum(count).alias("n")).first().n or 0
    values = [c for c in found.columns if c not in on and c != count]
    hot = found.where(F.col(count) * HOT_KEYS > total)
    if bounded(found):
        return rows.join(F.broadcast(found.drop(count)), on)
    hot = hot.select(*on, F.struct(*values).alias("hot_values"))
    place = F.when(F.col("hot_values").isNotNull(), F.monotonically_increasing_id() if spread is None else F.abs(spread))
    marked = rows.join(F.broadcast(hot), on, "left").withColumn("hot_place", place)
    rest = found.where(F.col(count) * HOT_KEYS <= total).select(*on, F.lit(-1).cast("long").alias("hot_at"), F.struct(*values).alias("rest_values"))
    spread = marked.withColumn("hot_at", F.coalesce("hot_place", F.lit(-1).cast("long")))
    joined = spread.join(rest, [*on, "hot_at"], "left").withColumn("looked_up", F.coalesce("hot_values", "rest_values"))
    return joined.where("looked_up IS NOT NULL").select(*rows.columns, *[F.col("looked_up").getField(c).alias(c) for c in values])


def odd_ids(docs: DataFrame, id_col: str) -> bool:
    """Whether an id is null or repeated, so that ids do not name rows."""
    counted = docs.groupBy(F.col(id_col).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return not counted.where("id IS NULL OR n > 1").isEmpty()


def row_key(first: Column, id_col: str, text_col: str) -> Column:
    """Never null, and equal for repeated rows (equal ids and texts) only; in the order of ``first``, then of ids."""
    digest = F.coalesce(F.sha2(F.col(text_col).cast("string"), 256), F.lit(""))
    return F.struct(first.alias("first"), F.col(id_col).alias("id"), digest.alias("digest"))


def keyed_rows(docs: DataFrame, first: Column, id_col: str, text_col: str) -> DataFrame:
    """``row, key, text``: each row whole, so that its columns may have any names, with its :func:`row_key`."""
    return docs.select(F.struct(*docs.columns).alias("row"), row_key(first, id_col, text_col).alias("key"), F.col(text_col).alias("text"))


def one_of_each(keyed: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of :func:`keyed_rows` with a ``key`` in the written table ``keys``, one for each key, combined in each task first."""
    return only_keys(keyed.select("key", "row"), keys, "key").groupBy("key").agg(F.first("row").alias("row")).select("row.*")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` does that for pure ASCII, and faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def small_batches(df: DataFrame) -> DataFrame:
    """Lower the session's limits of Arrow batches where they are higher, as texts may be long; they never change a result."""
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 256), ("spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20)):
        now = conf.get(key).removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            conf.set(key, str(most))
    return df


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now: its cleaner acts
    when the driver collects its garbage, which it may not do for long.

    Threads of listeners hold their last event, and so the last step's plan, until
    another one comes; an empty step sends some. The second collection finds what
    the first one's finalisers have let go.
    """
    gc.collect()
    spark.range(1).count()
    try:
        spark._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    except Exception:  # late or not to be reached: the files stay for longer
        pass
    for _ in range(2):
        spark._jvm.System.gc()
        time.sleep(0.2)


def release_memory() -> None:
    """Give back what this process has freed: allocators keep it otherwise, and it goes on counting as the process's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def tidy(run, free=None):
    """A worker function that gives its memory back when it ends: idle workers
    stay, and what their allocators keep counts as the executor's. ``free`` drops what it had cached."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            if free:
                free()
            release_memory()

    return wrapped


def key_chunks(batches, key: int = 0, rows: int = 200_000, size: int = 16 << 20):
    """Tables of whole keys from batches that come sorted by column ``key``.

    A table holds about ``rows`` rows or ``size`` bytes, or one key if that has
    more, so memory does not depend on the size of a shuffle partition.
    """
    held, n, weight = [], 0, 0
    for batch in batches:
        while batch.num_rows:
            if n < rows and weight < size:
                held.append(batch)
                n, weight = n + batch.num_rows, weight + batch.nbytes
                break
            keys, last = batch.column(key), held[-1].column(key)[-1]
            same = pc.equal(keys, last)
            cut = batch.num_rows if pc.all(same).as_py() else same.index(False).as_py()
            if cut:
                held.append(batch.slice(0, cut))
                batch = batch.slice(cut)
                if not batch.num_rows:
                    n, weight = n + cut, weight + size
                    break
            yield pa.Table.from_batches(held)
            held, n, weight = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)
