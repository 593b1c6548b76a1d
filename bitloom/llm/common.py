"""Helpers shared by the operators: table access, the shared work folder, Arrow mapping."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows that any operator broadcasts with a hint; larger sides are shuffled instead.
BROADCAST_ROWS = 100_000


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def work_dir(spark: SparkSession) -> str:
    """A new path below the session's spark.checkpoint.dir, which all executors share.

    Where neither that setting nor setCheckpointDir() names a folder, a local one is made if the session runs in one process (tests, a
    laptop); on a cluster that is an error, as executors would not see each other's files.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or getattr(context, "_bitloom_work", None)
    if not base:
        master = context.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = context._bitloom_work = "file://" + tempfile.mkdtemp(prefix="bitloom-")
        atexit.register(_remove, spark, base)
    path = f"{base.rstrip('/')}/bitloom-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone already
        return


#: Spark's setting by which a query's shuffle files go as soon as it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Spark's setting for the rows of an Arrow batch at most.
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextlib.contextmanager
def cleaned(spark: SparkSession, batch: int = 0):
    """Shuffle files of the queries that run within are deleted when each ends, not when the driver's collector finds them.

    batch: rows of an Arrow batch at most; 0: the session's setting.
    """
    settings = {CLEANUP: "true"} | ({BATCH_ROWS: str(batch)} if batch else {})
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def written(df: DataFrame, level: int = 0, batch: int = 0) -> DataFrame:
    """df cut from its lineage: written to the shared folder and read back. Its shuffle files go at once, the table with drop().

    level: of zstd, for large tables of text; 0: the session's compression. batch: as in cleaned().
    """
    path = f"{work_dir(df.sparkSession)}/t"
    with cleaned(df.sparkSession, batch):
        writer = df.write
        if level:
            writer = writer.option("compression", "zstd").option("parquet.compression.codec.zstd.level", str(level))
        writer.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._bitloom_path = path
    return table


def drop(*tables: DataFrame) -> None:
    """Deletes written() tables that nothing will read any more. What is not dropped goes when the driver ends."""
    for table in tables:
        _remove(table.sparkSession, table._bitloom_path)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most limit rows; reads no more of it than that takes."""
    with cleaned(df.sparkSession):
        return df.limit(limit + 1).count() <= limit


#: Bits of id_filter() for each id, and the least (32 KB) and most bits (8 MB) it has.
FILTER_RATE, FILTER_LEAST, FILTER_BITS = 16, 1 << 18, 1 << 26


def id_filter(ids: DataFrame, column: str):
    """A function of a column: whether it may be among the ids, wrong for one of FILTER_RATE others.

    The bits are built by an aggregation, as many as the number of ids asks for. With more ids than FILTER_BITS would
    serve, everything may be among them: the equi-join that always follows then does the work alone. For columns without null.
    """
    with cleaned(ids.sparkSession):
        n = ids.count()
    if n * 4 > FILTER_BITS:
        return lambda x: F.lit(True)
    size = min(FILTER_BITS, max(FILTER_LEAST, 1 << (n * FILTER_RATE).bit_length()))

    def place(x):
        return F.pmod(F.xxhash64(x, F.lit(7)), F.lit(size))

    at = place(F.col(column))
    words = ids.select(F.floor(at / 64).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(at, F.lit(64)).cast("int")).alias("b"))
    words = words.unionAll(ids.sparkSession.range(size // 64).select(F.col("id").cast("int").alias("w"), F.lit(0).cast("bigint").alias("b")))
    one = words.groupBy("w").agg(F.bit_or("b").alias("b")).agg(F.transform(F.sort_array(F.collect_list(F.struct("w", "b"))), lambda x: x["b"]).alias("bits"))
    table = one.scalar()
    return lambda x: F.call_function("shiftrightunsigned", F.get(table, F.floor(place(x) / 64).cast("int")), F.pmod(place(x), F.lit(64)).cast("int")).bitwiseAND(1) == 1


def arrow_schema(**kinds: str) -> pa.Schema:
    names = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64(), "int": pa.int32(), "longs": pa.list_(pa.int64()), "strings": pa.list_(pa.string())}
    return pa.schema([(k, names[v]) for k, v in kinds.items()])


def ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "bigint", pa.string(): "string", pa.binary(): "binary", pa.bool_(): "boolean", pa.float64(): "double", pa.int32(): "int", pa.list_(pa.int64()): "array<bigint>", pa.list_(pa.string()): "array<string>"}
    return ", ".join(f"`{f.name}` {names[f.type]}" for f in schema)


def pieces(batch: pa.RecordBatch, column: int, most: int = 8_000_000):
    """Slices of a batch whose binary or string column holds about `most` bytes each (one row at least)."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start = held = 0
    for i, n in enumerate(lengths):
        if i > start and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)
