"""Helpers that several operators share: scratch tables, iteration over Arrow batches, components."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a narrow table (a few longs a row) may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 500_000
#: The letters that ASCII lower-casing maps.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, ``spark.checkpoint.dir``.

    Where the setting is absent a local session uses a folder in /tmp; on a cluster its absence is an
    error, as no other place is known to be shared.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "/tmp/checkpoints"
    return f"{base.rstrip('/')}/attestra/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables that ``written`` made and that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for t in tables:
        for f in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if a count shows that it has at most ``rows`` rows, else as it is."""
    return F.broadcast(df) if df.count() <= rows else df


#: Bytes of an Arrow batch that a Python function is given at once; a single longer row goes alone.
SLICE_BYTES = 8 << 20
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """``b`` in parts of about SLICE_BYTES, so that what Python makes of a part stays small."""
    step = max(1, b.num_rows // max(1, -(-b.nbytes // SLICE_BYTES)))
    for at in range(0, b.num_rows, step):
        yield b.slice(at, step)


def give_back() -> None:
    """Return freed memory to the system; a worker lives on after its task, beside those of other stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def arrow_map(df: DataFrame, f: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``f`` on every Arrow batch of ``df``, a part at a time.

    A session that names no bound for the bytes of a batch gets SLICE_BYTES, so that the JVM's copy of a
    batch, which a count of rows alone doesn't bound, stays as small as Python's.
    """
    if BATCH_BYTES not in df.sparkSession.conf.getAll:
        df.sparkSession.conf.set(BATCH_BYTES, str(SLICE_BYTES))

    def run(batches):
        for b in batches:
            for part in slices(b):
                yield from f(part)
        give_back()

    return df.mapInArrow(run, schema)


def components(nodes: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """``(node, comp)``: the smallest node reachable over ``links(a, b)``, for each of ``nodes(node)``.

    Minimum labels pass over the links and each label is then replaced by its own label (pointer
    jumping), so the number of rounds grows with the logarithm of a component's diameter. Each round is
    a written table; nothing is collected but one counter.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    cur = written(nodes.select("node", F.col("node").alias("comp")), name)
    while True:
        near = both.join(cur.select(F.col("node").alias("b"), F.col("comp").alias("c")), "b").groupBy(F.col("a").alias("node")).agg(F.min("c").alias("c"))
        low = cur.join(near, "node", "left").select("node", F.col("comp").alias("was"), F.least("comp", F.coalesce("c", "comp")).alias("comp"))
        low = written(low, name)
        # few labels change in a round; only those that point at a node with a lower label need the jump
        jump = low.where("comp < node").select(F.col("node").alias("comp"), F.col("comp").alias("to"))
        new = written(low.join(jump, "comp", "left").select("node", "was", F.coalesce("to", "comp").alias("comp")), name)
        moved = new.where("comp <> was").limit(1).count()
        free(nodes.sparkSession, cur, low)
        cur = new.select("node", "comp")
        if not moved:
            return cur
