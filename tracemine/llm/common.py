"""What the text operators share: input columns, lineage cuts, connected components."""

from __future__ import annotations

import contextlib
import math
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The columns of the documents table, which every stage of the pipeline but the last hands on.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: Fixed pattern: ASCII white space, which separates words in the contracts.
SPACES = "[\\x20\\x09-\\x0D]+"


#: The setting by which Spark drops shuffle files at the end of an action.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder: the session's ``spark.checkpoint.dir``. Only a local session may go without one; it gets a temporary folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


@contextlib.contextmanager
def _tidy(spark: SparkSession) -> Iterator[None]:
    """Within, Spark drops an action's shuffle files as soon as it ends, not when the driver happens to collect its garbage. The session's setting is put back."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """Write df to the checkpoint folder and read it from there, so that lost executors do not send work back beyond this point."""
    _shared_folder(df.sparkSession)
    with _tidy(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # a plan of its own: df may run again, and then still has its shuffle files


def written(df: DataFrame) -> DataFrame:
    """As cut, but as a table in the checkpoint folder: for wide rows, of which later steps read a few columns each."""
    path = f"{_shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    with _tidy(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def empty_if_null(column: str):
    return F.coalesce(F.col(column), F.lit(""))


def words(text):
    """The ``[^\\x20\\x09-\\x0D]+`` of a text as an array."""
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def held_out(doc_id: str = "doc_id"):
    """True for the quarter of the documents whose labels are never learned from."""
    return F.crc32(F.col(doc_id).cast("string")) % 4 == 2


def running(df: DataFrame, order: list, sums: dict) -> DataFrame:
    """Adds the sum of each of ``sums`` (name: column of whole numbers) over the rows before this one, in the order of ``order``.

    Rows are put in order by range partitions; each is summed within its partition, and only the partitions' totals meet in one task.
    Rows that tie in order meet in one partition, so order should tell most rows apart.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    valued = df.withColumns({f"__{k}": c.cast("long") for k, c in sums.items()})
    placed = cut(valued.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    so_far = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("__part").agg(*(F.sum(f"__{k}").alias(f"__{k}") for k in sums))
    before = totals.select("__part", *(F.coalesce(F.sum(f"__{k}").over(so_far), F.lit(0)).alias(f"__{k}_before") for k in sums))
    own = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.withColumns({k: F.coalesce(F.sum(f"__{k}").over(own), F.lit(0)) for k in sums}).join(F.broadcast(before), "__part")  # a row per partition
    return summed.select(*df.columns, *((F.col(k) + F.col(f"__{k}_before")).alias(k) for k in sums))


def signed(x: int) -> int:
    """A 64-bit pattern as Spark's long."""
    return x - (1 << 64) if x >= 1 << 63 else x


#: Tasks that the rows of one hot key are dealt to in a join.
SALTS = 16


def salt(*columns):
    """Which of its key's SALTS tasks a row goes to."""
    return F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int")


def salts_of(column):
    """An aggregate: the salts that a key's rows have, as bits."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1), column))


def per_salt(df: DataFrame, salts: str = "salts", name: str = "salt") -> DataFrame:
    """A row of df for each of the salts that its key's rows have, so that a join on key and salt finds it; few keys have several rows, and so several salts."""
    bit = lambda i: F.call_function("shiftleft", F.lit(1), i).bitwiseAND(F.col(salts)) != 0
    return df.withColumn(name, F.explode(F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), bit))).drop(salts)


#: Edges that a task takes at most where the session has more tasks than so many edges ask for, and the least number of tasks.
EDGES_OF_TASK, LEAST_TASKS = 50_000, 12


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of all edges of one task: a node's parent is a smaller one of its component, or itself."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for b in batches:
        for u, v in zip(b.column("u").to_pylist(), b.column("v").to_pylist(), strict=True):
            a, z = sorted((root(u), root(v)))
            parent[z] = a
    found = [(x, r) for x in parent if (r := root(x)) != x]
    yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["node", "component"])


def components(edges: DataFrame) -> DataFrame:
    """Connected components by alternating large-star and small-star.

    edges: columns ``u``, ``v`` (long). Self-loops and repeats are allowed. Returns ``node``, ``component`` (the smallest node
    reachable) for every node that has an edge to another one and is not itself the smallest. Each round is a fixed number of
    group-and-join steps on keys, without a collected neighbour list, and is cut by a checkpoint. The edges of a node with many are
    dealt over several tasks by a salt of their other end. Tasks follow the number of edges where the session has more, so few edges leave few files.
    The rows of salts are not broadcast: Spark sizes them by the nodes, of which each may have SALTS of them. Edges that are no more than a task's are done by one, without
    rounds, each of which would leave the driver plans, threads and small broadcasts.
    """
    now = cut(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    most = int(now.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    before = None

    def with_least(rows: DataFrame, least) -> DataFrame:
        salted = rows.withColumn("salt", salt("v"))
        known = per_salt(few(salted.groupBy("u").agg(least.alias("m"), salts_of(F.col("salt")).alias("salts"))))
        return few(salted.join(known.hint("merge"), ["u", "salt"]))

    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        if state[0] <= EDGES_OF_TASK:
            found = now.coalesce(1).mapInArrow(_united, "node long, component long")
            return cut(found.repartition(min(LEAST_TASKS, most), "node"))
        before = state
        tasks = max(LEAST_TASKS, math.ceil(state[0] / EDGES_OF_TASK))
        few = lambda df: df.coalesce(tasks) if tasks < most else df  # noqa: B023, E731
        now = few(now)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both, F.least("u", F.min("v"))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = few(large)
        small = with_least(large, F.min("v")).select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        now = cut(few(small.where("u != v").distinct()))
