"""Readers, writers and streams as queries: rows that the adapters derive go to files in the checkpoint folder and come back through the operator."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemine.operators.ordered import shared_folder, written
from tracemine.plans.mining_queries import _KINDS, LIMIT, all_kinds
from tracemine.plans.registry import query
from tracemine.sources import logs as S
from tracemine.streaming import streams as T


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def _lines(df: DataFrame) -> str:
    """Where the rows now are, as JSON lines."""
    path = _folder(df.sparkSession)
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.text(path)
    return path


def _entries(rows: DataFrame) -> DataFrame:
    """The nested entries of a log."""
    of = lambda kind, s: F.when(F.col("kind") == kind, s).alias(kind)
    loc = F.struct(F.col("loc_id").alias("astLocId"))
    nothing = F.struct(F.lit(None).cast("array<string>").alias("taintQuery"))
    return rows.select(
        F.concat_ws(":", "trace_id", F.col("seq").cast("string")).alias("instr"), of("fileTaintMatch", F.struct("filename")), of("sourceTraceId", loc), of("taintedBranch", nothing), of("taintQueryPri", nothing),
        of("attackPoint", F.struct(F.lit(1).alias("info"), loc.alias("srcInfo"))),
    )


@query(
    "SELECT concat(trace_id, ':', seq) AS instr, kind, filename, CASE WHEN kind IN ('sourceTraceId', 'attackPoint') THEN loc_id END AS loc_id FROM fx_entry", rows="fx_entry",
)
def s1_read_trace_log(rows):
    log = S.read_trace_log(rows.sparkSession, _lines(_entries(rows)))
    return log.select("instr", "kind", F.col("fileTaintMatch.filename").alias("filename"), F.coalesce("sourceTraceId.astLocId", "attackPoint.srcInfo.astLocId").alias("loc_id"))


@query(
    """SELECT concat(trace_id, ':', seq) AS instr, kind, filename, CASE WHEN kind IN ('sourceTraceId', 'attackPoint') THEN loc_id END AS loc_id, row_number() OVER (PARTITION BY trace_id ORDER BY seq) - 1 AS seq FROM fx_entry""",
    rows="fx_entry",
)
def s1_read_json_arrays(rows):
    """A root array per trace, whose names of files hold braces, quotes and backslashes; seq is the entry's number in it."""
    spark, path = rows.sparkSession, _folder(rows.sparkSession)
    odd = "}{\\\"]["
    named = rows.withColumn("filename", F.concat(F.lit(odd), "filename"))
    text = F.to_json(F.struct(*_entries(named).columns))
    each = _entries(named).select(text.alias("value"), F.split("instr", ":")[0].alias("trace_id"), F.split("instr", ":")[1].cast("long").alias("seq"))
    first = F.row_number().over(Window.partitionBy("trace_id").orderBy("seq")) == 1
    lines = each.withColumn("value", F.concat(F.when(first, "[").otherwise(","), "value")).unionByName(each.groupBy("trace_id").agg(F.max("seq").alias("seq")).withColumn("value", F.lit("]")))
    lines.repartition("trace_id").sortWithinPartitions("trace_id", "seq", "value").select("value", "trace_id").write.partitionBy("trace_id").text(path)
    log = S.read_trace_log(spark, path, "json_array")
    name = F.expr("substr(fileTaintMatch.filename, 7)")
    return log.select("instr", "kind", name.alias("filename"), F.coalesce("sourceTraceId.astLocId", "attackPoint.srcInfo.astLocId").alias("loc_id"), "seq")


_STRINGS = "SELECT CAST(c_custkey AS INT) AS id, concat(c_name, chr(9), c_mktsegment) AS value FROM customer"


@query(_STRINGS, rows=_STRINGS)
def s2_read_string_dict(rows):
    """Values may hold tabs."""
    path = _folder(rows.sparkSession)
    rows.select(F.concat_ws("\t", F.col("id").cast("string"), "value").alias("value")).write.text(path)
    return S.read_string_dict(rows.sparkSession, path)


@query("SELECT concat(CAST(c_custkey AS STRING), chr(9), c_name) AS line FROM customer", rows="SELECT CAST(c_custkey AS INT) AS id, c_name AS value FROM customer")
def s3_write_string_dict(rows):
    path = _folder(rows.sparkSession)
    S.write_string_dict(rows, path)
    return rows.sparkSession.read.text(path).withColumnRenamed("value", "line")


_FUN = "SELECT name, hasbody, concat('src/', name, '.c:3') AS start, CASE WHEN name LIKE '%3' THEN concat('src/', name, '.c:3') ELSE concat('src/', name, '.c:9') END AS fin FROM fx_fun"


@query(
    f"SELECT 'fun' AS what, name, split_part(start, ':', 1) AS place FROM ({_FUN}) f WHERE start <> fin UNION ALL SELECT 'call' AS what, name, containing_function AS place FROM fx_callgraph UNION ALL SELECT 'assign' AS what, name, NULL AS place FROM fx_assign",
    fun=_FUN, calls="fx_callgraph", assigns="fx_assign",
)
def s5_read_function_facts(fun, calls, assigns):
    rows = fun.select(F.struct("name", "hasbody", "start", F.col("fin").alias("end")).alias("fun"))
    rows = rows.unionByName(calls.select(F.struct("name", "containing_function").alias("call")), allowMissingColumns=True).unionByName(assigns.select(F.struct("name").alias("fnPtrAssign")), allowMissingColumns=True)
    facts = S.read_function_facts(fun.sparkSession, _lines(rows))
    places = {"fun": ("fun", F.col("filename")), "call": ("call", F.col("containing_function")), "fn_ptr_assign": ("assign", F.lit(None).cast("string"))}
    one, two, three = (facts[k].select(F.lit(what).alias("what"), "name", place.alias("place")) for k, (what, place) in places.items())
    return one.unionByName(two).unionByName(three)


_COMMANDS = "SELECT concat('/src/d', CAST(c_nationkey AS STRING)) AS directory, concat(CASE WHEN c_custkey % 3 = 0 THEN '/abs/' ELSE '' END, 'f', CAST(c_custkey % 900 AS STRING), CASE WHEN c_custkey % 4 = 0 THEN '.h' ELSE '.c' END) AS file, c_custkey AS id FROM customer"


@query(
    f"SELECT DISTINCT 'dir' AS what, directory AS path FROM ({_COMMANDS}) c UNION ALL SELECT DISTINCT 'file' AS what, CASE WHEN file LIKE '/%' THEN file ELSE concat(directory, '/', file) END AS path FROM ({_COMMANDS}) d WHERE file LIKE '%.c'",
    rows=_COMMANDS,
)
def s6_read_compile_commands(rows):
    """Files of up to 10,000 commands each."""
    path = _folder(rows.sparkSession)
    arrays = rows.groupBy(F.floor(F.col("id") / 10_000).alias("of")).agg(F.to_json(F.collect_list(F.struct("directory", "file"))).alias("value"))
    arrays.write.partitionBy("of").text(path)
    dirs, files = S.read_compile_commands(rows.sparkSession, path)
    return dirs.select(F.lit("dir").alias("what"), F.col("dir").alias("path")).unionByName(files.select(F.lit("file").alias("what"), "path"))


@query("SELECT CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS length, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS n_bytes FROM benchmark WHERE text IS NOT NULL", rows="SELECT text FROM benchmark WHERE text IS NOT NULL")
def s7_read_corpus(rows):
    """The bytes of files that hold a text and a line end each time."""
    path = _folder(rows.sparkSession)
    rows.select(F.col("text").alias("value")).write.text(path)
    return S.read_corpus(rows.sparkSession, path).agg(F.sum("length").alias("length"), F.sum(F.octet_length("content")).alias("n_bytes"))


@query("SELECT inputfile, atp, instr FROM fx_exec UNION ALL SELECT file AS inputfile, CAST(type AS STRING) AS atp, atp AS instr FROM fx_atp", execs="SELECT instr, inputfile, atp FROM fx_exec", points="fx_atp")
def s8_write_entities(execs, points):
    """Tables with and without an input file, read again."""
    path = _folder(execs.sparkSession)
    S.write_entities({"atp_execution": execs, "attack_point": points}, path)
    found = S.read_entities(execs.sparkSession, path, ["atp_execution", "attack_point"])
    return found["atp_execution"].select("inputfile", "atp", "instr").unionByName(found["attack_point"].select(F.col("file").alias("inputfile"), F.col("type").cast("string").alias("atp"), F.col("atp").alias("instr")))


@query(
    "SELECT 'bug' AS name, count(*) AS n FROM fx_bug UNION ALL SELECT 'label_set' AS name, CAST(0 AS BIGINT) AS n UNION ALL SELECT 'dua_viable_byte' AS name, CAST(0 AS BIGINT) AS n",
    bugs="fx_bug", sets="SELECT ptr, label1 FROM fx_elem", viable="SELECT dua_bytes, low FROM fx_dua_bytes",
)
def s12_truncate_for_rerun(bugs, sets, viable):
    """How many rows each table has afterwards."""
    spark, path = bugs.sparkSession, _folder(bugs.sparkSession)
    S.write_entities({"bug": bugs, "label_set": sets, "dua_viable_byte": viable}, path)
    S.truncate_for_rerun(spark, path)
    one, two, three = (df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in S.read_entities(spark, path, ["bug", "label_set", "dua_viable_byte"]).items())
    return one.unionByName(two).unionByName(three)


#: Rows of a batch, so that what a task of a stream takes at once does not grow with the table.
BATCH_ROWS = 2_000_000


def _followed(rows: DataFrame, operator, mode: str = "update", order: str | None = None, batches: int = 3) -> DataFrame:
    """What a streaming operator has emitted when it has followed rows to their end, some files a batch; with order, rows arrive in that many batches or, if they are many, in batches of about BATCH_ROWS, each beyond the one before."""
    spark, path = rows.sparkSession, _folder(rows.sparkSession)
    if order is None:
        rows.write.parquet(f"{path}/in")
        arriving = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 8).parquet(f"{path}/in")
    else:
        kept = written(rows)
        batches = max(batches, -(-kept.count() // BATCH_ROWS))
        kept.repartitionByRange(batches, order).withColumn("batch", F.spark_partition_id()).write.partitionBy("batch").parquet(f"{path}/dealt")
        dealt = spark.read.schema(rows.withColumn("batch", F.lit(0)).schema).parquet(f"{path}/dealt")
        for i in range(batches):  # files are followed in the order in which they were written
            dealt.where(F.col("batch") == i).select(*rows.columns).coalesce(1).write.mode("append").parquet(f"{path}/in")
        arriving = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    writer = operator(arriving).writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
    writer.foreachBatch(keep).start().awaitTermination()
    return spark.read.parquet(f"{path}/out")


@query("SELECT inputfile, label, count(*) AS death_instr FROM fx_branch GROUP BY inputfile, label", rows="SELECT inputfile, label FROM fx_branch")
def t1_stream_liveness(rows):
    """The last update of each label."""
    return _followed(rows, T.stream_liveness).groupBy("inputfile", "label").agg(F.max("death_instr").alias("death_instr"))


@query("SELECT kind, count(*) AS n FROM fx_entry GROUP BY kind", rows="SELECT kind FROM fx_entry")
def t3_stream_counters(rows):
    """The last update of each kind."""
    return _followed(rows, T.stream_counters).groupBy("kind").agg(F.max("n").alias("n"))


@query(f"SELECT trace_id, CAST(lval AS STRING) AS lval, seq, \"end\", reason FROM ({_KINDS}) y", rows="fx_bytes", branches="fx_branch")
def t2_stream_dua_state(rows, branches):
    """What the stream says of each DUA, put together: when it was born, and its end."""
    spark = rows.sparkSession
    before = {k: spark.conf.get(k, None) for k in T.STATE_STORE}
    try:
        for k, v in T.STATE_STORE.items():
            spark.conf.set(k, v)
        said = _followed(all_kinds(rows, branches), lambda events: T.stream_dua_state(events, LIMIT), "append", "seq")
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    ends = said.where("what IN ('replaced', 'died')").select("trace_id", "lval", "since", F.col("seq").alias("end"), F.col("what").alias("reason"))
    born = said.where("what = 'born'").select("trace_id", "lval", F.col("seq").alias("since"))
    whole = born.join(ends, ["trace_id", "lval", "since"], "left")
    return whole.select("trace_id", "lval", F.floor(F.col("since") / 2).alias("seq"), F.floor(F.col("end") / 2).alias("end"), F.coalesce("reason", F.lit("alive")).alias("reason"))
