"""Cleaning of mined tables: anti-joins and cascades."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemine.operators.mining import active_duas

#: The first kind of chaff; the one whose extra DUAs are not looked at.
FIRST_CHAFF, STACK_UNUSED = 5, 5


def drop_chaff_tied(bugs: DataFrame, lvals: DataFrame) -> DataFrame:
    """Drops bugs that are not chaff but whose trigger's name contains ``lava_chaff``. lvals: ``lval``, ``ast_name``."""
    tied = lvals.where(F.col("ast_name").contains("lava_chaff")).select(F.col("lval").alias("trigger_lval"))
    return bugs.where(F.col("kind") >= FIRST_CHAFF).unionByName(bugs.where(F.col("kind") < FIRST_CHAFF).join(tied, "trigger_lval", "left_anti"))


def drop_bugs_with_fake_duas(bugs: DataFrame, dua_bytes: DataFrame, duas: DataFrame) -> DataFrame:
    """Drops bugs whose trigger or, unless the stack is unused, some extra DUA is fake."""
    fake = dua_bytes.join(duas.where("fake_dua").select("dua"), "dua").select(F.col("dua_bytes").alias("bad"))
    uses = bugs.select("bug", F.col("trigger").alias("bad")).unionByName(bugs.where(F.col("kind") != STACK_UNUSED).select("bug", F.explode("extra_duas").alias("bad")))
    return bugs.join(uses.join(fake, "bad").select("bug").distinct(), "bug", "left_anti")


def delete_duas_cascade(lvals: DataFrame, duas: DataFrame, dua_bytes: DataFrame, bugs: DataFrame, pattern: str, before_line: int) -> dict[str, DataFrame]:
    """The tables without the lvalues whose name is LIKE pattern and that begin before a line, and without what depends on them."""
    gone = lvals.where(F.col("ast_name").like(pattern) & (F.col("begin_line") < before_line)).select("lval")
    gone_duas = duas.join(gone, "lval", "left_semi").select("dua")
    gone_bytes = dua_bytes.join(gone_duas, "dua", "left_semi").select("dua_bytes")
    bad = bugs.select("bug", F.explode(F.array_union(F.array("trigger"), "extra_duas")).alias("dua_bytes")).join(gone_bytes, "dua_bytes", "left_semi").select("bug").distinct()
    return {"lvals": lvals.join(gone, "lval", "left_anti"), "duas": duas.join(gone_duas, "dua", "left_anti"), "dua_bytes": dua_bytes.join(gone_bytes, "dua_bytes", "left_anti"), "bugs": bugs.join(bad, "bug", "left_anti")}


def relocate_siphons(duas: DataFrame, moves: DataFrame, traces: DataFrame) -> DataFrame:
    """Moves DUAs to the first step of the source trace at their new place that is not before their own; without one they become fake.

    duas: ``dua``, ``file``, ``line``, ``column``, ``trace_index``, ``fake_dua``; moves: ``dua``, ``new_line``, ``new_column``; traces: ``index``, ``file``, ``line``, ``column``. A move that does not lead to a later place of the file is ignored.
    """
    wanted = duas.join(moves, "dua").where("new_line > line OR (new_line = line AND new_column > column)")
    steps = traces.select("index", F.col("file").alias("__file"), F.col("line").alias("__line"), F.col("column").alias("__column"))
    at = (F.col("file") == F.col("__file")) & (F.col("new_line") == F.col("__line")) & (F.col("new_column") == F.col("__column")) & (F.col("index") >= F.col("trace_index"))
    found = wanted.join(steps, at, "left").groupBy("dua", "new_line", "new_column").agg(F.min("index").alias("__step"))
    moved = duas.join(found, "dua", "left")
    there = F.col("new_line").isNotNull() & F.col("__step").isNotNull()
    return moved.select(
        "dua", "file", F.when(there, F.col("new_line")).otherwise(F.col("line")).alias("line"), F.when(there, F.col("new_column")).otherwise(F.col("column")).alias("column"),
        F.when(there, F.col("__step")).otherwise(F.col("trace_index")).alias("trace_index"), (F.col("fake_dua") | (F.col("new_line").isNotNull() & F.col("__step").isNull())).alias("fake_dua"),
    )


def discard_unscoped(duas: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Makes DUAs fake that have no usable defining statement (``dua``, ``usable``); those without a verdict stay as they are."""
    return duas.join(verdicts, "dua", "left").withColumn("fake_dua", F.col("fake_dua") | ~F.coalesce("usable", F.lit(True))).drop("usable")


def dua_scope_join(duas: DataFrame, bodies: DataFrame) -> DataFrame:
    """Pairs of DUAs (``dua``, ``file``, ``line``, ``column``) and function bodies (``file``, ``function``, and begin and end line and column) that hold them.

    A place is one number, the line above the column; bodies are made up of dyadic intervals of such places, and a DUA lies in one of each size. So pairs are found by an equi-join, a file spreads over
    many tasks, and the rows formed are those returned, however bodies nest. Lines are under 2**29, columns under 2**32. A place that many DUAs share is looked up once.
    """
    place = lambda line, column: F.col(line).cast("bigint") * (1 << 32) + F.col(column).cast("bigint")
    probes = duas.select("dua", F.col("file").alias("trace_id"), place("line", "column").alias("probe_seq"))
    places = probes.select("trace_id", "probe_seq").distinct()
    spans = bodies.select("function", F.col("file").alias("trace_id"), place("begin_line", "begin_column").alias("start"), (place("end_line", "end_column") + 1).alias("end"))
    inside = active_duas(places, spans).select("trace_id", "probe_seq", "function")
    return probes.join(inside, ["trace_id", "probe_seq"]).select("dua", F.col("trace_id").alias("file"), "function")
