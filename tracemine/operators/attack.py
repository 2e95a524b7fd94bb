"""Attack points, and when they are hit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemine.operators.mining import active_duas
from tracemine.schemas import KINDS_OF_ATP
from tracemine.sources.logs import first_by


def attack_points(points: DataFrame, lifetimes: DataFrame) -> DataFrame:
    """Distinct ``loc``, ``type`` of points (``trace_id``, ``probe_seq``, ``loc``, ``type``) at which some DUA is active."""
    reached = active_duas(points.select("trace_id", "probe_seq").distinct(), lifetimes.select("trace_id", "start", "end"))
    return points.join(reached.select("trace_id", "probe_seq").distinct(), ["trace_id", "probe_seq"], "left_semi").select("loc", "type").distinct()


def query_points(queries: DataFrame) -> DataFrame:
    """Each taint query as a point of kind QUERY_POINT: distinct ``loc``, ``type``, ``trace_index`` with the first ``calltrace`` and ``stack_offset``."""
    rows = queries.select("loc", F.lit(3).alias("type"), "trace_index", "calltrace", "stack_offset", "trace_id", "seq")
    return first_by(rows, ["loc", "type", "trace_index"], ["trace_id", "seq"]).drop("trace_id", "seq")


def atp_executions(hits: DataFrame, points: DataFrame) -> DataFrame:
    """Distinct ``atp``, ``inputfile``, ``instr`` of hits of known points (``atp``)."""
    return hits.select("atp", "inputfile", "instr").join(points.select("atp"), "atp", "left_semi").distinct()


def bug_kinds_for_atp(points: DataFrame) -> DataFrame:
    """points (``type``, ...) with ``kind``, a row for each kind of bug that the kind of point can have; the table of kinds has a fixed size."""
    pairs = [(a, b) for a, kinds in KINDS_OF_ATP.items() for b in kinds]
    table = points.sparkSession.createDataFrame(pairs, "__type int, kind int")
    return points.join(F.broadcast(table), F.col("type") == F.col("__type")).drop("__type")
