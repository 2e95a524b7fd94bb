"""Which functions may be instrumented, and the streaming operators over files of a table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tracemine.operators import callgraph as N
from tracemine.operators.ordered import shared_folder
from tracemine.plans.registry import query, shown
from tracemine.sources.logs import read_whitelist, write_whitelist

_CALLS = "SELECT name, containing_function, CAST(NULL AS STRING) AS arg, CAST(NULL AS STRING) AS info FROM fx_callgraph UNION ALL SELECT callee AS name, 'main' AS containing_function, arg, info FROM fx_passed"
_TABLES = {"fun": "fx_fun", "rows": _CALLS, "assigns": "fx_assign"}


def with_args(rows):
    """Calls with their arguments, of which these have one at most."""
    arg = F.struct(F.col("arg").alias("name"), "info")
    return rows.select("name", "containing_function", F.when(F.col("arg").isNotNull(), F.array(arg)).otherwise(F.array().cast("array<struct<name:string,info:string>>")).alias("args"))


_NAMES = "(SELECT name FROM fx_fun UNION SELECT name FROM fx_callgraph UNION SELECT callee FROM fx_passed UNION SELECT arg FROM fx_passed WHERE info = 'function')"
_INITIAL = f"(SELECT n.name, CASE WHEN n.name IN (SELECT name FROM fx_fun WHERE hasbody) THEN 0 ELSE 3 END AS flag FROM {_NAMES} n)"
_ESCAPED = f"(SELECT DISTINCT p.arg AS name FROM fx_passed p LEFT JOIN {_INITIAL} j ON p.callee = j.name WHERE p.info = 'function' AND coalesce(j.flag, 3) <> 0)"
_RULED = f"(SELECT name, CASE WHEN name IN (SELECT name FROM {_ESCAPED} e) OR name IN (SELECT name FROM fx_assign) THEN 3 ELSE flag END AS flag FROM {_INITIAL} i)"
_CLOSED = f"""WITH RECURSIVE bad AS (SELECT name FROM {_RULED} r WHERE flag <> 0 UNION SELECT c.name FROM fx_callgraph c JOIN bad b ON c.containing_function = b.name),
              closed AS (SELECT name, CASE WHEN name IN (SELECT name FROM bad) THEN 3 ELSE flag END AS flag FROM {_RULED} r)"""


def ruled(fun, rows, assigns):
    calls = with_args(rows)
    first = N.initial_judgement(N.all_functions(fun, calls), fun)
    return N.fnptr_rule(N.arg_escape_rule(first, N.functions_passed_as_args(calls)), assigns)


@query(f"SELECT name FROM {_NAMES}", **_TABLES)
def n1_all_functions(fun, rows, assigns):
    return N.all_functions(fun, with_args(rows))


@query(
    "SELECT 'declared' AS step, count(DISTINCT name) AS n FROM fx_fun UNION ALL SELECT 'called' AS step, count(*) AS n FROM (SELECT name FROM fx_fun UNION SELECT name FROM fx_callgraph UNION SELECT callee FROM fx_passed) a "
    f"UNION ALL SELECT 'passed' AS step, count(*) AS n FROM {_NAMES} b",
    **_TABLES,
)
def n1_function_counts(fun, rows, assigns):
    return N.function_counts(fun, with_args(rows))


@query("SELECT DISTINCT arg AS function, callee AS receiver FROM fx_passed WHERE info = 'function'", **_TABLES)
def n2_functions_passed_as_args(fun, rows, assigns):
    return N.functions_passed_as_args(with_args(rows))


@query(
    """SELECT name, chunk, string_agg(containing_function, ',' ORDER BY containing_function) AS callers FROM (SELECT *, (row_number() OVER (PARTITION BY name ORDER BY containing_function) - 1) // 10000 AS chunk FROM
       (SELECT name, containing_function FROM fx_callgraph UNION SELECT callee AS name, 'main' AS containing_function FROM fx_passed) x) y GROUP BY name, chunk""",
    edges="fx_callgraph", **_TABLES,
)
def n3_function_index(fun, rows, assigns, edges):
    calls = with_args(rows)
    return N.function_index(fun, calls, assigns)["callers"].select("name", "chunk", shown("callers").alias("callers"))


@query(f"SELECT name, flag FROM {_INITIAL}", **_TABLES)
def n4_initial_judgement(fun, rows, assigns):
    return N.initial_judgement(N.all_functions(fun, with_args(rows)), fun)


@query(f"SELECT name, CASE WHEN name IN (SELECT name FROM {_ESCAPED} e) THEN 3 ELSE flag END AS flag FROM {_INITIAL} i", **_TABLES)
def n5_arg_escape_rule(fun, rows, assigns):
    calls = with_args(rows)
    return N.arg_escape_rule(N.initial_judgement(N.all_functions(fun, calls), fun), N.functions_passed_as_args(calls))


@query(f"SELECT name, flag FROM {_RULED}", **_TABLES)
def n6_fnptr_rule(fun, rows, assigns):
    return ruled(fun, rows, assigns)


_EDGES = {**_TABLES, "edges": "fx_callgraph"}


@query(f"{_CLOSED} SELECT name, flag FROM closed", **_EDGES)
def n7_close_over_callers(fun, rows, assigns, edges):
    return N.close_over_callers(ruled(fun, rows, assigns), edges)


@query(f"{_CLOSED} SELECT name FROM closed WHERE flag = 0 AND name NOT IN ('p1', 's2')", **_EDGES)
def n8_instrumentable(fun, rows, assigns, edges):
    return N.instrumentable(N.close_over_callers(ruled(fun, rows, assigns), edges), ["p1", "s2"])


@query(f"{_CLOSED} SELECT flag, count(*) AS n FROM closed WHERE name IN (SELECT name FROM fx_fun WHERE hasbody) GROUP BY flag", **_EDGES)
def n9_judgement_counts(fun, rows, assigns, edges):
    return N.judgement_counts(N.close_over_callers(ruled(fun, rows, assigns), edges), fun)


@query(f"{_CLOSED} SELECT 'df' AS tag, name AS function FROM closed WHERE flag = 0", **_EDGES)
def s10_write_whitelist(fun, rows, assigns, edges):
    """A whitelist of instrumentable functions, written and read again."""
    names = N.instrumentable(N.close_over_callers(ruled(fun, rows, assigns), edges), [])
    path = f"{shared_folder(names.sparkSession)}/whitelist-{uuid.uuid4().hex}"
    write_whitelist(names.select(F.lit("df").alias("tag"), F.col("name").alias("function")), path)
    return read_whitelist(names.sparkSession, path)
