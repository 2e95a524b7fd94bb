"""Placement planning."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemine.operators import placement as P
from tracemine.plans.registry import query, shown
from tracemine.plans.selection_queries import _BUGS, _BYTES, with_extras


@query(
    "SELECT a.file AS loc, a.type AS atp_type, CAST(b.bug // 10000 AS BIGINT) AS chunk, string_agg(CAST(b.bug AS STRING), ',' ORDER BY b.bug) AS bugs FROM fx_bug b JOIN fx_atp a ON b.atp = a.atp GROUP BY a.file, a.type, b.bug // 10000",
    atps="SELECT atp, file AS loc, type FROM fx_atp", **_BUGS,
)
def p1_bugs_by_location(bugs, extras, atps):
    return P.bugs_by_location(bugs, atps).select("loc", "atp_type", "chunk", shown("bugs").alias("bugs"))


_USES = """SELECT 'trigger' AS list, bug, 0 AS pos, trigger_ AS dua_bytes FROM fx_bug UNION ALL SELECT 'extra' AS list, bug, pos, dua_bytes FROM fx_bug_extra WHERE bug % 9 <> 5"""
_READS = f"""SELECT u.list, d.lval, t.low, t.high, concat(s.file, ':', s.line, ':', s.column_) AS loc, min(struct_pack(bug := u.bug, pos := u.pos)) AS first FROM ({_USES}) u
            JOIN fx_dua_bytes t ON u.dua_bytes = t.dua_bytes JOIN fx_dua d ON t.dua = d.dua JOIN fx_step s ON s.index = d.trace_index GROUP BY ALL"""


@query(
    f"""SELECT r.list, r.lval, r.low, r.high, r.loc, CAST(z.slot AS BIGINT) AS slot FROM ({_READS}) r JOIN
        (SELECT list, lval, low, high, row_number() OVER (PARTITION BY list ORDER BY min(first), lval, low, high) - 1 AS slot FROM ({_READS}) x GROUP BY list, lval, low, high) z
        ON r.list = z.list AND r.lval = z.lval AND r.low = z.low AND r.high = z.high""",
    dua_bytes=_BYTES, duas="fx_dua", traces="SELECT index, concat(file, ':', CAST(line AS STRING), ':', CAST(column_ AS STRING)) AS loc FROM fx_step", **_BUGS,
)
def p2_siphon_slots(bugs, extras, dua_bytes, duas, traces):
    return P.siphon_slots(with_extras(bugs, extras), dua_bytes, duas, traces)


_DRAW = "CAST(('0x' || substr(md5(concat('0:{0}:', bug)), 1, 8)) AS BIGINT)"


@query(
    f"""SELECT x.bug, x.first_index, f.file AS first_loc, x.second_index, s.file AS second_loc FROM (SELECT bug, first_index, first_index + 1 + {_DRAW.format('second')} % (hi - first_index - 1) AS second_index FROM
         (SELECT bug, hi, lo + {_DRAW.format('first')} % (hi - lo - 1) AS first_index FROM (SELECT bug, least(bug % 900, magic % 900) AS lo, greatest(bug % 900, magic % 900) AS hi FROM fx_bug) a WHERE hi - lo >= 2) b) x
        JOIN fx_step f ON x.first_index = f.index JOIN fx_step s ON x.second_index = s.index""",
    bugs="SELECT bug, bug % 900 AS a, magic % 900 AS b FROM fx_bug", traces="SELECT index, file AS loc FROM fx_step",
)
def p3_overconstraint_points(bugs, traces):
    return P.overconstraint_points(bugs, traces)


@query("SELECT bug, file, line FROM fx_bug b WHERE NOT EXISTS (SELECT 1 FROM fx_step s WHERE s.file = b.file AND s.line = b.line AND s.column_ < 4)", wanted="SELECT bug, file, line FROM fx_bug", placed="SELECT file, line FROM fx_step WHERE column_ < 4")
def p4_unplaced(wanted, placed):
    return P.unplaced(wanted, placed, ["file", "line"]).select("bug", "file", "line")


_GOOD = "(SELECT DISTINCT name AS function FROM fx_fun WHERE hasbody AND name NOT IN (SELECT name FROM fx_assign))"
_WALK = f"""(SELECT *, min(CASE WHEN NOT good THEN depth END) OVER (PARTITION BY bug) AS stop, count(*) OVER (PARTITION BY bug) AS n FROM
             (SELECT b.bug, coalesce(f.function, 'main') AS function, row_number() OVER (PARTITION BY b.bug ORDER BY f.pos DESC) - 1 AS depth, (f.function IS NULL OR g.function IS NOT NULL) AS good
              FROM (SELECT bug FROM fx_bug WHERE kind = 5) b LEFT JOIN fx_frame f ON b.bug = f.bug LEFT JOIN {_GOOD} g ON f.function = g.function) x)"""


@query(
    f"""WITH walk AS (SELECT *, coalesce(stop, n) - 1 AS last FROM {_WALK} w), df AS (SELECT DISTINCT function FROM walk WHERE depth < last)
        SELECT DISTINCT function, role FROM (SELECT function, 'addvar' AS role FROM walk WHERE depth = 0 AND good UNION ALL SELECT function, 'root' AS role FROM walk WHERE depth = last OR (depth = 0 AND stop = 0)
          UNION ALL SELECT function, 'df' AS role FROM df UNION ALL SELECT c.containing_function AS function, 'root' AS role FROM fx_callgraph c JOIN df ON c.name = df.function) y""",
    bugs="SELECT bug, kind FROM fx_bug", frames="fx_frame", defined="SELECT name AS function FROM fx_fun WHERE hasbody", assigned="SELECT name AS function FROM fx_assign", calls="SELECT name AS callee, containing_function AS caller FROM fx_callgraph",
)
def p5_dataflow_roles(bugs, frames, defined, assigned, calls):
    return P.dataflow_roles(bugs, frames, defined, assigned, calls)


@query(
    "SELECT DISTINCT coalesce(f.function, 'main') AS function, 'addvar' AS role FROM fx_bug b LEFT JOIN (SELECT bug, arg_max(function, pos) AS function FROM fx_frame GROUP BY bug) f ON b.bug = f.bug WHERE b.kind = 6",
    bugs="SELECT bug, kind FROM fx_bug", frames="fx_frame",
)
def p6_stack_var_functions(bugs, frames):
    return P.stack_var_functions(bugs, frames)


_ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def _letters(salt: str) -> str:
    byte = lambda i: f"CAST(ascii(substr('{_ALPHABET}', CAST(CAST(('0x' || substr(md5(concat('0:{salt}:', bug)), {1 + 2 * i}, 2)) AS BIGINT) % 62 + 1 AS BIGINT), 1)) AS BIGINT)"
    return f"(({byte(0)} * 256 + {byte(1)}) * 256 + {byte(2)}) * 256 + {byte(3)}"


@query(
    f"""SELECT bug, form, a, b, c, CAST(CASE form WHEN 0 THEN (CAST(a AS HUGEINT) + b) * c % 4294967296 WHEN 1 THEN (CAST(a AS HUGEINT) * b - c) % 4294967296 ELSE ((CAST(a AS HUGEINT) + 2) * (b + 1) % 4294967296) * (c + 3) % 4294967296 END AS BIGINT) AS magic
        FROM (SELECT bug, magic % 3 AS form, {_letters('a')} AS a, {_letters('b')} AS b, {_letters('c')} AS c FROM fx_bug) x""",
    bugs="SELECT bug, magic FROM fx_bug",
)
def p7_multi_dua_solutions(bugs):
    return P.multi_dua_solutions(bugs)


@query(
    "SELECT bug, concat(CAST(magic AS STRING), ',', CAST(bug * 2 AS STRING)) AS \"values\" FROM fx_bug WHERE bug % 4 <> 0",
    lines="SELECT CASE WHEN bug % 4 = 0 THEN concat('note 0x', hex(bug), ' == 0x1') ELSE concat('SOL 0x', lower(hex(bug)), ' == (0x', lower(hex(magic)), ' + 0x', hex(bug * 2), ') * 7') END AS value FROM fx_bug",
)
def p8_parse_solutions(lines):
    return P.parse_solutions(lines).select("bug", shown("values").alias("values"))


_CODE = "SELECT concat('f', CAST(page_id % 50 AS STRING)) AS file, CAST(page_id AS INT) AS line, concat('if (0x', CAST(page_id % 10 AS STRING), ' == x)') AS text FROM pages"


@query(
    f"""SELECT b.bug, x.found_line FROM (SELECT DISTINCT bug FROM fx_bug) b LEFT JOIN (SELECT bug, arg_min(hit, (abs(hit - line), hit)) AS found_line FROM (SELECT b.bug, b.line, l.line AS hit FROM fx_bug b JOIN ({_CODE}) l ON l.file = b.file
        WHERE contains(l.text, concat('(0x', CAST(b.bug % 10 AS STRING)))) y GROUP BY bug) x ON b.bug = x.bug""",
    bugs="SELECT bug, file, line, bug % 10 AS magic FROM fx_bug", lines=_CODE,
)
def p9_locate_trigger_line(bugs, lines):
    return P.locate_trigger_line(bugs, lines)
