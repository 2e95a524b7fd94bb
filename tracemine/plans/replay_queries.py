"""Replay of the log: carried values, calls, label sets, liveness."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemine.operators import replay as W
from tracemine.plans.registry import query, shown

_MARKS = "(SELECT trace_id, seq, filename, lead(seq) OVER (PARTITION BY trace_id ORDER BY seq) AS nxt FROM fx_entry WHERE filename IS NOT NULL)"


@query(f"SELECT e.trace_id, e.seq, coalesce(m.filename, 'UNKNOWN_FILE') AS inputfile FROM fx_entry e LEFT JOIN {_MARKS} m ON e.trace_id = m.trace_id AND e.seq >= m.seq AND (m.nxt IS NULL OR e.seq < m.nxt)", entries="fx_entry")
def w1_assign_input_file(entries):
    return W.assign_input_file(entries).select("trace_id", "seq", "inputfile")


@query("SELECT trace_id, seq, CAST(coalesce(sum(CASE WHEN kind = 'sourceTraceId' THEN 1 ELSE 0 END) OVER (PARTITION BY trace_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS trace_index FROM fx_entry", entries="fx_entry")
def w2_assign_trace_index(entries):
    return W.assign_trace_index(entries).select("trace_id", "seq", "trace_index")


@query(
    """SELECT e.trace_id, e.idx AS "index", split_part(d.value, ':', 5) AS filename, CAST(split_part(d.value, ':', 1) AS INT) AS begin_line FROM
       (SELECT trace_id, loc_id, row_number() OVER (PARTITION BY trace_id ORDER BY seq) - 1 AS idx FROM fx_entry WHERE kind = 'sourceTraceId') e LEFT JOIN fx_dict d ON e.loc_id = d.id""",
    entries="fx_entry", dictionary="fx_dict",
)
def w3_source_traces(entries, dictionary):
    return W.source_traces(entries, dictionary).select("trace_id", "index", "loc.filename", "loc.begin_line")


_DEPTH = """SELECT *, s - least(0, min(s) OVER (PARTITION BY trace_id ORDER BY seq ROWS UNBOUNDED PRECEDING)) AS depth FROM
            (SELECT *, sum(CASE WHEN is_call THEN 1 ELSE -1 END) OVER (PARTITION BY trace_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS s FROM fx_call) x"""
_SPANS = f"""SELECT trace_id, callee, callee_file, depth, seq, (SELECT min(r.seq) FROM ({_DEPTH}) r WHERE r.trace_id = c.trace_id AND r.seq > c.seq AND NOT r.is_call AND r.depth = c.depth - 1) AS ret FROM ({_DEPTH}) c WHERE is_call"""


@query(
    f"SELECT p.trace_id, p.seq, coalesce(string_agg(s.callee, '>' ORDER BY s.depth), '') AS stack FROM (SELECT trace_id, seq FROM fx_call) p LEFT JOIN ({_SPANS}) s ON p.trace_id = s.trace_id AND s.seq < p.seq AND (s.ret IS NULL OR s.ret > p.seq) GROUP BY p.trace_id, p.seq",
    calls="fx_call",
)
def w4_call_stack_at(calls):
    return W.call_stack_at(calls.select("trace_id", "seq"), calls).select("trace_id", "seq", F.array_join(F.col("stack.function"), ">").alias("stack"))


@query(
    """WITH RECURSIVE numbered AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY seq) AS k FROM fx_call),
       replay AS (SELECT trace_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS seq, CAST([] AS VARCHAR[]) AS frames FROM (SELECT DISTINCT trace_id FROM fx_call) t
                  UNION ALL SELECT r.trace_id, n.k, n.seq, CASE WHEN n.is_call THEN list_append(r.frames, n.callee) WHEN r.frames[-1] = n.callee THEN r.frames[:-2] ELSE r.frames END
                  FROM replay r JOIN numbered n ON n.trace_id = r.trace_id AND n.k = r.k + 1)
       SELECT trace_id, seq, array_to_string(frames, '>') AS stack FROM replay WHERE k > 0""",
    calls="fx_call",
)
def w4_call_stack_exact(calls):
    return W.call_stack_exact(calls)


@query(f"SELECT trace_id, callee AS function, callee_file AS file, CAST(depth AS BIGINT) AS depth, seq AS call_seq, ret AS ret_seq FROM ({_SPANS})", calls="fx_call")
def w5_call_intervals(calls):
    return W.call_intervals(calls)


@query(
    f"SELECT DISTINCT s.callee AS caller, s.callee_file AS file FROM fx_call p JOIN ({_SPANS}) s ON p.trace_id = s.trace_id AND s.seq < p.seq AND (s.ret IS NULL OR s.ret > p.seq)",
    calls="fx_call",
)
def w6_call_traces(calls):
    return W.call_traces_at(calls.select("trace_id", "seq"), calls).select("caller", "file")


_SETS = "(SELECT trace_id, ptr, arg_min(struct_pack(f := inputfile, a := label1, b := label2, s := seq), (seq, pos, price)) AS x FROM fx_elem WHERE label2 % 3 <> 0 GROUP BY trace_id, ptr)"


def _elements(rows):
    labels = F.when(F.col("label2") % 3 != 0, F.sort_array(F.array_distinct(F.array("label1", "label2"))))
    return rows.withColumn("labels", labels).withColumn("pos", F.struct("pos", "price"))


@query(
    f"SELECT trace_id, ptr, x.f AS inputfile, CASE WHEN x.a = x.b THEN CAST(x.a AS STRING) ELSE concat(CAST(least(x.a, x.b) AS STRING), ',', CAST(greatest(x.a, x.b) AS STRING)) END AS labels, x.s AS first_seq FROM {_SETS}",
    rows="fx_elem",
)
def w7_label_sets(rows):
    return W.label_sets(_elements(rows)).withColumn("labels", shown("labels"))


@query(
    f"""SELECT DISTINCT trace_id, inputfile, seq, label FROM (SELECT e.trace_id, e.inputfile, e.seq, unnest([s.x.a, s.x.b]) AS label FROM fx_elem e JOIN {_SETS} s ON e.ptr = s.ptr AND s.x.s <= e.seq)""",
    rows="fx_elem",
)
def w8_branch_labels(rows):
    elements = _elements(rows)
    return W.branch_labels(rows, W.label_sets(elements))


@query("SELECT inputfile, label, count(*) AS death_instr FROM fx_branch GROUP BY inputfile, label", branches="fx_branch")
def w9_liveness_snapshot(branches):
    return W.liveness_snapshot(branches)


@query("SELECT inputfile, label, max(seq) AS death_instr FROM fx_branch GROUP BY inputfile, label", branches="fx_branch")
def w9_last_branch(branches):
    return W.last_branch(branches)


@query(
    """SELECT e.inputfile, e.label, e.seq, CAST((SELECT count(*) FROM fx_branch b WHERE b.inputfile = e.inputfile AND b.label = e.label AND b.seq <= e.seq) AS BIGINT) AS liveness
       FROM (SELECT inputfile, CAST(instr % 20 AS INT) AS label, instr AS seq FROM fx_exec) e""",
    events="SELECT inputfile, CAST(instr % 20 AS INT) AS label, instr AS seq FROM fx_exec", branches="fx_branch",
)
def w10_liveness_asof(events, branches):
    return W.liveness_asof(events, branches)


@query("SELECT inputfile, label, death_seq FROM fx_death", branches="fx_branch")
def w11_label_death(branches):
    return W.label_death(branches, 6)
