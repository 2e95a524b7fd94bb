"""Statistics, selection and cleaning of bugs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemine.operators import cleaning as C
from tracemine.operators import selection as Q
from tracemine.plans.registry import query

_BUGS = {"bugs": "SELECT bug, kind, trigger_ AS trigger, trigger_lval, atp, max_liveness, magic, file, line FROM fx_bug", "extras": "fx_bug_extra"}
_BYTES = "fx_dua_bytes"
_ATPS = "fx_atp"


def with_extras(bugs, extras):
    lists = extras.groupBy("bug").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "dua_bytes"))), lambda x: x["dua_bytes"]).alias("extra_duas"))
    return bugs.join(lists, "bug", "left").withColumn("extra_duas", F.coalesce("extra_duas", F.array().cast("array<bigint>")))


@query("SELECT 'bug' AS entity, count(*) AS n FROM fx_bug UNION ALL SELECT 'dua' AS entity, count(*) AS n FROM fx_dua UNION ALL SELECT 'atp' AS entity, count(*) AS n FROM fx_atp", bugs="fx_bug", duas="fx_dua", atps="fx_atp")
def q1_entity_counts(bugs, duas, atps):
    return Q.entity_counts({"bug": bugs, "dua": duas, "atp": atps})


@query(
    """SELECT b.bug, b.kind, b.trigger_ AS trigger, t.low, t.high, x.low AS extra_low, x.high AS extra_high, a.file, a.line, a.type AS atp_type FROM fx_bug b JOIN fx_dua_bytes t ON b.trigger_ = t.dua_bytes JOIN fx_atp a ON b.atp = a.atp
       LEFT JOIN fx_bug_extra e ON b.bug = e.bug AND e.pos = 0 LEFT JOIN fx_dua_bytes x ON e.dua_bytes = x.dua_bytes""",
    dua_bytes=_BYTES, atps=_ATPS, **_BUGS,
)
def q3_bug_detail(bugs, extras, dua_bytes, atps):
    return Q.bug_detail(with_extras(bugs, extras), dua_bytes, atps)


@query(
    """SELECT b.bug, b.kind, a.file, a.line, d.lval, d.max_tcn, b.max_liveness, e.pos, e.dua_bytes AS extra, (e.dua_bytes IS NOT NULL AND x.dua_bytes IS NULL) AS missing FROM fx_bug b JOIN fx_dua_bytes t ON b.trigger_ = t.dua_bytes
       JOIN fx_dua d ON t.dua = d.dua JOIN fx_atp a ON b.atp = a.atp LEFT JOIN fx_bug_extra e ON b.bug = e.bug LEFT JOIN fx_dua_bytes x ON x.dua_bytes = e.dua_bytes AND x.low <> 5 WHERE t.low <> 5""",
    dua_bytes="SELECT * FROM fx_dua_bytes WHERE low <> 5", duas="fx_dua", atps=_ATPS, **_BUGS,
)
def q4_bug_report(bugs, extras, dua_bytes, duas, atps):
    """Byte ranges from 5 on are unknown."""
    return Q.bug_report(with_extras(bugs, extras), dua_bytes, duas, atps).select("bug", "kind", "file", "line", "lval", "max_tcn", "max_liveness", "pos", "extra", "missing")


@query(
    """SELECT DISTINCT file FROM (SELECT d.file FROM fx_bug b JOIN fx_dua_bytes t ON b.trigger_ = t.dua_bytes JOIN fx_dua d ON t.dua = d.dua UNION ALL SELECT split_part(a.file, '/', 2) AS file FROM fx_bug b JOIN fx_atp a ON b.atp = a.atp
       UNION ALL SELECT d.file FROM fx_bug_extra e JOIN fx_dua_bytes t ON e.dua_bytes = t.dua_bytes JOIN fx_dua d ON t.dua = d.dua) x""",
    dua_files="SELECT t.dua_bytes, d.file AS path FROM fx_dua_bytes t JOIN fx_dua d ON t.dua = d.dua", atp_files="SELECT atp, file AS path FROM fx_atp", **_BUGS,
)
def q5_source_files(bugs, extras, dua_files, atp_files):
    return Q.source_files_for_bugs(with_extras(bugs, extras), dua_files, atp_files)


@query("SELECT (SELECT count(*) FROM fx_bug) > 1000 AS huge, 'bug' AS entity FROM (SELECT count(*) AS n FROM fx_bug) x", **_BUGS)
def q6_is_huge(bugs, extras):
    return bugs.agg(F.count("*").alias("n")).select(F.lit(Q.is_huge(bugs, 1000)).alias("huge"), F.lit("bug").alias("entity"))


_FREE = "SELECT b.* FROM fx_bug b WHERE b.bug NOT IN (SELECT bug FROM fx_build_bug)"


@query(f"SELECT bug, kind FROM ({_FREE}) x", built="fx_build_bug", **_BUGS)
def q7_uninjected(bugs, extras, built):
    return Q.uninjected(bugs, built).select("bug", "kind")


@query(f"SELECT x.bug, x.kind FROM ({_FREE}) x JOIN fx_dua d ON x.bug = d.dua WHERE NOT d.fake_dua AND x.kind IN (0, 1, 2)", built="fx_build_bug", dua_bytes=_BYTES, duas="fx_dua", **_BUGS)
def q8_uninjected_by_realness(bugs, extras, built, dua_bytes, duas):
    return Q.uninjected_by_realness(bugs, built, dua_bytes, duas, fake=False, kinds=[0, 1, 2]).select("bug", "kind")


@query(f"SELECT bug, kind FROM ({_FREE}) x WHERE kind IN (0, 3) ORDER BY md5(concat('0:', bug)), bug LIMIT 20", built="fx_build_bug", **_BUGS)
def q9_sample_uninjected(bugs, extras, built):
    return Q.sample_uninjected(bugs, built, 20, [0, 3]).select("bug", "kind")


@query(f"SELECT bug, kind FROM ({_FREE}) x ORDER BY bug LIMIT 1", built="fx_build_bug", **_BUGS)
def q9_next_uninjected(bugs, extras, built):
    return Q.next_uninjected(bugs, built).select("bug", "kind")


@query("SELECT bug, kind FROM (SELECT bug, kind, row_number() OVER (PARTITION BY kind ORDER BY md5(concat('0:', bug)), bug) AS r FROM fx_bug WHERE kind IN (1, 4, 7)) x WHERE r <= 33", **_BUGS)
def q10_sample_balanced(bugs, extras):
    return Q.sample_balanced(bugs, 100, [1, 4, 7]).select("bug", "kind")


@query("SELECT bug, kind FROM fx_bug WHERE bug IN (SELECT l_orderkey FROM lineitem WHERE l_quantity < 2)", ids="SELECT DISTINCT l_orderkey AS bug FROM lineitem WHERE l_quantity < 2", **_BUGS)
def q11_pick_bugs(bugs, extras, ids):
    return Q.pick_bugs(bugs, ids).select("bug", "kind")


@query(
    "SELECT DISTINCT spec, name, kind FROM (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'ptr_add, RET_BUFFER' ELSE 'REL_WRITE' END AS spec FROM orders) o JOIN (VALUES ('ptr_add, RET_BUFFER', 'PTR_ADD', 0), ('ptr_add, RET_BUFFER', 'RET_BUFFER', 1), ('REL_WRITE', 'REL_WRITE', 2)) v(s, name, kind) ON o.spec = v.s",
    specs="SELECT DISTINCT CASE WHEN o_orderkey % 2 = 0 THEN 'ptr_add, RET_BUFFER' ELSE 'REL_WRITE' END AS spec FROM orders",
)
def q12_parse_bug_types(specs):
    return Q.parse_bug_types(specs)


@query(
    """SELECT pos, file, line, kind FROM (SELECT *, row_number() OVER (PARTITION BY file, line, kind ORDER BY pos) AS r FROM (SELECT *, arg_min(kind IN (2, 4), pos) OVER (PARTITION BY file, line) AS s FROM
       (SELECT bug AS pos, file, line, kind FROM fx_bug) a) b WHERE (kind IN (2, 4)) = s) c WHERE kind IN (0, 1, 3) OR r = 1""",
    **_BUGS,
)
def q13_limit_atp_reuse(bugs, extras):
    return Q.limit_atp_reuse(bugs.select(F.col("bug").alias("pos"), "file", "line", "kind"))


@query(
    """SELECT dua, CASE WHEN count(*) > 3 THEN concat(string_agg(CASE WHEN r <= 3 THEN CAST(label AS STRING) END, ',' ORDER BY label), ',+', count(*) - 3) ELSE string_agg(CAST(label AS STRING), ',' ORDER BY label) END AS labels
       FROM (SELECT *, row_number() OVER (PARTITION BY dua ORDER BY label) AS r FROM fx_dua_label) x GROUP BY dua""",
    rows="fx_dua_label",
)
def q14_entity_dump(rows):
    return Q.entity_dump(rows.groupBy("dua").agg(F.sort_array(F.collect_set("label")).alias("labels")), ["dua"], most=3)


@query("SELECT b.bug, b.kind FROM fx_bug b LEFT JOIN fx_lval l ON b.trigger_lval = l.lval WHERE b.kind >= 5 OR coalesce(l.ast_name, '') NOT LIKE '%lava_chaff%'", lvals="fx_lval", **_BUGS)
def c1_drop_chaff_tied(bugs, extras, lvals):
    return C.drop_chaff_tied(bugs, lvals).select("bug", "kind")


@query(
    """SELECT bug, kind FROM fx_bug b WHERE NOT EXISTS (SELECT 1 FROM fx_dua_bytes t JOIN fx_dua d ON t.dua = d.dua WHERE t.dua_bytes = b.trigger_ AND d.fake_dua)
       AND NOT (kind <> 5 AND EXISTS (SELECT 1 FROM fx_bug_extra e JOIN fx_dua_bytes t ON e.dua_bytes = t.dua_bytes JOIN fx_dua d ON t.dua = d.dua WHERE e.bug = b.bug AND d.fake_dua))""",
    dua_bytes=_BYTES, duas="fx_dua", **_BUGS,
)
def c2_drop_bugs_with_fake_duas(bugs, extras, dua_bytes, duas):
    return C.drop_bugs_with_fake_duas(with_extras(bugs, extras), dua_bytes, duas).select("bug", "kind")


@query(
    """WITH gone AS (SELECT t.dua_bytes FROM fx_dua_bytes t JOIN fx_dua d ON t.dua = d.dua JOIN fx_lval l ON d.lval = l.lval WHERE l.ast_name LIKE '%red%' AND l.begin_line < 20)
       SELECT b.bug FROM fx_bug b WHERE b.trigger_ NOT IN (SELECT dua_bytes FROM gone) AND NOT EXISTS (SELECT 1 FROM fx_bug_extra e JOIN gone g ON e.dua_bytes = g.dua_bytes WHERE e.bug = b.bug)""",
    lvals="fx_lval", dua_bytes=_BYTES, duas="fx_dua", **_BUGS,
)
def c3_delete_duas_cascade(bugs, extras, lvals, dua_bytes, duas):
    return C.delete_duas_cascade(lvals, duas, dua_bytes, with_extras(bugs, extras), "%red%", 20)["bugs"].select("bug")


_DUAS = "SELECT dua, file, line, column_ AS column, trace_index, fake_dua FROM fx_dua"


@query(
    """SELECT d.dua, d.file, CASE WHEN m.step IS NOT NULL THEN m.new_line ELSE d.line END AS line, CASE WHEN m.step IS NOT NULL THEN m.step ELSE d.trace_index END AS trace_index, (d.fake_dua OR (m.dua IS NOT NULL AND m.step IS NULL)) AS fake_dua FROM fx_dua d
       LEFT JOIN (SELECT x.dua, x.new_line, min(s.index) AS step FROM (SELECT *, CAST((line + 7) % 40 AS INT) AS new_line, CAST((column_ + 2) % 9 AS INT) AS new_column FROM fx_dua WHERE NOT fake_dua) x
         LEFT JOIN fx_step s ON s.file = x.file AND s.line = x.new_line AND s.column_ = x.new_column AND s.index >= x.trace_index WHERE x.new_line > x.line OR (x.new_line = x.line AND x.new_column > x.column_) GROUP BY x.dua, x.new_line) m ON d.dua = m.dua""",
    duas=_DUAS, moves="SELECT dua, CAST((line + 7) % 40 AS INT) AS new_line, CAST((column_ + 2) % 9 AS INT) AS new_column FROM fx_dua WHERE NOT fake_dua", traces="SELECT index, file, line, column_ AS column FROM fx_step",
)
def c4_relocate_siphons(duas, moves, traces):
    return C.relocate_siphons(duas, moves, traces).select("dua", "file", "line", "trace_index", "fake_dua")


@query("SELECT dua, (fake_dua OR line < 7) AS fake_dua FROM fx_dua", duas="SELECT dua, fake_dua FROM fx_dua", verdicts="SELECT dua, line >= 7 AS usable FROM fx_dua WHERE NOT fake_dua")
def c5_discard_unscoped(duas, verdicts):
    return C.discard_unscoped(duas, verdicts)


_BODIES = "SELECT DISTINCT concat('f', CAST(p_partkey % 50 AS STRING)) AS file, concat('g', CAST(p_partkey % 300 AS STRING)) AS function, CAST(p_partkey % 30 AS INT) AS begin_line, 3 AS begin_column, CAST(p_partkey % 30 + 6 AS INT) AS end_line, 5 AS end_column FROM part"


@query(
    f"SELECT d.dua, d.file, b.function FROM fx_dua d JOIN ({_BODIES}) b ON d.file = b.file WHERE (d.line > b.begin_line OR (d.line = b.begin_line AND d.column_ >= b.begin_column)) AND (d.line < b.end_line OR (d.line = b.end_line AND d.column_ <= b.end_column))",
    duas=_DUAS, bodies=_BODIES,
)
def c6_dua_scope_join(duas, bodies):
    return C.dua_scope_join(duas, bodies)
