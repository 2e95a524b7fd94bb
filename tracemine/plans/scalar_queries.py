"""Scalar functions and table operators over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemine.functions import scalars as S
from tracemine.plans.registry import query, shown
from tracemine.sources import logs

_LABELS = "SELECT dua, labels_, more FROM (SELECT l_orderkey AS dua, min(CAST(l_partkey % 20 AS INT)) AS labels_, max(CAST(l_suppkey % 20 AS INT)) AS more FROM lineitem GROUP BY l_orderkey) x"
_RUNS = "SELECT instr, byte_off, untainted, tcn, label1 FROM fx_qbyte"


def _by_query(rows):
    """Bytes of a query as an array: null where untainted."""
    value = F.struct("byte_off", F.when(~F.col("untainted"), F.col("label1")).alias("v"))
    return rows.groupBy("instr").agg(F.transform(F.array_sort(F.collect_list(value)), lambda x: x["v"]).alias("b"))


@query("SELECT id, CAST(split_part(value, ':', 1) AS INT) AS begin_line, CAST(split_part(value, ':', 4) AS INT) AS end_column, split_part(value, ':', 5) AS filename, value AS again FROM fx_dict", rows="fx_dict")
def f1_f2_ast_loc(rows):
    loc = rows.withColumn("loc", S.parse_ast_loc("value"))
    return loc.select("id", "loc.begin_line", "loc.end_column", "loc.filename", S.format_ast_loc("loc").alias("again"))


@query("SELECT id, filename, (length(filename) < 2 OR filename LIKE '%.h') AS header FROM (SELECT id, split_part(value, ':', 5) AS filename FROM fx_dict)", rows="fx_dict")
def f3_is_header_file(rows):
    name = rows.select("id", S.parse_ast_loc("value")["filename"].alias("filename"))
    return name.withColumn("header", S.is_header_file("filename"))


@query("SELECT event_id, event_id AS dec_value, event_id * 3 AS hex_value FROM events", rows="SELECT event_id, CAST(event_id AS STRING) AS d, concat('0x', lower(hex(event_id * 3))) AS h FROM events")
def f4_parse_c_int(rows):
    return rows.select("event_id", S.parse_c_int("d").alias("dec_value"), S.parse_c_int("h").alias("hex_value"))


@query("SELECT page_id, regexp_extract(url, '([^/\\\\]*)$', 1) AS base FROM pages", rows="SELECT page_id, url FROM pages")
def f5_basename(rows):
    return rows.select("page_id", S.basename("url").alias("base"))


@query(
    """SELECT a.dua, count(DISTINCT b.label) = 0 AS disjoint FROM (SELECT DISTINCT dua FROM fx_dua_label) a
       LEFT JOIN (SELECT x.dua, x.label FROM fx_dua_label x JOIN fx_dua_label y ON y.dua = x.dua + 1 AND y.label = x.label) b ON a.dua = b.dua GROUP BY a.dua""",
    rows="fx_dua_label",
)
def f6_disjoint(rows):
    sets = rows.groupBy("dua").agg(S.merged_labels("label").alias("labels"))
    after = sets.select((F.col("dua") - 1).alias("dua"), F.col("labels").alias("next"))
    return sets.join(after, "dua", "left").select("dua", S.disjoint("labels", "next").alias("disjoint"))


@query(
    """SELECT dua, string_agg(CAST(label AS STRING), ',' ORDER BY label) AS labels FROM
       (SELECT dua, label FROM fx_dua_label UNION SELECT dua - 1 AS dua, label FROM fx_dua_label) WHERE dua IN (SELECT dua FROM fx_dua_label) GROUP BY dua""",
    rows="fx_dua_label",
)
def f7_merge_labels(rows):
    sets = rows.groupBy("dua").agg(S.merged_labels("label").alias("labels"))
    after = sets.select((F.col("dua") - 1).alias("dua"), F.col("labels").alias("next"))
    return sets.join(after, "dua", "left").select("dua", shown(S.merge_labels("labels", "next")).alias("labels"))


@query("SELECT instr, CAST(sum(CASE WHEN untainted THEN 0 ELSE 1 END) AS INT) AS viable FROM fx_qbyte GROUP BY instr", rows=_RUNS)
def f8_count_viable(rows):
    return _by_query(rows).select("instr", S.count_viable("b").alias("viable"))


@query("SELECT dua_bytes, CAST(high - low AS INT) AS size, high <= low AS is_empty FROM fx_dua_bytes", rows="fx_dua_bytes")
def f9_range_size(rows):
    r = rows.withColumn("r", F.struct(F.col("low").cast("int").alias("low"), F.col("high").cast("int").alias("high")))
    return r.select("dua_bytes", S.range_size("r").alias("size"), S.range_empty("r").alias("is_empty"))


_ISLANDS = """
    SELECT instr, min(byte_off) AS low, CAST(max(byte_off) + 1 AS INT) AS high FROM
    (SELECT instr, byte_off, byte_off - row_number() OVER (PARTITION BY instr ORDER BY byte_off) AS g FROM fx_qbyte WHERE NOT untainted) x GROUP BY instr, g"""


@query(f"SELECT q.instr, coalesce(min(i.low), 0) AS low, coalesce(min(i.low) + 4, 0) AS high FROM (SELECT DISTINCT instr FROM fx_qbyte) q LEFT JOIN ({_ISLANDS}) i ON q.instr = i.instr AND i.high - i.low >= 4 GROUP BY q.instr", rows=_RUNS)
def f10_first_dead_run(rows):
    r = S.first_dead_run(F.transform("b", lambda x: x.isNotNull()))
    return _by_query(rows).select("instr", r.alias("r")).select("instr", "r.low", "r.high")


@query(f"SELECT q.instr, coalesce(arg_max(i.low, (i.high - i.low) * 1000 - i.low), 0) AS low, coalesce(arg_max(i.high, (i.high - i.low) * 1000 - i.low), 0) AS high FROM (SELECT DISTINCT instr FROM fx_qbyte) q LEFT JOIN ({_ISLANDS}) i ON q.instr = i.instr GROUP BY q.instr", rows=_RUNS)
def f11_longest_run(rows):
    return _by_query(rows).select("instr", S.longest_run("b").alias("r")).select("instr", "r.low", "r.high")


@query(f"SELECT q.instr, coalesce(min(i.low), 0) AS low, coalesce(min(i.low) + 6, 0) AS high FROM (SELECT DISTINCT instr FROM fx_qbyte) q LEFT JOIN ({_ISLANDS}) i ON q.instr = i.instr AND i.high - i.low >= 6 GROUP BY q.instr", rows=_RUNS)
def f12_first_run_at_least(rows):
    return _by_query(rows).select("instr", S.first_run_at_least("b", 6).alias("r")).select("instr", "r.low", "r.high")


@query(
    """SELECT q.instr, CAST(coalesce(CASE WHEN arg_max(n, n * 1000 - low) >= 3 THEN arg_max(low, n * 1000 - low) + 4 ELSE arg_max(low, n * 1000 - low) END, 0) AS INT) AS low,
              CAST(coalesce(arg_max(low + n, n * 1000 - low), 0) AS INT) AS high
       FROM (SELECT DISTINCT instr FROM fx_qbyte) q LEFT JOIN (SELECT instr, min(byte_off) AS low, count(*) AS n FROM
         (SELECT instr, byte_off, byte_off - row_number() OVER (PARTITION BY instr ORDER BY byte_off) AS g FROM fx_qbyte WHERE tcn <= 4 AND label1 % 4 <> 0 AND label2 <= 15) x GROUP BY instr, g) i ON q.instr = i.instr
       GROUP BY q.instr""",
    rows="fx_qbyte",
)
def f13_exploit_pad(rows):
    """With one label unless label1 is a multiple of four, tcn 0 up to four, and label2 as liveness."""
    value = F.struct("byte_off", F.when(F.col("label1") % 4 != 0, 1).otherwise(2).alias("n"), F.when(F.col("tcn") <= 4, 0).otherwise(1).alias("t"), F.col("label2").alias("l"))
    arrays = rows.groupBy("instr").agg(F.array_sort(F.collect_list(value)).alias("a"))
    pad = S.exploit_pad(F.col("a.n"), F.col("a.t"), F.col("a.l"), need=3, most_live=15)
    return arrays.select("instr", pad.alias("r")).select("instr", "r.low", "r.high")


@query("SELECT instr, coalesce(string_agg(DISTINCT CAST(label1 AS STRING), ',' ORDER BY CAST(label1 AS STRING)), '') AS labels FROM (SELECT instr, label1 FROM fx_qbyte WHERE byte_off >= 1 AND byte_off < 4) GROUP BY instr", rows="fx_qbyte")
def f14_labels_in_range(rows):
    arrays = rows.groupBy("instr").agg(F.transform(F.array_sort(F.collect_list(F.struct("byte_off", "label1"))), lambda x: F.array(x["label1"])).alias("b"))
    found = arrays.where(F.size("b") > 1).select("instr", S.labels_in_range("b", F.lit(1), F.lit(4)).alias("labels"))
    return found.select("instr", shown(F.sort_array(F.col("labels").cast("array<string>"))).alias("labels"))


@query("SELECT seq, CASE WHEN is_call THEN callee END AS callee FROM fx_call", rows="SELECT seq, CASE WHEN is_call THEN concat('lib!', callee) ELSE callee END AS caller FROM fx_call")
def f15_callee_function(rows):
    return rows.select("seq", S.callee_function("caller").alias("callee"))


@query("SELECT count(*) AS n, CAST(count(*) AS BIGINT) AS in_range, CAST(count(*) AS BIGINT) AS kt_right FROM fx_bug", rows="fx_bug")
def f16_f17_magic_value(rows):
    m = rows.select(S.magic_value("bug", 3).alias("m"))
    good = F.lit(True)
    for i in range(4):
        byte = F.shiftright("m", 8 * i).bitwiseAND(F.lit(255))
        good = good & (byte.between(0x60, 0x79) | byte.between(0x40, 0x59))
    return m.agg(F.count("*").alias("n"), F.count_if(good).alias("in_range"), F.count_if(S.magic_kt("m") == F.col("m") % 65536).alias("kt_right"))


@query(
    """SELECT bug, concat(substr(h, 7, 2), substr(h, 5, 2), substr(h, 3, 2), substr(h, 1, 2)) AS packed, 7 * 65536 + magic % 65536 AS knob FROM
       (SELECT bug, magic, right(concat('00000000', upper(hex(magic))), 8) AS h FROM fx_bug)""",
    rows="fx_bug",
)
def f18_pack_le32(rows):
    return rows.select("bug", F.hex(S.pack_le32("magic")).alias("packed"), S.knob_value("magic", 7).alias("knob"))


@query(
    "SELECT page_id, concat('.', split_part(name, '.', 2)) AS suffix, concat(split_part(name, '.', 1), '-fuzzed-', page_id, '.', split_part(name, '.', 2)) AS fuzzed FROM (SELECT page_id, concat('in', page_id, '.html') AS name FROM pages)",
    rows="SELECT page_id, concat('in', CAST(page_id AS STRING), '.html') AS name FROM pages",
)
def f19_file_names(rows):
    return rows.select("page_id", S.file_suffix("name").alias("suffix"), S.fuzzed_name("name", "page_id").alias("fuzzed"))


@query("SELECT lval, concat('p,m', CAST(lval % 5 AS STRING), ',n') AS members FROM fx_lval", rows="SELECT lval, concat('((*p).m', CAST(lval % 5 AS STRING), ').n') AS ast_name FROM fx_lval")
def f20_lval_members(rows):
    return rows.select("lval", shown(S.lval_members("ast_name")).alias("members"))


@query("SELECT bug, CAST(CASE kind WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 6 THEN 1 WHEN 7 THEN 1 WHEN 8 THEN 1 ELSE 0 END AS INT) AS arity, CAST(CASE kind WHEN 1 THEN 20 WHEN 2 THEN 8 ELSE 0 END AS INT) AS pad FROM fx_bug", rows="fx_bug")
def f21_kind_constants(rows):
    return rows.select("bug", S.extra_dua_arity("kind").alias("arity"), S.pad_requirement("kind").alias("pad"))


@query(
    "SELECT run, i, CASE WHEN path ~ '^[LR]+$' THEN CAST(list_sum(list_transform(range(length(path)), lambda k: CASE WHEN substr(path, CAST(k + 1 AS BIGINT), 1) = 'R' THEN CAST(power(2, length(path) - 1 - k) AS BIGINT) ELSE 0 END)) AS BIGINT) END AS value FROM fx_path",
    rows="fx_path",
)
def f22_path_value(rows):
    return rows.select("run", "i", S.path_value("path").alias("value"))


@query(
    "SELECT CAST(id AS INT) AS id, value FROM fx_dict UNION ALL SELECT CAST((SELECT max(id) FROM fx_dict) + row_number() OVER (ORDER BY seq, value) AS INT) AS id, value FROM (SELECT url AS value, min(page_id) AS seq FROM pages WHERE url NOT IN (SELECT value FROM fx_dict) GROUP BY url)",
    known="fx_dict", strings="SELECT url AS value, page_id AS seq FROM pages",
)
def s4_extend_string_dict(known, strings):
    return logs.extend_string_dict(known, strings)


@query(
    """SELECT lval, ast_name, CAST(begin_line AS BIGINT) AS seq FROM fx_lval UNION ALL
       SELECT lval, arg_min(name, seq) AS ast_name, min(seq) AS seq FROM (SELECT o_custkey AS lval, concat('n', CAST(o_orderkey AS STRING)) AS name, o_orderkey AS seq FROM orders) WHERE lval NOT IN (SELECT lval FROM fx_lval) GROUP BY lval""",
    existing="SELECT lval, ast_name, CAST(begin_line AS BIGINT) AS seq FROM fx_lval", incoming="SELECT o_custkey AS lval, concat('n', CAST(o_orderkey AS STRING)) AS ast_name, o_orderkey AS seq FROM orders",
)
def s9_upsert_new(existing, incoming):
    return logs.upsert_new(existing, incoming, ["lval"], ["seq"])


@query(
    "SELECT DISTINCT CASE pos % 3 WHEN 0 THEN 'df' WHEN 1 THEN 'root' ELSE 'addvar' END AS tag, function FROM fx_frame WHERE pos <> 4",
    lines="SELECT concat(CASE WHEN pos = 4 THEN '' ELSE 'NOFILENAME ' END, CASE pos % 3 WHEN 0 THEN 'df' WHEN 1 THEN 'root' ELSE 'addvar' END, ' ', function) AS value FROM fx_frame",
)
def s11_read_whitelist(lines):
    return logs.parse_whitelist(lines)
