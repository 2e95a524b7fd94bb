"""Input synthesis and scoring of runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemine.operators import scoring as R
from tracemine.plans.registry import query, shown
from tracemine.plans.selection_queries import _BUGS, _BYTES, with_extras

_USES = "(SELECT bug, trigger_ AS dua_bytes, 0 AS pos FROM fx_bug UNION ALL SELECT bug, dua_bytes, pos + 1 AS pos FROM fx_bug_extra)"


def _labelled(dua_bytes, labels):
    sets = labels.groupBy("dua").agg(F.collect_set("label").alias("all_labels"))
    return dua_bytes.join(sets, "dua").select("dua_bytes", "all_labels")


@query(
    f"SELECT bug, string_agg(labels, ';' ORDER BY pos) AS lists FROM (SELECT u.bug, u.pos, string_agg(CAST(l.label AS STRING), ',' ORDER BY l.label) AS labels FROM {_USES} u JOIN fx_dua_bytes t ON u.dua_bytes = t.dua_bytes JOIN fx_dua_label l ON t.dua = l.dua GROUP BY u.bug, u.pos) x GROUP BY bug",
    dua_bytes=_BYTES, labels="fx_dua_label", **_BUGS,
)
def r1_fuzz_labels(bugs, extras, dua_bytes, labels):
    found = R.fuzz_labels(with_extras(bugs, extras), _labelled(dua_bytes, labels))
    return found.select("bug", F.array_join(F.transform("lists", lambda x: F.array_join(x.cast("array<string>"), ",")), ";").alias("lists"))


_VALUE = """CASE WHEN b.kind <> 2 THEN b.magic ELSE CASE b.magic % 3 WHEN 0 THEN [b.magic, 0, 1][l.pos + 1] WHEN 1 THEN [b.magic, 1, 0][l.pos + 1]
            ELSE [CAST((CAST(b.magic AS HUGEINT) * 954437177 - 2 + 4294967296) % 4294967296 AS BIGINT), 8, 4294967294][l.pos + 1] END END"""
_MUTATED = f"""
    WITH inputs AS (SELECT CAST(doc_id AS STRING) AS name, hex(encode(coalesce(text, ''))) AS h, row_number() OVER (ORDER BY CAST(doc_id AS STRING)) - 1 AS no FROM documents),
    jobs AS (SELECT b.bug, b.kind, b.magic, i.name, i.h FROM fx_bug b JOIN inputs i ON i.no = CAST(('0x' || substr(md5(concat('0:', b.bug)), 1, 8)) AS BIGINT) % (SELECT count(*) FROM documents)),
    lists AS (SELECT u.bug, row_number() OVER (PARTITION BY u.bug ORDER BY u.pos) - 1 AS pos, list_sort(list(DISTINCT l.label))[1:4] AS labels FROM {_USES} u JOIN fx_dua_bytes t ON u.dua_bytes = t.dua_bytes JOIN fx_dua_label l ON t.dua = l.dua GROUP BY u.bug, u.pos),
    valued AS (SELECT b.bug, l.pos, l.labels, {_VALUE} AS value FROM jobs b JOIN lists l ON b.bug = l.bug),
    writes AS (SELECT bug, pos, unnest(labels) AS ofs, unnest(range(len(labels))) AS i, value FROM valued WHERE value IS NOT NULL),
    bytes AS (SELECT w.bug, w.ofs, arg_max(printf('%02X', (w.value >> (8 * w.i)) & 255), w.pos * 4 + w.i) AS b FROM writes w JOIN jobs j ON j.bug = w.bug WHERE w.ofs * 2 < length(j.h) GROUP BY w.bug, w.ofs),
    parts AS (SELECT bug, ofs, b, coalesce(lag(ofs) OVER (PARTITION BY bug ORDER BY ofs) + 1, 0) AS since FROM bytes),
    heads AS (SELECT p.bug, string_agg(substr(j.h, p.since * 2 + 1, (p.ofs - p.since) * 2) || p.b, '' ORDER BY p.ofs) AS head, max(p.ofs) AS last FROM parts p JOIN jobs j ON j.bug = p.bug GROUP BY p.bug)
    SELECT j.bug, j.name, sha256(unhex(coalesce(h.head || substr(j.h, h.last * 2 + 3), j.h))) AS sha FROM jobs j JOIN (SELECT DISTINCT bug FROM lists) x ON x.bug = j.bug LEFT JOIN heads h ON h.bug = j.bug
"""


@query(_MUTATED, dua_bytes=_BYTES, labels="fx_dua_label", corpus="SELECT CAST(doc_id AS STRING) AS name, encode(coalesce(text, ''), 'UTF-8') AS content FROM documents", **_BUGS)
def r2_mutate_inputs(bugs, extras, dua_bytes, labels, corpus):
    full = with_extras(bugs, extras)
    jobs = R.pick_seeds(full.select("bug", "kind", "magic"), corpus).join(R.fuzz_labels(full, _labelled(dua_bytes, labels)), "bug").join(corpus, "name")
    return R.mutate_inputs(jobs.select("bug", "kind", "magic", "lists", "name", "content")).select("bug", "name", F.sha2("content", 256).alias("sha"))


@query(
    "SELECT concat('gen_', CAST(min(doc_id) % 7 AS STRING), '_', arg_min(lang, doc_id), '_', CAST(min(doc_id) AS STRING), '.bin') AS name, md5(text) AS digest FROM documents GROUP BY text",
    states="SELECT CAST(doc_id % 7 AS STRING) AS origin, lang AS addr, doc_id AS i, text AS content FROM documents",
)
def r3_generated_inputs(states):
    return R.generated_inputs(states).select("name", F.md5("content").alias("digest"))


@query("SELECT run, input, exitcode FROM fx_run WHERE fuzzed IS NULL AND exitcode <> 0", runs="fx_run")
def r4_baseline_check(runs):
    return R.baseline_check(runs).select("run", "input", "exitcode")


_KNOWN = "SELECT b.bug, b.kind, d.fake_dua FROM fx_bug b JOIN fx_dua d ON b.bug = d.dua"
_CRASH = "((r.exitcode % 256 + 256) % 256 > 128 AND r.exitcode <> -9)"
_VALID = f"""SELECT r.run, r.fuzzed, b.kind, b.fake_dua, {_CRASH} AS crashed, CASE WHEN b.fake_dua THEN false WHEN b.kind = 3 THEN r.output IS DISTINCT FROM o.base ELSE {_CRASH} END AS validated, (NOT b.fake_dua OR r.exitcode = 0) AS ok
             FROM fx_run r JOIN ({_KNOWN}) b ON r.fuzzed = b.bug LEFT JOIN (SELECT input, min(output) AS base FROM fx_run WHERE fuzzed IS NULL GROUP BY input) o ON r.input = o.input"""


@query(_VALID, runs="fx_run", bugs=_KNOWN)
def r5_validate_runs(runs, bugs):
    return R.validate_runs(runs, bugs).drop("input", "exitcode")


_IDS = "(SELECT run, fuzzed % 1500 AS bug FROM (SELECT run, run AS fuzzed FROM fx_run) x WHERE fuzzed % 1500 <> 0 UNION ALL SELECT run, 7 AS bug FROM fx_run WHERE run % 3 <> 0)"


@query(f"SELECT run, bug FROM {_IDS}", runs="fx_run")
def r6_crash_bug_ids(runs):
    return R.crash_bug_ids(runs)


@query(f"SELECT v.run, coalesce(i.n = 1 AND i.one = v.fuzzed, false) AS agrees FROM ({_VALID}) v LEFT JOIN (SELECT run, count(DISTINCT bug) AS n, min(bug) AS one FROM {_IDS} GROUP BY run) i ON v.run = i.run WHERE v.crashed", runs="fx_run", bugs=_KNOWN)
def r7_grading_agreement(runs, bugs):
    return R.grading_agreement(R.validate_runs(runs, bugs), R.crash_bug_ids(runs))


@query(
    f"SELECT kind, count(*) AS tried, count(*) FILTER (validated) AS validated, avg(CASE WHEN validated THEN 1.0 ELSE 0.0 END) AS yield, 1.96 * sqrt(avg(CASE WHEN validated THEN 1.0 ELSE 0.0 END) * (1 - avg(CASE WHEN validated THEN 1.0 ELSE 0.0 END)) / count(*)) AS ci FROM ({_VALID}) v GROUP BY kind",
    runs="fx_run", bugs=_KNOWN,
)
def r8_yield_with_ci(runs, bugs):
    scored = R.yield_with_ci(R.validate_runs(runs, bugs), ["kind"])
    return scored


@query(
    f"""SELECT b.kind, CAST(b.bug // 10000 AS BIGINT) AS chunk, count(*) AS potential, md5(string_agg(CAST(b.bug AS STRING), ',' ORDER BY b.bug)) AS potential_ids, count(v.bug) AS validated, md5(coalesce(string_agg(CAST(v.bug AS STRING), ',' ORDER BY v.bug), '')) AS validated_ids
        FROM fx_bug b LEFT JOIN (SELECT DISTINCT fuzzed AS bug FROM ({_VALID}) x WHERE validated) v ON b.bug = v.bug GROUP BY b.kind, b.bug // 10000""",
    runs="fx_run", bugs=_KNOWN,
)
def r9_type_breakdown(runs, bugs):
    good = R.validate_runs(runs, bugs).where("validated").select(F.col("fuzzed").alias("bug"))
    found = R.type_breakdown(bugs, good)
    return found.select("kind", "chunk", "potential", F.md5(shown("potential_ids")).alias("potential_ids"), "validated", F.md5(shown("validated_ids")).alias("validated_ids"))


@query(
    "SELECT report, coalesce(try_cast(nullif(regexp_extract(arg_max(line, line_no), '([0-9]+\\.[0-9]+)%', 1), '') AS DOUBLE), -1.0) AS coverage FROM (SELECT report % 200 AS report, line_no, line FROM fx_line WHERE line_no IS NOT NULL) x GROUP BY report",
    lines="SELECT report % 200 AS report, line_no, line FROM fx_line WHERE line_no IS NOT NULL",
)
def r10_coverage_summary(lines):
    return R.coverage_summary(lines)


@query(
    """SELECT r.run, coalesce(s.score, 0.0) AS score FROM (SELECT DISTINCT run FROM fx_path) r LEFT JOIN (SELECT run, avg(jump) AS score FROM (SELECT run, abs(value - lag(value) OVER (PARTITION BY run ORDER BY i)) AS jump FROM
       (SELECT run, i, list_sum(list_transform(range(length(path)), lambda k: CASE WHEN substr(path, CAST(k + 1 AS BIGINT), 1) = 'R' THEN CAST(power(2, length(path) - 1 - k) AS BIGINT) ELSE 0 END)) AS value FROM fx_path WHERE path ~ '^[LR]+$') x) y GROUP BY run) s ON r.run = s.run""",
    paths="fx_path",
)
def r11_path_jump_score(paths):
    return R.path_jump_score(paths)
