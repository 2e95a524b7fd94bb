"""Generation of candidate bugs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemine.functions.scalars import labels_in_range
from tracemine.operators import generation as G
from tracemine.operators.attack import bug_kinds_for_atp
from tracemine.operators.replay import liveness_snapshot
from tracemine.operators.selection import bug_counts_by_type
from tracemine.plans.mining_queries import _LIFE, lifetimes
from tracemine.plans.registry import query, shown

#: The liveness count is scaled to matter against instr.
SCALE = 200

_LIVE = "(SELECT inputfile, label, count(*) * 200 AS death_instr FROM fx_branch GROUP BY inputfile, label)"
_READY = f"""SELECT d.dua, d.inputfile, d.lval, d.instr, CAST(coalesce(m.live, 0) AS BIGINT) AS max_liveness, CAST(greatest(d.instr, coalesce(m.live, 0)) AS BIGINT) AS ready, d.file AS loc, CAST(d.dua % 30 AS INT) AS run FROM fx_dua d
             LEFT JOIN (SELECT l.dua, max(s.death_instr) AS live FROM fx_dua_label l JOIN fx_dua x ON l.dua = x.dua JOIN {_LIVE} s ON s.inputfile = x.inputfile AND s.label = l.label GROUP BY l.dua) m ON d.dua = m.dua
             WHERE NOT d.fake_dua AND d.dua IN (SELECT dua FROM fx_dua_label)"""


def ready_duas(duas, labels, branches):
    sets = labels.groupBy("dua").agg(F.sort_array(F.collect_set("label")).alias("labels"))
    snapshot = liveness_snapshot(branches).withColumn("death_instr", F.col("death_instr") * SCALE)
    named = duas.where("NOT fake_dua").select("dua", "inputfile", "lval", "instr", F.col("file").alias("loc"), (F.col("dua") % 30).cast("int").alias("run"))
    return G.dua_readiness(named.join(sets, "dua"), snapshot)


_DUAS = {"duas": "fx_dua", "labels": "fx_dua_label", "branches": "fx_branch"}


@query(_READY, **_DUAS)
def g1_dua_readiness(duas, labels, branches):
    return ready_duas(duas, labels, branches).drop("labels")


_OFFLINE = f"""SELECT inputfile, atp, lval, instr, dua FROM (SELECT e.inputfile, e.atp, r.lval, e.instr, r.dua, row_number() OVER (PARTITION BY e.inputfile, e.atp, r.lval ORDER BY e.instr, r.instr DESC, r.dua DESC) AS k
               FROM (SELECT DISTINCT inputfile, atp, instr FROM fx_exec WHERE atp_type < 3) e JOIN ({_READY}) r ON e.inputfile = r.inputfile AND r.ready < e.instr) x WHERE k = 1"""


@query(_OFFLINE, execs="SELECT DISTINCT inputfile, atp, instr FROM fx_exec WHERE atp_type < 3", **_DUAS)
def g2_offline_bugs(execs, duas, labels, branches):
    return G.offline_bugs(execs, ready_duas(duas, labels, branches))


@query(
    f"""SELECT n.kind, n.name, coalesce(c.n, 0) AS n FROM (VALUES (0, 'PTR_ADD'), (1, 'RET_BUFFER'), (2, 'REL_WRITE'), (3, 'PRINTF_LEAK'), (4, 'MALLOC_OFF_BY_ONE'), (5, 'CHAFF_STACK_UNUSED'), (6, 'CHAFF_STACK_CONST'), (7, 'CHAFF_HEAP_CONST'), (8, 'CHAFF_DIVZERO')) n(kind, name)
        LEFT JOIN (SELECT k.kind, count(*) AS n FROM ({_OFFLINE}) b JOIN (SELECT DISTINCT atp, atp_type FROM fx_exec) a ON b.atp = a.atp JOIN (VALUES (0, 0), (1, 0), (2, 0), (2, 2)) k(t, kind) ON a.atp_type = k.t GROUP BY k.kind) c ON n.kind = c.kind
        UNION ALL SELECT NULL AS kind, 'total' AS name, count(*) AS n FROM ({_OFFLINE}) b JOIN (SELECT DISTINCT atp, atp_type FROM fx_exec) a ON b.atp = a.atp JOIN (VALUES (0, 0), (1, 0), (2, 0), (2, 2)) k(t, kind) ON a.atp_type = k.t""",
    execs="SELECT DISTINCT inputfile, atp, instr FROM fx_exec WHERE atp_type < 3", points="SELECT DISTINCT atp, atp_type AS type FROM fx_exec", **_DUAS,
)
def q2_bug_counts_by_type(execs, points, duas, labels, branches):
    """How many candidate bugs of each kind there are."""
    found = G.offline_bugs(execs, ready_duas(duas, labels, branches))
    return bug_counts_by_type(found.join(bug_kinds_for_atp(points), "atp"))


_SETS = "(SELECT dua, list(DISTINCT label) AS s FROM fx_dua_label GROUP BY dua)"
_FIRST = "row_number() OVER (PARTITION BY inputfile, atp, lval ORDER BY instr, dua_instr DESC, dua DESC, pad) AS k"


@query(
    f"""SELECT inputfile, atp, lval, instr, dua, pad FROM (SELECT *, {_FIRST} FROM
        (SELECT e.inputfile, e.atp, e.instr, p.dua AS pad, t.lval, t.dua, t.instr AS dua_instr FROM fx_dua e0 JOIN (SELECT inputfile, concat('q', loc) AS atp, instr, loc FROM ({_READY})) e ON e0.dua = e.instr
         JOIN ({_READY}) p ON p.loc = e.loc AND p.inputfile = e.inputfile AND p.instr = e.instr AND p.run >= 20 JOIN ({_READY}) t ON t.inputfile = e.inputfile AND t.ready < e.instr AND t.dua <> p.dua
         JOIN {_SETS} a ON a.dua = p.dua JOIN {_SETS} b ON b.dua = t.dua WHERE NOT list_has_any(a.s, b.s)) x) y WHERE k = 1""",
    **_DUAS,
)
def g3_ret_buffer_bugs(duas, labels, branches):
    """Every DUA's own place is a query point there."""
    ready = ready_duas(duas, labels, branches)
    return G.ret_buffer_bugs(ready.select("inputfile", F.concat(F.lit("q"), "loc").alias("atp"), "loc", "instr"), ready)


@query(
    f"""SELECT inputfile, atp, lval, instr, dua, pad FROM (SELECT *, {_FIRST} FROM
        (SELECT e.inputfile, e.atp, e.instr, e.pad, t.lval, t.dua, t.instr AS dua_instr FROM
          (SELECT e.inputfile, e.atp, e.instr, arg_max(p.dua, (p.instr, p.dua)) AS pad FROM (SELECT DISTINCT inputfile, atp, instr FROM fx_exec WHERE atp_type = 2) e JOIN ({_READY}) p ON p.inputfile = e.inputfile AND p.ready < e.instr AND p.run >= 8 GROUP BY e.inputfile, e.atp, e.instr) e
         JOIN ({_READY}) t ON t.inputfile = e.inputfile AND t.ready < e.instr AND t.dua <> e.pad JOIN {_SETS} a ON a.dua = e.pad JOIN {_SETS} b ON b.dua = t.dua WHERE NOT list_has_any(a.s, b.s)) x) y WHERE k = 1""",
    execs="SELECT inputfile, atp, instr FROM fx_exec WHERE atp_type = 2", **_DUAS,
)
def g4_padded_bugs(execs, duas, labels, branches):
    return G.padded_bugs(execs, ready_duas(duas, labels, branches))


def _long_runs(order: str, where: str = "TRUE") -> str:
    """Of each DUA of many bytes one run of tainted ones."""
    return f"""(SELECT dua, low, n FROM (SELECT *, row_number() OVER (PARTITION BY dua ORDER BY {order}) AS k FROM (SELECT dua, CAST(min(byte_off) AS INT) AS low, count(*) AS n FROM
               (SELECT dua, byte_off, byte_off - row_number() OVER (PARTITION BY dua ORDER BY byte_off) AS g FROM fx_gbyte WHERE NOT untainted) x GROUP BY dua, g) y WHERE {where}) z WHERE k = 1)"""


def _slice(runs: str, size: int) -> str:
    """Distinct labels of the first ``size`` bytes of runs that have so many."""
    return f"(SELECT r.dua, r.low, list_sort(list(DISTINCT e.label)) AS s FROM {runs} r JOIN (SELECT dua, byte_off, unnest([label1, label2]) AS label FROM fx_gbyte WHERE NOT untainted) e ON e.dua = r.dua AND e.byte_off >= r.low AND e.byte_off < r.low + {size} WHERE r.n >= {size} GROUP BY r.dua, r.low)"


_LONGEST = _long_runs("n DESC, low")
_READY_BYTES = f"""SELECT d.dua, d.inputfile, d.lval, d.instr, d.loc, CAST(coalesce(m.live, 0) AS BIGINT) AS max_liveness, CAST(greatest(d.instr, coalesce(m.live, 0)) AS BIGINT) AS ready, CAST(r.low AS INT) AS run_low, CAST(r.n AS INT) AS run, t.low AS low, t.low + 4 AS high, t.s AS s
             FROM (SELECT DISTINCT dua, inputfile, lval, instr, loc FROM fx_gbyte) d JOIN {_LONGEST} r ON r.dua = d.dua LEFT JOIN {_slice(_LONGEST, 4)} t ON t.dua = d.dua
             LEFT JOIN (SELECT e.dua, max(s.death_instr) AS live FROM (SELECT dua, inputfile, unnest([label1, label2]) AS label FROM fx_gbyte WHERE NOT untainted) e JOIN {_LIVE} s ON s.inputfile = e.inputfile AND s.label = e.label GROUP BY e.dua) m ON m.dua = d.dua"""


def ready_bytes(rows, branches, pad=0, first=False):
    """DUAs of many bytes, with their ranges; those without a viable byte are none."""
    labels = F.when(~F.col("untainted"), F.sort_array(F.array_distinct(F.array("label1", "label2"))))
    byte = F.transform(F.array_sort(F.collect_list(F.struct("byte_off", labels.alias("labels")))), lambda x: x["labels"])
    duas = G.byte_ranges(rows.groupBy("dua", "inputfile", "lval", "instr", "loc").agg(byte.alias("byte_labels")), pad, first)
    snapshot = liveness_snapshot(branches).withColumn("death_instr", F.col("death_instr") * SCALE)
    return G.dua_readiness(duas.where("run > 0"), snapshot)


_BYTES = {"rows": "fx_gbyte", "branches": "fx_branch"}


@query(f"SELECT dua, inputfile, lval, instr, max_liveness, ready, run_low, run, low, high, coalesce(array_to_string(s, ','), '') AS labels FROM ({_READY_BYTES}) x", **_BYTES)
def g1_readiness_from_bytes(rows, branches):
    """Longest runs, and the labels of the four bytes that a trigger takes."""
    found = ready_bytes(rows, branches)
    return found.select("dua", "inputfile", "lval", "instr", "max_liveness", "ready", "run_low", "run", "low", "high", F.coalesce(shown("trigger_labels"), F.lit("")).alias("labels"))


@query(
    f"""SELECT inputfile, atp, lval, instr, dua, low, high FROM (SELECT e.inputfile, e.atp, r.lval, e.instr, r.dua, r.low, r.high, row_number() OVER (PARTITION BY e.inputfile, e.atp, r.lval ORDER BY e.instr, r.instr DESC, r.dua DESC) AS k
        FROM (SELECT DISTINCT inputfile, atp, instr FROM fx_exec WHERE atp_type < 2) e JOIN ({_READY_BYTES}) r ON e.inputfile = r.inputfile AND r.ready < e.instr AND r.run >= 4) x WHERE k = 1""",
    execs="SELECT DISTINCT inputfile, atp, instr FROM fx_exec WHERE atp_type < 2", **_BYTES,
)
def g2_triggers_from_bytes(execs, rows, branches):
    duas = ready_bytes(rows, branches).where("low IS NOT NULL")
    return G.with_ranges(G.offline_bugs(execs, duas), duas).drop("trigger_labels")


def _padded_sql(execs: str, pads: str) -> str:
    """execs with their ``pad``; pads: ``dua``, ``low``, ``s``."""
    return f"""SELECT inputfile, atp, lval, instr, dua, low, high, pad, pad_low, labels FROM (SELECT *, {_FIRST} FROM
        (SELECT e.inputfile, e.atp, e.instr, e.pad, p.low AS pad_low, t.lval, t.dua, t.instr AS dua_instr, t.low, t.high, array_to_string(t.s, ',') AS labels FROM ({execs}) e JOIN {pads} p ON p.dua = e.pad
         JOIN ({_READY_BYTES}) t ON t.inputfile = e.inputfile AND t.ready < e.instr AND t.dua <> e.pad AND t.run >= 4 WHERE NOT list_has_any(p.s, t.s)) x) y WHERE k = 1"""


def _padded(found, duas):
    return G.with_ranges(found, duas, pads=True).select("inputfile", "atp", "lval", "instr", "dua", "low", "high", "pad", "pad_low", shown("trigger_labels").alias("labels"))


@query(_padded_sql(f"SELECT inputfile, concat('q', loc) AS atp, instr, dua AS pad FROM ({_READY_BYTES}) q WHERE run >= 20", _slice(_long_runs("low", "n >= 20"), 20)), **_BYTES)
def g3_pads_from_bytes(rows, branches):
    """Every DUA's own place is a query point there; the pad is the first 20 bytes of its first run of so many, whatever their liveness."""
    duas = ready_bytes(rows, branches, 20, first=True).where("low IS NOT NULL")
    return _padded(G.ret_buffer_bugs(duas.select("inputfile", F.concat(F.lit("q"), "loc").alias("atp"), "loc", "instr"), duas), duas)


@query(
    _padded_sql(
        f"""SELECT e.inputfile, e.atp, e.instr, arg_max(p.dua, (p.instr, p.dua)) AS pad FROM (SELECT DISTINCT inputfile, atp, instr FROM fx_exec WHERE atp_type = 2) e
            JOIN ({_READY_BYTES}) p ON p.inputfile = e.inputfile AND p.ready < e.instr AND p.run >= 8 GROUP BY e.inputfile, e.atp, e.instr""",
        _slice(_LONGEST, 8),
    ),
    execs="SELECT inputfile, atp, instr FROM fx_exec WHERE atp_type = 2", **_BYTES,
)
def g4_pads_from_bytes(execs, rows, branches):
    """The pad is the first eight bytes of the longest run of the newest DUA that has so many."""
    duas = ready_bytes(rows, branches, 8).where("low IS NOT NULL")
    return _padded(G.padded_bugs(execs, duas), duas)


@query("SELECT inputfile, atp, instr, 5 AS kind FROM fx_exec WHERE atp_type = 3", execs="SELECT * FROM fx_exec WHERE atp_type = 3")
def g5_chaff_unused_bugs(execs):
    return G.chaff_unused_bugs(execs)


def _drawn(*parts: str) -> str:
    """A whole number under 2**52 by the md5 of 0 and these."""
    return "CAST(('0x' || substr(md5(concat('0:', " + ", ':', ".join(parts) + ")), 1, 13)) AS BIGINT)"


@query(
    f"""SELECT p.inputfile, p.atp, p.instr, r.dua, unnest([6, 7, 8]) AS kind FROM
          (SELECT inputfile, atp, instr, unnest(CASE WHEN n = 1 THEN [0] WHEN n = 2 THEN [0, 1] ELSE [a, CASE WHEN b = a THEN n - 1 ELSE b END] END) AS rank FROM
            (SELECT *, {_drawn("'0'", "atp", "instr")} % greatest(n - 1, 1) AS a, {_drawn("'1'", "atp", "instr")} % n AS b FROM
              (SELECT e.inputfile, e.atp, e.instr, count(*) AS n FROM (SELECT DISTINCT inputfile, atp, instr FROM fx_exec WHERE atp_type = 3) e JOIN ({_READY}) r ON e.inputfile = r.inputfile AND r.ready < e.instr GROUP BY ALL) c) x) p
        JOIN (SELECT dua, inputfile, row_number() OVER (PARTITION BY inputfile ORDER BY ready, dua) - 1 AS rank FROM ({_READY}) y) r ON r.inputfile = p.inputfile AND r.rank = p.rank""",
    execs="SELECT DISTINCT inputfile, atp, instr FROM fx_exec WHERE atp_type = 3", **_DUAS,
)
def g6_chaff_sampled_bugs(execs, duas, labels, branches):
    return G.chaff_sampled_bugs(execs, ready_duas(duas, labels, branches))


_PROBES = "SELECT 't' AS trace_id, instr AS probe_seq, min(atp) AS atp FROM fx_exec WHERE atp_type = 1 GROUP BY instr"
_DEADBYTES = """(SELECT b.seq, b.offset_, b.label1, b.label2, b.untainted, least(d1.death_seq, d2.death_seq) AS dead_at FROM fx_bytes b LEFT JOIN fx_death d1 ON b.inputfile = d1.inputfile AND b.label1 = d1.label
                LEFT JOIN fx_death d2 ON b.inputfile = d2.inputfile AND b.label2 = d2.label)"""


def _online(start: str, excluded: str) -> str:
    return f"""SELECT probe_seq, atp, lval, seq AS dua, min(low) AS low, min(low) + 4 AS high FROM
        (SELECT probe_seq, atp, lval, seq, min(offset_) AS low, count(*) AS n FROM (SELECT *, offset_ - row_number() OVER (PARTITION BY probe_seq, seq ORDER BY offset_) AS g FROM
          (SELECT p.probe_seq, p.atp, l.lval, l.seq, b.offset_ FROM ({_PROBES}) p JOIN ({_LIFE}) l ON l.seq {start} p.probe_seq AND (l."end" IS NULL OR p.probe_seq < l."end") JOIN {_DEADBYTES} b ON b.seq = l.seq
           WHERE NOT b.untainted AND (b.dead_at IS NULL OR b.dead_at > p.probe_seq) AND {excluded}) x) y GROUP BY probe_seq, atp, lval, seq, g) z WHERE n >= 4 GROUP BY probe_seq, atp, lval, seq"""


_ROWS = {"rows": "fx_bytes", "death": "fx_death"}


@query(_online("<=", "b.label1 NOT IN (3, 4) AND b.label2 NOT IN (3, 4)"), probes=_PROBES, **_ROWS)
def g7_online_bugs(probes, rows, death):
    alive = lifetimes(rows, death).withColumn("dua", F.col("seq"))
    return G.online_bugs(probes, alive, [3, 4]).drop("trace_id")


@query(_online("<", "(p.atp LIKE '%1' OR p.atp LIKE '%2')"), probes=f"SELECT trace_id, probe_seq, atp, 20 AS len, CASE WHEN atp LIKE '%1' THEN 20 ELSE 0 END AS pad, atp LIKE '%2' AS fake FROM ({_PROBES}) p", **_ROWS)
def g8_ret_buffer_online(probes, rows, death):
    alive = lifetimes(rows, death).withColumn("dua", F.col("seq"))
    return G.ret_buffer_online(probes, alive).drop("trace_id")


def _triggers(which: str) -> str:
    """Triggers with how many DUAs of their file are older."""
    return f"""SELECT f.dua AS bug, f.inputfile, l.s, (SELECT count(*) FROM fx_dua o WHERE o.inputfile = f.inputfile AND o.instr < f.instr AND o.dua IN (SELECT dua FROM fx_dua_label)) AS n FROM fx_dua f JOIN {_SETS} l ON f.dua = l.dua WHERE {which}"""


def _older(i: int, n: int, bugs: str, seen: str) -> str:
    """A round of picking: of the two older DUAs drawn for each bug the first that shares no label with what the bug has."""
    return f"""SELECT bug, inputfile, n, s, xs, n_labels FROM (SELECT b.bug, b.inputfile, b.n, list_concat(b.s, d.s) AS s, {seen} AS xs, len(b.s) + len(d.s) AS n_labels, row_number() OVER (PARTITION BY b.bug ORDER BY t.t) AS k
               FROM ({bugs}) b CROSS JOIN (VALUES (0), (1)) t(t)
               JOIN (SELECT f.dua, f.inputfile, l.s, row_number() OVER (PARTITION BY f.inputfile ORDER BY f.instr, f.dua) - 1 AS rank FROM fx_dua f JOIN {_SETS} l ON f.dua = l.dua) d
                 ON d.inputfile = b.inputfile AND d.rank = {_drawn(f"'{i}'", "b.bug", "t.t")} % b.n
               WHERE b.n > {n} AND NOT list_has_any(b.s, d.s)) e WHERE k = 1"""


_FIRST_ONE, _NEXT_ONE = "CAST(d.dua AS STRING)", "concat(b.xs, ',', CAST(d.dua AS STRING))"


@query(
    f"SELECT bug, xs AS extra FROM ({_older(0, 1, _triggers('f.fake_dua'), _FIRST_ONE)}) z",
    duas="fx_dua", labels="fx_dua_label",
)
def g9_pick_extra_duas(duas, labels):
    """Fake DUAs are the triggers of bugs, which need no number of labels."""
    sets = labels.groupBy("dua").agg(F.sort_array(F.collect_set("label")).alias("labels"))
    own = duas.select("dua", "inputfile", "instr", "fake_dua").join(sets, "dua")
    return G.pick_extra_duas(own.where("fake_dua").withColumnRenamed("dua", "bug"), own, 1).select("bug", shown("extra_duas").alias("extra"))


@query(
    f"SELECT bug, xs AS extra FROM ({_older(1, 2, _older(0, 2, _triggers('NOT f.fake_dua'), _FIRST_ONE), _NEXT_ONE)}) z WHERE n_labels >= 8",
    duas="fx_dua", labels="fx_dua_label",
)
def g9_pick_two_extra_duas(duas, labels):
    """Real DUAs are the triggers of bugs with two extra DUAs each."""
    sets = labels.groupBy("dua").agg(F.sort_array(F.collect_set("label")).alias("labels"))
    own = duas.select("dua", "inputfile", "instr", "fake_dua").join(sets, "dua")
    return G.pick_extra_duas(own.where("NOT fake_dua").withColumnRenamed("dua", "bug"), own, 2).select("bug", shown("extra_duas").alias("extra"))


_LIVES = f"({_LIFE})"
_LAST = "(SELECT max(probe_seq) AS last FROM (" + _PROBES + ") q)"
#: The DUAs active at each probe, each with the size of the dyadic interval of its lifetime that holds the probe.
_ACTIVE = f"""(SELECT p.probe_seq, l.seq, CAST(list_max(list_filter(range(0, 40), lambda k: (p.probe_seq >> k) << k >= l.seq AND ((p.probe_seq >> k) + 1 << k) - 1 <= least(coalesce(l."end" - 1, x.last), x.last))) AS INT) AS level
    FROM ({_PROBES}) p JOIN {_LIVES} l ON l.seq <= p.probe_seq AND (l."end" IS NULL OR p.probe_seq < l."end"), {_LAST} x)"""
#: A bug per probe: its trigger is the newest active DUA, of which it takes the first four bytes that are alive.
_NEWEST = f"""(SELECT probe_seq AS bug, seq AS start FROM (SELECT probe_seq, seq, row_number() OVER (PARTITION BY probe_seq ORDER BY seq DESC) AS k FROM {_ACTIVE} a) y WHERE k = 1)"""


def _windows(pairs: str, labels: str) -> str:
    """The first four bytes of pairs' DUAs (``bug``, ``seq``, ``s`` and others) that are alive at the bug and free of the labels s, with their labels ``w``."""
    return f"""SELECT c.*, f.low, (SELECT list(DISTINCT z.label) FROM (SELECT unnest([label1, label2]) AS label, seq, offset_ FROM {_DEADBYTES} d) z WHERE z.seq = c.seq AND z.offset_ >= f.low AND z.offset_ < f.low + 4) AS w FROM ({pairs}) c JOIN
        (SELECT bug, seq, min(low) AS low FROM (SELECT bug, seq, min(offset_) AS low, count(*) AS n FROM (SELECT *, offset_ - row_number() OVER (PARTITION BY bug, seq ORDER BY offset_) AS g FROM
          (SELECT DISTINCT c.bug, c.seq, b.offset_ FROM ({pairs}) c JOIN {_DEADBYTES} b ON b.seq = c.seq WHERE NOT b.untainted AND (b.dead_at IS NULL OR b.dead_at > c.bug) AND {labels}) x) y GROUP BY bug, seq, g) z WHERE n >= 4 GROUP BY bug, seq) f
        ON f.bug = c.bug AND f.seq = c.seq"""


def _free(i: int, bugs: str) -> str:
    """A round of picking a free range for bugs (``bug``, ``s``)."""
    ranks = f"(SELECT a.probe_seq AS bug, a.seq, row_number() OVER (PARTITION BY a.probe_seq ORDER BY a.level, a.seq) - 1 AS rank, count(*) OVER (PARTITION BY a.probe_seq) AS n FROM {_ACTIVE} a JOIN {_NEWEST} t ON t.bug = a.probe_seq AND a.seq < t.start)"
    pairs = f"SELECT b.bug, b.s, r.seq, t.t FROM ({bugs}) b CROSS JOIN (VALUES (0), (1)) t(t) JOIN {ranks} r ON r.bug = b.bug AND r.n > 1 AND r.rank = {_drawn(f"'{i}'", 'b.bug', 't.t')} % r.n"
    return f"SELECT bug, list_concat(s, w) AS s, concat(q.seq, '@', q.low) AS xs FROM (SELECT *, row_number() OVER (PARTITION BY bug ORDER BY t) AS k FROM ({_windows(pairs, 'NOT list_contains(c.s, b.label1) AND NOT list_contains(c.s, b.label2)')}) v) q WHERE k = 1"


_TRIGGERED = f"SELECT bug, w AS s FROM ({_windows(f'SELECT bug, start AS seq, CAST([] AS INT[]) AS s FROM {_NEWEST} n', 'TRUE')}) h"


@query(f"SELECT bug, xs AS extra FROM ({_free(0, _TRIGGERED)}) o WHERE len(list_distinct(s)) >= 4", probes=_PROBES, **_ROWS)
def g9_pick_free_ranges(probes, rows, death):
    """An extra DUA for a bug at each probe whose trigger is the newest active DUA."""
    alive = lifetimes(rows, death).withColumn("dua", F.col("seq"))
    steps = G.online_bugs(probes, alive)
    newest = steps.groupBy("trace_id", "probe_seq").agg(F.max(F.struct("dua", "low")).alias("t")).select("trace_id", "probe_seq", F.col("t.dua").alias("dua"), F.col("t.low").alias("low"))
    own = alive.select("dua", "start", F.col("labels").alias("own"))
    taken = labels_in_range("own", F.col("low"), F.col("low") + 4)
    bugs = newest.join(own, "dua").select(F.col("probe_seq").alias("bug"), "trace_id", "probe_seq", "start", taken.alias("labels"), F.lit(False).alias("fake_dua"))
    found = G.pick_free_ranges(bugs, alive, 1)
    return found.select("bug", F.array_join(F.zip_with("extra_duas", "extra_lows", lambda d, at: F.concat(d.cast("string"), F.lit("@"), at.cast("string"))), ",").alias("extra"))


@query(
    """SELECT bug, max(n) AS max_liveness FROM (SELECT d.dua AS bug, l.label, count(b.seq) AS n FROM fx_dua d JOIN fx_dua_label l ON d.dua = l.dua
       LEFT JOIN fx_branch b ON b.inputfile = d.inputfile AND b.label = l.label AND b.seq <= d.instr GROUP BY d.dua, l.label) x GROUP BY bug""",
    duas="fx_dua", labels="fx_dua_label", branches="fx_branch",
)
def g10_bug_max_liveness(duas, labels, branches):
    sets = labels.groupBy("dua").agg(F.collect_set("label").alias("labels"))
    return G.bug_max_liveness(duas.join(sets, "dua").select(F.col("dua").alias("bug"), "inputfile", F.col("instr").alias("seq"), "labels"), branches)


@query("SELECT bug, atp, kind, trigger_lval AS lval FROM fx_bug b WHERE bug NOT IN (SELECT bug FROM fx_build_bug) AND NOT EXISTS (SELECT 1 FROM fx_bug k WHERE k.bug IN (SELECT bug FROM fx_build_bug) AND k.atp = b.atp AND k.kind = b.kind AND k.trigger_lval = b.trigger_lval)", bugs="SELECT bug, atp, kind, trigger_lval AS lval FROM fx_bug", built="fx_build_bug")
def g11_skip_known_lvals(bugs, built):
    """Bugs of builds are known."""
    return G.skip_known_lvals(bugs.join(built, "bug", "left_anti"), bugs.join(built, "bug", "left_semi"))


@query("SELECT DISTINCT kind, atp, trigger_ % 50 AS trigger, CAST(bug % 4 AS STRING) AS extra FROM fx_bug", bugs="SELECT kind, atp, trigger_ % 50 AS trigger, array(bug % 4) AS extra_duas FROM fx_bug")
def g12_dedupe_bugs(bugs):
    return G.dedupe_bugs(bugs).select("kind", "atp", "trigger", shown("extra_duas").alias("extra"))


@query(
    """SELECT bug, b.kind FROM (SELECT bug, CASE WHEN kind < 7 THEN 0 ELSE kind END AS kind FROM fx_bug) b JOIN (SELECT kind, n - avg(n) OVER () AS excess FROM (SELECT CASE WHEN kind < 7 THEN 0 ELSE kind END AS kind, count(*) AS n FROM fx_bug GROUP BY 1) c) s ON b.kind = s.kind
       WHERE CAST(('0x' || substr(md5(concat('0:', bug)), 1, 8)) AS BIGINT) / 4294967296.0 < CASE WHEN excess >= 5 THEN 1 / (1 + 0.2 * (excess - 5)) ELSE 1.0 END""",
    bugs="SELECT bug, CASE WHEN kind < 7 THEN 0 ELSE kind END AS kind FROM fx_bug",
)
def g13_decimate_by_type(bugs):
    return G.decimate_by_type(bugs, slack=5)


@query(
    """SELECT atp, count(*) FILTER (r = 'a') AS no_pad, count(*) FILTER (r = 'b') AS duplicate, count(*) FILTER (r = 'c') AS liveness_too_small, count(*) FILTER (r = 'd') AS not_disjoint, count(*) FILTER (r = 'e') AS success
       FROM (SELECT atp, CASE WHEN bug % 5 = 0 THEN 'a' WHEN bug % 4 = 0 THEN 'b' WHEN max_liveness < 9 THEN 'c' WHEN bug % 7 = 0 THEN 'd' ELSE 'e' END AS r FROM fx_bug) x GROUP BY atp""",
    cands="SELECT atp, bug % 5 = 0 AS no_pad, bug % 4 = 0 AS duplicate, max_liveness < 9 AS liveness_too_small, bug % 7 = 0 AS not_disjoint FROM fx_bug",
)
def g14_generation_funnel(cands):
    return G.generation_funnel(cands)


@query("SELECT count(*) FILTER (NOT fake_dua) AS bugs, count(*) FILTER (fake_dua) AS non_bugs FROM fx_dua", bugs="fx_dua")
def g15_potential_totals(bugs):
    return G.potential_totals(bugs, strict=True)
