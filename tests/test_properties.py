"""Closed forms against sequential models on random inputs, and the queries against DuckDB."""

import glob
import hashlib
import os
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tracemine.functions import scalars as S
from tracemine.operators import callgraph, cleaning, generation, lives, mining, ordered, placement, replay, scoring, selection
from tracemine.plans import registry
from tracemine.sources import logs
from tracemine.streaming import streams

SF = "/root/testdata/sf0.001"


def random_events(rng, traces, n):
    """DUAs with a label per byte, and branches."""
    out = []
    for t in range(traces):
        for seq in range(n):
            if rng.random() < 0.45:
                labels = [None if rng.random() < 0.15 else [rng.randrange(6)] for _ in range(rng.randint(4, 7))]
                out.append((f"t{t}", seq, f"v{rng.randrange(3)}", labels))
            else:
                out.append((f"t{t}", seq, None, [rng.sample(range(6), rng.randint(1, 3))]))
    return out


EVENTS = "trace_id string, seq long, lval string, labels array<array<int>>"


def closed_form(spark, events, limit):
    branches = events.where("lval IS NULL").select(F.col("trace_id").alias("inputfile"), "seq", F.explode(F.flatten("labels")).alias("label")).distinct()
    death = replay.label_death(branches, limit)
    rows = events.where("lval IS NOT NULL").select("trace_id", "seq", F.col("trace_id").alias("inputfile"), "lval", F.posexplode("labels").alias("offset", "labels"))
    byte = mining.byte_death(rows.where("labels IS NOT NULL"), death).select("trace_id", "seq", "offset", "dead_at", F.lit(True).alias("ok"))
    full = rows.join(byte, ["trace_id", "seq", "offset"], "left").groupBy("trace_id", "seq", "inputfile", "lval").agg(F.array_sort(F.collect_list(F.struct("offset", "ok", "dead_at"))).alias("b"))
    named = full.select("trace_id", "seq", "inputfile", "lval", F.transform("b", lambda x: F.coalesce(x["ok"], F.lit(False))).alias("usable"), F.transform("b", lambda x: x["dead_at"]).alias("deaths"), F.lit(False).alias("fake_dua"), F.col("lval").alias("ast_name"), F.array().cast("array<int>").alias("all_labels"))
    alive = S.first_dead_run(F.zip_with("usable", "deaths", lambda ok, d: ok & (d.isNull() | (d > F.col("seq")))))
    labels = events.where("lval IS NOT NULL").select("trace_id", "seq", F.size(F.array_distinct(F.flatten(F.filter("labels", lambda b: b.isNotNull())))).alias("n_labels"))
    many = (F.col("n_labels") >= 4) & (F.size(F.filter("usable", lambda ok: ok)) >= 4)
    # a candidate that is no DUA leaves that of its lvalue as it is
    spans = mining.dua_lifetimes(named.join(labels, ["trace_id", "seq"]).where(many & (alive["high"] > 0)).drop("n_labels"))
    return {(r["trace_id"], r["lval"], r["start"], r["end"], r["reason"]) for r in spans.collect()}


def test_lifetimes_equal_sequential_replay(spark):
    rng = random.Random(7)
    events = spark.createDataFrame(random_events(rng, 60, 40), EVENTS)
    exact = {tuple(r) for r in mining.replay_exact(events, 3, erase_siblings=False).select("trace_id", "lval", "seq", "end", "reason").collect()}
    assert closed_form(spark, events, 3) == exact and len(exact) > 100


def mixed_events(rng, traces, n, groups=6):
    """Events of several groups of lvalues and labels, with fake and nodua ones; a branch touches labels of several groups."""
    out = []
    for t in range(traces):
        for seq in range(n):
            g = rng.randrange(groups)
            if rng.random() < 0.5:
                labels = [None if rng.random() < 0.1 else [g * 10 + rng.randrange(6)] for _ in range(rng.randint(4, 7))]
                v = rng.randrange(3)
                out.append((f"t{t}", seq, f"v{g}.{v}", labels, rng.choice([None, 3, 4, 7]), v == 2 and g % 2 == 0, v == 1 and g % 3 == 0))
            else:
                out.append((f"t{t}", seq, None, [rng.sample(range(groups * 10), 9)], None, None, None))
    return out


MIXED = EVENTS + ", num_tainted int, fake boolean, nodua boolean"


def whole_replay(events, limit, erase):
    """Each trace in one piece."""
    out = set()
    for t in sorted({e[0] for e in events}):
        rule, since = lives.Lives(limit, 4, erase, {}, {}, {}), {}
        for _, seq, lval, labels, tainted, fake, nodua in sorted((e for e in events if e[0] == t), key=lambda e: e[1]):
            for v, born, what in rule.query(seq, lval, labels, tainted, bool(fake), bool(nodua)) if lval else rule.branch(labels[0]):
                if what == "born":
                    since[v] = born
                else:
                    out.add((t, v, since.pop(v), seq, what))
        out |= {(t, v, born, None, "alive") for v, born in since.items()}
    return out


@pytest.mark.parametrize("erase", [False, True])
def test_shards_of_a_trace_are_replayed_apart(spark, erase):
    """Rows are those of the whole trace; one trace makes many tasks' groups, and no label is in two of them."""
    events = mixed_events(random.Random(3), 2, 300)
    df = spark.createDataFrame(events, MIXED).repartition(4)
    found = [tuple(r) for r in mining.replay_exact(df, 15, erase_siblings=erase).select("trace_id", "lval", "seq", "end", "reason").collect()]
    assert len(found) == len(set(found)) and set(found) == whole_replay(events, 15, erase) and len(found) > 100
    assert {r[4] for r in found} == {"alive", "died", "replaced"}
    sizes = lives.shard_sizes(df).collect()
    assert all(sum(r["trace_id"] == t for r in sizes) >= 6 for t in ("t0", "t1")) and all(r["lvals"] <= 3 for r in sizes)
    labels = lives.with_shards(df).select("trace_id", "shard", F.explode(F.flatten(F.filter("labels", lambda b: b.isNotNull()))).alias("label")).distinct()
    assert labels.groupBy("trace_id", "label").count().where("count > 1").isEmpty()


@pytest.mark.parametrize("strict", [False, True])
def test_active_duas_equal_all_pairs(spark, strict):
    """Dyadic intervals of lifetimes that are short, long, empty or without an end."""
    rng = random.Random(12)
    lives = [(f"t{rng.randrange(2)}", i, (a := rng.randrange(300)), None if rng.random() < 0.2 else a + rng.choice((0, 1, 2, 3, rng.randrange(200), 5000))) for i in range(150)]
    probes = sorted({(f"t{rng.randrange(3)}", rng.randrange(420)) for _ in range(120)})
    expected = sorted((t, p, i) for t, p in probes for u, i, a, z in lives if t == u and (a < p if strict else a <= p) and (z is None or p < z))
    found = mining.active_duas(spark.createDataFrame(probes, "trace_id string, probe_seq long"), spark.createDataFrame(lives, "trace_id string, dua long, start long, end long"), strict)
    assert sorted((r["trace_id"], r["probe_seq"], r["dua"]) for r in found.collect()) == expected and len(expected) > 100


def test_ordered_passes_equal_loops_and_spread_a_key(spark):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.9 else rng.choice(["a", None]), i, rng.choice([-1, 1]), rng.choice([None, None, "x", "y"])) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, seq long, step long, mark string").repartition(5)
    parts = [r["n"] for r in ordered.placed(df, ["k"], "seq").groupBy("__part").agg(F.count("*").alias("n")).collect()]
    assert max(parts) < len(rows) // 2
    expected = {}
    for key in ("hot", "a", None):
        own = [r for r in rows if r[0] == key]
        total = level = 0
        last = None
        for r, after in zip(own, [*own[1:], None], strict=True):
            level, last = max(0, level + r[2]), r[3] or last
            expected[r[1]] = (total, total + r[2], level, last, after and (after[1], after[2]))
            total += r[2]
    step = F.col("step")
    out = ordered.sum_so_far(df, ["k"], "seq", step, "before")
    out = ordered.sum_so_far(out, ["k"], "seq", step, "upto", ties=True)
    out = ordered.with_next(ordered.last_so_far(ordered.lifted_sum(out, ["k"], "seq", step, "level"), ["k"], "seq", "mark", "last"), ["k"], "seq", ["step"], "next")
    assert {r["seq"]: (r["before"], r["upto"], r["level"], r["last"], r["next"] and tuple(r["next"])) for r in out.collect()} == expected
    none = df.limit(0)
    assert ordered.sum_so_far(none, ["k"], "seq", step, "n").count() == ordered.with_next(none, ["k"], "seq", ["step"], "n").count() == 0


@pytest.mark.parametrize("parts", [4, 8, 200])
def test_numbers_are_dense_whatever_the_partitions(spark, parts):
    """With columns beside the order, of which the counts need none, and more rows than a range partitioning samples."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rows = spark.range(100_000).select((F.col("id") * 7919 % 100_003).alias("k"), F.col("id").alias("other"), F.lit("x").alias("more"))
        got = logs.numbered(rows, ["k"], "no")
        wrong = got.withColumn("less", F.lag("k").over(Window.orderBy("no"))).where("less >= k OR (less IS NULL AND no <> 0)")
        assert got.agg(F.count("*"), F.countDistinct("no"), F.min("no"), F.max("no")).first() == (100_000, 100_000, 0, 99_999) and wrong.isEmpty()
        known = logs.extend_string_dict(spark.createDataFrame([(3, "old")], "id int, value string"), rows.select(F.concat(F.lit("s"), "k").alias("value"), F.col("other").alias("seq")))
        assert known.agg(F.count("*"), F.countDistinct("id"), F.min("id"), F.max("id")).first() == (100_001, 100_001, 3, 100_003)
        picked = scoring.pick_seeds(rows.limit(50).select(F.col("k").alias("bug")), rows.select(F.col("k").cast("string").alias("name"), "other"))
        assert picked.count() == 50 and picked.where("name IS NULL").isEmpty()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_slots_of_triggers_and_extras(spark):
    """Each list has its own slots; a value that two DUAs give is read at two places and has one slot."""
    bugs = spark.createDataFrame([(1, 0, 10, [30]), (2, 5, 20, [10]), (3, 1, 40, [20, 30])], "bug long, kind int, trigger long, extra_duas array<long>")
    cut = spark.createDataFrame([(10, 1, 0, 4), (20, 2, 0, 4), (30, 3, 2, 6), (40, 4, 0, 4)], "dua_bytes long, dua long, low int, high int")
    duas = spark.createDataFrame([(1, "v", 100), (2, "v", 101), (3, "w", 100), (4, "u", 999)], "dua long, lval string, trace_index long")
    steps = spark.createDataFrame([(100, "a:1"), (101, "a:2")], "index long, loc string")
    found = sorted(tuple(r) for r in placement.siphon_slots(bugs, cut, duas, steps).select("list", "lval", "low", "loc", "slot").collect())
    assert found == [("extra", "v", 0, "a:2", 1), ("extra", "w", 2, "a:1", 0), ("trigger", "v", 0, "a:1", 0), ("trigger", "v", 0, "a:2", 0)]


def test_scopes_equal_all_pairs(spark):
    """Nested, equal, empty and neighbouring bodies; the rows that the join forms are the rows returned."""
    rng = random.Random(9)
    bodies = [(f"f{rng.randrange(2)}", f"g{i}", (a := rng.randrange(60)), rng.randrange(80), a + rng.choice([0, 0, 3, 40]), rng.randrange(80)) for i in range(70)]
    duas = [(i, f"f{rng.randrange(3)}", rng.randrange(110), rng.randrange(80)) for i in range(300)]
    expected = sorted((d, f, g) for d, f, line, c in duas for h, g, bl, bc, el, ec in bodies if f == h and (bl, bc) <= (line, c) <= (el, ec))
    found = cleaning.dua_scope_join(spark.createDataFrame(duas, "dua long, file string, line int, column int"), spark.createDataFrame(bodies, "file string, function string, begin_line int, begin_column int, end_line int, end_column int"))
    assert sorted(tuple(r) for r in found.collect()) == expected and len(expected) > 500


def test_closure_writes_each_name_once(spark):
    """A chain with a hub and a cycle: rounds write what they reach, and nothing else."""
    judgement = spark.createDataFrame([("bad", 3), *((f"n{i}", 0) for i in range(12)), ("free", 0)], "name string, flag int")
    edges = [("bad", "n0"), *((f"n{i}", f"n{i + 1}") for i in range(8)), ("n8", "n2"), ("n3", "n9"), ("free", "n11"), ("n9", "gone")]
    before = set(glob.glob(spark.sparkContext.getCheckpointDir().removeprefix("file:") + "/closure-*"))
    closed = callgraph.close_over_callers(judgement, spark.createDataFrame([(b, a) for a, b in edges], "name string, containing_function string"))
    assert {r["name"] for r in closed.where("flag = 0").collect()} == {"n10", "n11", "free"}
    (path,) = set(glob.glob(spark.sparkContext.getCheckpointDir().removeprefix("file:") + "/closure-*")) - before
    written = [r["name"] for r in spark.read.schema("name string").parquet(*glob.glob(f"{path}/round=*")).collect()]
    assert len(written) == len(set(written)) == 11


def test_callers_come_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(callgraph, "CHUNK", 10)
    calls = spark.range(95).select(F.lit("hub").alias("name"), F.format_string("c%03d", F.col("id") % 45).alias("containing_function"), F.array().cast("array<struct<name:string,info:string>>").alias("args"))
    none = spark.createDataFrame([], "name string, hasbody boolean")
    rows = callgraph.function_index(none, calls, none)["callers"].orderBy("chunk").collect()
    assert [r["chunk"] for r in rows] == [0, 1, 2, 3, 4] and [x for r in rows for x in r["callers"]] == [f"c{i:03d}" for i in range(45)] and max(len(r["callers"]) for r in rows) == 10


def test_free_ranges_equal_draws_by_hand(spark):
    """Extra DUAs are drawn from the active older ones in the order of their interval's size, start and number; what is dead, taken or newer is never used."""
    rng = random.Random(21)
    lives = []
    for i in range(120):
        size, start = rng.randint(3, 9), i * 3 + rng.randrange(3)
        labels = [None if rng.random() < 0.1 else rng.sample(range(400), 2) for _ in range(size)]
        lives.append(("t", i, start, None if rng.random() < 0.3 else start + rng.randrange(1, 200), labels, [None if rng.random() < 0.5 else start + rng.randrange(250) for _ in range(size)]))
    bugs = [(b, "t", p := rng.randrange(400), rng.randrange(p + 1), rng.sample(range(400), 8), rng.random() < 0.3) for b in range(150)]
    last, expected = max(b[2] for b in bugs), {}
    for bug, _, p, before, labels, _ in bugs:
        active = []
        for _, i, start, end, byte_labels, deaths in lives:
            high = last if end is None else min(end - 1, last)
            if start < before and start <= p <= high:
                level = max(k for k in range(12) if p >> k << k >= start and ((p >> k) + 1 << k) - 1 <= high)
                active.append((level, start, i, byte_labels, deaths))
        active.sort(key=lambda a: a[:3])
        known, got = set(labels), []
        for i in range(2):
            for k in range(2):
                if len(active) <= 2:
                    break
                _, _, dua, byte_labels, deaths = active[int(hashlib.md5(f"5:{i}:{bug}:{k}".encode()).hexdigest()[:13], 16) % len(active)]
                ok = [b is not None and (d is None or d > p) and not set(b) & known for b, d in zip(byte_labels, deaths, strict=True)]
                low = next((x for x in range(len(ok) - 3) if all(ok[x : x + 4])), None)
                if low is not None:
                    got.append((dua, low))
                    known |= {x for b in byte_labels[low : low + 4] for x in b}
                    break
            if len(got) <= i:
                break
        if len(got) == 2:
            expected[bug] = got
    rows = spark.createDataFrame(lives, "trace_id string, dua long, start long, end long, labels array<array<int>>, deaths array<long>")
    found = generation.pick_free_ranges(spark.createDataFrame(bugs, "bug long, trace_id string, probe_seq long, start long, labels array<int>, fake_dua boolean"), rows, 2, seed=5)
    assert {r["bug"]: list(zip(r["extra_duas"], r["extra_lows"], strict=True)) for r in found.collect()} == expected and len(expected) > 10


def test_lifetimes_of_long_files(spark):
    """seq of a large log's later splits is far above the number of its entries."""
    far = 1 << 60
    probes = spark.createDataFrame([("t", 5), ("t", far), ("t", far + 7)], "trace_id string, probe_seq long")
    alive = spark.createDataFrame([("t", 1, 0, far + 7), ("t", 2, 5, None), ("t", 3, far, far + 1)], "trace_id string, dua long, start long, end long")
    assert sorted((r["probe_seq"], r["dua"]) for r in mining.active_duas(probes, alive).collect()) == [(5, 1), (5, 2), (far, 1), (far, 2), (far, 3), (far + 7, 2)]


def test_drawn_duas(spark):
    """Sampled DUAs are eligible and different, all if they are few; and each is drawn about as often."""
    duas = spark.createDataFrame([(f, d, r) for f in "ab" for d, r in ((1, 10), (2, 10), (3, 20), (4, 40))], "inputfile string, dua long, ready long")
    execs = spark.createDataFrame([(f, f"p{i}", at) for f in "ab" for i in range(200) for at in (10, 11, 30, 99)], "inputfile string, atp string, instr long")
    found = {}
    for r in generation.chaff_sampled_bugs(execs, duas, kinds=(6,)).collect():
        found.setdefault((r["inputfile"], r["atp"], r["instr"]), []).append(r["dua"])
    assert {k[2] for k in found} == {11, 30, 99} and len(found) == 1200
    assert all(len(set(v)) == 2 and set(v) <= ({1, 2} if k[2] == 11 else {1, 2, 3} if k[2] == 30 else {1, 2, 3, 4}) for k, v in found.items())
    times = Counter(d for k, v in found.items() for d in v if k[2] == 99)
    assert all(150 < times[d] < 250 for d in (1, 2, 3, 4))


def test_what_is_no_dua_replaces_none(spark):
    """A query with a gap, or with three labels only, leaves the live DUA of its lvalue alone; a fake one replaces it and is only replaced itself."""
    whole = [[1], [2], [3], [4]]
    events = [("t", 0, "v", whole, False), ("t", 1, "v", [[1], None, [2], [3]], False), ("t", 2, "v", [[1], [1], [2], [3]], False), ("t", 3, "w", whole, True), ("t", 4, None, [[1]], False), ("t", 5, None, [[1]], False), ("t", 6, "w", [[5], [6], [7], [8]], False)]
    rows = spark.createDataFrame(events, "trace_id string, seq long, lval string, labels array<array<int>>, fake boolean")
    found = {(r["lval"], r["seq"]): (r["end"], r["reason"]) for r in mining.replay_exact(rows, 1).collect()}
    assert found == {("v", 0): (5, "died"), ("w", 3): (6, "replaced"), ("w", 6): (None, "alive")}


def test_ranges_of_bugs(spark):
    """Longest runs give triggers and pads; with first, the first run that is long enough gives the pad."""
    bytes_of = lambda text: [None if c == "." else [i % 5, 9] for i, c in enumerate(text)]
    duas = spark.createDataFrame([(1, "in", 5, bytes_of("x.xxxxx.")), (2, "in", 6, bytes_of("xxxxxxxx.xxxxxxxxx")), (3, "in", 7, bytes_of("xx.xx"))], "dua long, inputfile string, instr long, byte_labels array<array<int>>")
    ready = generation.dua_readiness(generation.byte_ranges(duas, pad=8), spark.createDataFrame([("in", 1, 9)], "inputfile string, label int, death_instr long"))
    assert {r["dua"]: (r["run_low"], r["run"], r["ready"], r["low"], r["high"], r["pad_low"]) for r in ready.collect()} == {1: (2, 5, 9, 2, 6, None), 2: (9, 9, 9, 9, 13, 9), 3: (0, 2, 9, None, None, None)}
    assert {r["dua"]: r["trigger_labels"] for r in ready.collect()} == {1: [0, 2, 3, 4, 9], 2: [0, 1, 2, 4, 9], 3: None}
    assert generation.byte_ranges(duas, pad=8, first=True).where("dua = 2").select("pad_low", "pad_high").first() == (0, 8)
    bugs = spark.createDataFrame([(1, 2), (3, 2), (2, 1)], "dua long, pad long")
    assert {(r["dua"], r["low"], r["pad_low"]) for r in generation.with_ranges(bugs, ready, pads=True).collect()} == {(1, 2, 9), (2, 9, None)}


@pytest.mark.parametrize("first", [1, 2, 64])
def test_pads_equal_nested_loops(spark, first):
    """Triggers that share labels with the pad make executions look further back."""
    rng = random.Random(6)
    duas = [(i, f"in{rng.randrange(2)}", rng.randrange(4), rng.randrange(90), rng.sample(range(8), 2)) for i in range(160)]
    duas = [(*d, max(d[3], rng.randrange(100))) for d in duas]
    pads = sorted({(f"in{rng.randrange(2)}", f"a{rng.randrange(3)}", rng.randrange(110), rng.randrange(160)) for _ in range(40)})
    labels = {d[0]: d[4] for d in duas}
    expected = {}
    for f, a, at, pad in sorted(pads, key=lambda p: p[2]):
        for lval in range(4):
            fit = [(-d[3], -d[0], d[0]) for d in duas if d[1] == f and d[2] == lval and d[5] < at and d[0] != pad and not set(d[4]) & set(labels[pad])]
            if fit:
                best = (at, *min(fit), pad)
                expected[f, a, lval] = min(expected.get((f, a, lval), best), best)
    own = spark.createDataFrame(duas, "dua long, inputfile string, lval long, instr long, labels array<int>, ready long")
    asked = spark.createDataFrame([(*p, labels[p[3]]) for p in pads], "inputfile string, atp string, instr long, pad long, pad_labels array<int>")
    found = {(r["inputfile"], r["atp"], r["lval"]): (r["instr"], r["dua"], r["pad"]) for r in generation._with_pads(asked, own, first).collect()}
    assert found == {k: (v[0], v[3], v[4]) for k, v in expected.items()} and len(found) > 15


def test_pads_form_few_rows(spark):
    """Rows that executions look at are executions times lvalues, not times DUAs, where labels do not conflict; and a hot file spreads over ranges."""
    duas = spark.range(6000).select(F.col("id").alias("dua"), F.lit("in").alias("inputfile"), (F.col("id") % 3).alias("lval"), F.col("id").alias("instr"), F.array((F.col("id") % 50 + 100).cast("int")).alias("labels"), F.col("id").alias("ready"))
    pads = spark.range(200).select(F.lit("in").alias("inputfile"), F.concat(F.lit("a"), F.col("id")).alias("atp"), (F.col("id") * 29 + 50).alias("instr"), F.lit(0).cast("long").alias("pad"), F.array(F.lit(1)).alias("pad_labels"))
    counted = []
    real = generation.disjoint
    try:
        seen = spark.sparkContext.accumulator(0)
        count = F.udf(lambda x: seen.add(1) or x, "boolean")
        generation.disjoint = lambda a, b: count(real(a, b))
        counted.append(generation._with_pads(pads, duas).count())
    finally:
        generation.disjoint = real
    assert counted == [600] and seen.value <= 200 * 3 * 2 * 2  # twice, should a round be evaluated again
    marked = duas.select("inputfile", F.col("ready").alias("at"), F.struct("instr", "dua").alias("own"))
    parts = [r["n"] for r in ordered.placed(marked, ["inputfile"], "at").groupBy("__part").agg(F.count("*").alias("n")).collect()]
    assert max(parts) < 6000 // 3
    newest = ordered.greatest_before(marked, ["inputfile"], "at", "own", "newest").where("at = 5000").first()["newest"]
    assert (newest["instr"], newest["dua"]) == (4999, 4999)


def test_extremes_before_and_after(spark):
    """Rows that tie in order do not count for each other; keys may be null; rows come over several ranges."""
    rng = random.Random(8)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), rng.randrange(200), rng.choice([None, *range(50)])) for _ in range(700)]
    df = spark.createDataFrame(rows, "k string, at long, v long").repartition(4)
    out = ordered.least_after(ordered.greatest_before(df, ["k"], "at", "v", "before"), ["k"], "at", "v", "after").collect()
    pick = lambda f, xs: f([x for x in xs if x is not None], default=None)
    assert len(out) == 700
    for r in out:
        own = [x for x in rows if x[0] == r["k"]]
        assert r["before"] == pick(max, [x[2] for x in own if x[1] < r["at"]]) and r["after"] == pick(min, [x[2] for x in own if x[1] > r["at"]])


@pytest.mark.parametrize("strict", [False, True])
def test_staircases_equal_all_windows(spark, strict):
    """The step a probe meets is the first window alive there and free of the excluded labels."""
    rng = random.Random(2)
    lives = []
    for i in range(60):
        size, start = rng.randint(1, 9), rng.randrange(40)
        labels = [None if rng.random() < 0.1 else rng.sample(range(40), 2) for _ in range(size)]
        lives.append(("t", f"v{i % 7}", i, start, None if rng.random() < 0.3 else start + rng.randrange(60), labels, [None if rng.random() < 0.3 else rng.randrange(100) for _ in range(size)]))
    probes = [("t", p, f"a{p}") for p in range(0, 110, 3)]
    expected = set()
    for _, p, a in probes:
        for _, lval, i, start, end, labels, deaths in lives:
            ok = [b is not None and not {3, 4} & set(b) and (d is None or d > p) for b, d in zip(labels, deaths, strict=True)]
            low = next((k for k in range(len(ok) - 3) if all(ok[k : k + 4])), None)
            if (start < p if strict else start <= p) and (end is None or p < end) and low is not None:
                expected.add((p, a, lval, i, low, low + 4))
    df = spark.createDataFrame(lives, "trace_id string, lval string, dua long, start long, end long, labels array<array<int>>, deaths array<long>")
    found = generation.online_bugs(spark.createDataFrame(probes, "trace_id string, probe_seq long, atp string"), df, [3, 4], strict=strict)
    rows = [tuple(r) for r in found.select("probe_seq", "atp", "lval", "dua", "low", "high").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == expected and len(expected) > 60


def test_offline_bugs_equal_nested_loops(spark):
    rng = random.Random(3)
    duas = [(i, f"in{rng.randrange(3)}", rng.randrange(6), rng.randrange(60), [1], 0) for i in range(80)]
    duas = [(*d[:5], max(d[3], rng.randrange(70))) for d in duas]
    execs = sorted({(f"in{rng.randrange(3)}", f"a{rng.randrange(4)}", rng.randrange(80)) for _ in range(60)})
    expected = {}
    for f, a, i in sorted(execs, key=lambda e: e[2]):
        for lval in range(6):
            fit = [(d[3], d[0]) for d in duas if d[1] == f and d[2] == lval and d[5] < i]
            if fit and (f, a, lval) not in expected:
                expected[f, a, lval] = (i, max(fit)[1])
    found = generation.offline_bugs(spark.createDataFrame(execs, "inputfile string, atp string, instr long"), spark.createDataFrame(duas, "dua long, inputfile string, lval long, instr long, labels array<int>, ready long"))
    assert {(r["inputfile"], r["atp"], r["lval"]): (r["instr"], r["dua"]) for r in found.collect()} == expected


def test_reuse_equals_greedy(spark):
    rng = random.Random(5)
    bugs = [(f"f{rng.randrange(3)}", rng.randrange(4), rng.randrange(9), i) for i in range(150)]
    first, used, kept = {}, set(), set()
    for f, line, kind, pos in bugs:
        structural = kind in selection.STRUCTURAL
        if first.setdefault((f, line), structural) != structural:
            continue
        if kind not in selection.UNLIMITED:
            if (f, line, kind) in used:
                continue
            used.add((f, line, kind))
        kept.add(pos)
    assert {r["pos"] for r in selection.limit_atp_reuse(spark.createDataFrame(bugs, "file string, line int, kind int, pos int")).collect()} == kept


def test_runs_do_not_depend_on_partitioning(spark):
    bugs = spark.range(500).select(F.col("id").alias("bug"), (F.col("id") % 9).cast("int").alias("kind"))
    pick = lambda df: sorted(r["bug"] for r in selection.sample_balanced(df, 40, [0, 1, 2]).collect())
    assert pick(bugs) == pick(bugs.repartition(5)) and len(pick(bugs)) == 39


def test_rel_write_values_solve_the_trigger(spark):
    magics = [3, 0x41424344, 0x7A7A7A7B, 0xFFFFFFFF, 5, 2**31, 0, 1, 2]
    rows = spark.createDataFrame([(m,) for m in magics], "magic long")
    for magic, a, b, c in rows.select("magic", *scoring.rel_write_values("magic")).collect():
        value = [(a + b) * c, a * b - c, (a + 2) * (b + 1) * (c + 3)][magic % 3]
        assert value % 2**32 == magic


def mutated_by_hand(jobs, knob):
    out = {}
    for bug, kind, magic, lists, content, solution in jobs:
        raw = bytearray(content)
        if kind == scoring.REL_WRITE:
            values = solution or [[magic, 0, 1], [magic, 1, 0], [(magic * pow(9, -1, 1 << 32) - 2) % (1 << 32), 8, (1 << 32) - 2]][magic % 3]
        else:
            values = [magic if knob is None else knob << 16 | magic & 0xFFFF, *[magic] * len(lists)]
        for labels, value in zip(lists, values, strict=False):
            for at, byte in zip(labels[:4], (value & 0xFFFFFFFF).to_bytes(4, "little"), strict=False):
                if 0 <= at < len(raw):
                    raw[at] = byte
        out[bug] = bytes(raw)
    return out


@pytest.mark.parametrize("knob", [None, 7])
def test_mutation(spark, knob):
    """Runs that touch, overlap, come backwards or leave the input; empty inputs and lists."""
    rng = random.Random(4)
    jobs = [(1, 0, 0x44434241, [[1, 2, 3, 4]], b"0123456789", None), (2, 0, 0x44434241, [[8, 9, 10, 11]], b"0123456789", None), (3, 2, 0x44434241, [[0, 1, 2, 3], [4, 5, 6, 7], [2, 3, 9, 9]], b"0123456789", [1, 2, 1 << 31])]
    jobs += [(i, rng.randrange(4), rng.randrange(1 << 32), [[rng.randrange(40) for _ in range(rng.randrange(7))] for _ in range(rng.randrange(4))], bytes(rng.randrange(256) for _ in range(rng.randrange(45))), None) for i in range(4, 120)]
    df = spark.createDataFrame([(*j[:4], "a", *j[4:]) for j in jobs], "bug long, kind int, magic long, lists array<array<int>>, name string, content binary, solution array<long>")
    assert {r["bug"]: bytes(r["content"]) for r in scoring.mutate_inputs(df, knob).collect()} == mutated_by_hand(jobs, knob)
    if knob is None:
        assert {r["bug"]: bytes(r["content"]) for r in scoring.mutate_inputs(df.where("bug < 3").drop("solution")).collect()} == {1: b"0ABCD56789", 2: b"01234567AB"}
    assert scoring.mutate_inputs(df.limit(1).withColumn("content", F.lit(None).cast("binary")), knob).first()["content"] is None


def test_scalars(spark):
    df = spark.createDataFrame([("0x1F", "a.h", "12:3:4:5:x:y.c"), ("017", "h", "1:2:3"), ("-9", "a.c", None), ("18446744073709551615", "", "a:b:c:d:e"), ("zz", None, "")], "n string, f string, l string")
    rows = df.select(S.parse_c_int("n").alias("n"), S.is_header_file("f").alias("h"), S.parse_ast_loc("l").alias("l")).collect()
    assert [r["n"] for r in rows] == [31, 15, -9, -1, None] and [r["h"] for r in rows] == [True, True, False, True, None]
    assert rows[0]["l"]["filename"] == "x:y.c" and [r["l"] for r in rows[1:]] == [None] * 4
    with pytest.raises(Exception, match="no location"):
        df.select(S.parse_ast_loc("l", strict=True)).collect()


@pytest.mark.parametrize("what", ["liveness", "counters", "state"])
def test_streams(spark, tmp_path, what):
    rng = random.Random(9)
    events = random_events(rng, 3, 25)
    for i in range(0, len(events), 25):
        spark.createDataFrame(events[i : i + 25], EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    if what == "state":
        out, mode = streams.stream_dua_state(source, 3), "append"
    elif what == "counters":
        out, mode = streams.stream_counters(source.withColumn("kind", F.when(F.col("lval").isNull(), "branch").otherwise("query"))), "complete"
    else:
        out, mode = streams.stream_liveness(source.where("lval IS NULL").select(F.col("trace_id").alias("inputfile"), F.explode(F.flatten("labels")).alias("label"))), "complete"
    for k, v in streams.STATE_STORE.items():
        spark.conf.set(k, v)
    query = out.writeStream.outputMode(mode).format("memory").queryName(f"out_{what}").option("checkpointLocation", str(tmp_path / "ck")).start()
    query.processAllAvailable()
    query.stop()
    for k in streams.STATE_STORE:
        spark.conf.unset(k)
    rows = spark.sql(f"SELECT * FROM out_{what}").collect()
    if what == "state":
        exact = mining.replay_exact(spark.createDataFrame(events, EVENTS), 3, erase_siblings=False).collect()
        assert {(r["trace_id"], r["lval"], r["seq"]) for r in rows if r["what"] == "born"} == {(r["trace_id"], r["lval"], r["seq"]) for r in exact}
        assert {(r["trace_id"], r["lval"], r["seq"]) for r in rows if r["what"] == "died"} == {(r["trace_id"], r["lval"], r["end"]) for r in exact if r["reason"] == "died"}
    elif what == "counters":
        assert {r["kind"]: r["n"] for r in rows} == {"branch": sum(e[2] is None for e in events), "query": sum(e[2] is not None for e in events)}
    else:
        assert sum(r["death_instr"] for r in rows) == sum(len(e[3][0]) for e in events if e[2] is None)


def test_state_of_a_trace_outlives_batches(spark, tmp_path):
    """A trace comes in many batches, with fake and nodua DUAs; entries that come after later ones are reported, and change nothing."""
    events = mixed_events(random.Random(11), 2, 120, groups=2)
    late = [("t0", 40, None, [list(range(20))], None, None, None), ("t1", 0, "v0.0", [[1], [2], [3], [4]], None, None, None)]
    for i, part in enumerate([[e for e in events if e[1] // 30 == k] for k in range(4)]):
        spark.createDataFrame(part + (late if i == 2 else []), MIXED).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(MIXED).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for k, v in streams.STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        query = streams.stream_dua_state(source, 8).writeStream.outputMode("append").format("memory").queryName("out_batches").option("checkpointLocation", str(tmp_path / "ck")).start()
        query.processAllAvailable()
        query.stop()
    finally:
        for k in streams.STATE_STORE:
            spark.conf.unset(k)
    rows = [tuple(r) for r in spark.sql("SELECT trace_id, lval, seq, since, what FROM out_batches").collect()]
    assert {r for r in rows if r[4] == "late"} == {("t0", None, 40, None, "late"), ("t1", "v0.0", 0, None, "late")}
    exact = whole_replay(events, 8, False)
    assert {(t, v, s) for t, v, s, _, what in rows if what == "born"} == {r[:3] for r in exact}
    assert {(t, v, since, s, what) for t, v, s, since, what in rows if what in ("died", "replaced")} == {r for r in exact if r[4] != "alive"}


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_duckdb(spark, name):
    db = duckdb.connect()
    for f in os.listdir(SF):
        db.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    rel = db.sql(registry.oracle_sql()[name])
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    assert sorted(rel.columns) == columns
    plain = lambda v: round(float(v), 6) if isinstance(v, float) else v
    at = [rel.columns.index(c) for c in columns]
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str) == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=str)
