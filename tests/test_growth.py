"""Work that must not grow faster than the input."""

import random
import sys
import time

import numpy as np
from pyspark.sql import functions as F

from tracemine.llm import alignment, common, neargroups, simhash, urlfilter
from tracemine.operators import callgraph, cleaning, generation, mining, placement, replay
from tracemine.plans import adapters, registry


def test_pads_look_at_the_first_executions(spark, monkeypatch):
    """Where the first executions have a trigger, the later ones are not paired with lvalues."""
    duas = spark.range(300).select(F.col("id").alias("dua"), F.lit("in").alias("inputfile"), (F.col("id") % 3).alias("lval"), F.col("id").alias("instr"), F.array(F.lit(7)).alias("labels"), F.col("id").alias("ready"))
    pads = spark.range(500).select(F.lit("in").alias("inputfile"), F.lit("a").alias("atp"), (F.col("id") + 10).alias("instr"), F.lit(0).cast("long").alias("pad"), F.array(F.lit(1)).alias("pad_labels"))
    seen, real = [], generation._looked_back
    monkeypatch.setattr(generation, "_looked_back", lambda pairs, *a: seen.append(pairs.count()) or real(pairs, *a))
    assert {(r["lval"], r["instr"], r["dua"]) for r in generation._with_pads(pads, duas).collect()} == {(0, 10, 9), (1, 10, 7), (2, 10, 8)}
    assert sum(seen) == 12
    assert generation._with_pads(pads.limit(0), duas).count() == 0


def test_scopes_look_up_a_place_once(spark, monkeypatch):
    duas = spark.range(100).select(F.col("id").alias("dua"), F.lit("f").alias("file"), (F.col("id") % 2 * 50 + 5).alias("line"), F.lit(1).alias("column"))
    bodies = spark.createDataFrame([("f", "g", 1, 1, 9, 1)], "file string, function string, begin_line int, begin_column int, end_line int, end_column int")
    seen, real = [], cleaning.active_duas
    monkeypatch.setattr(cleaning, "active_duas", lambda probes, spans: seen.append(probes.count()) or real(probes, spans))
    assert {r["dua"] for r in cleaning.dua_scope_join(duas, bodies).collect()} == set(range(0, 100, 2)) and seen == [2]


def test_replay_does_not_take_a_shard_at_once(spark):
    events = spark.createDataFrame([("t", 0, "v", [[1], [2], [3], [4]]), ("t", 1, None, [[1, 2, 3, 4]]), ("t", 2, None, [[1, 2, 3, 4]])], "trace_id string, seq long, lval string, labels array<array<int>>")
    found = mining.replay_exact(events, 1)
    assert [tuple(r) for r in found.collect()] == [("t", "v", 0, 2, "died")]
    assert "FlatMapGroups" not in found._jdf.queryExecution().toString()
    assert mining.replay_exact(events.limit(0), 1).count() == 0


def test_lines_nearest_of_many(spark, monkeypatch):
    rng = random.Random(3)
    bugs = [(i, "f", rng.choice([None, *range(40)]), rng.choice([None, 1, 2, 17])) for i in range(60)]
    lines = [("f", rng.randrange(40), f"x (0x{rng.choice(['1', '2', '11', '3'])} y") for _ in range(25)]
    expected = {}
    for bug, _, line, magic in bugs:
        at = [n for _, n, text in lines if magic is not None and f"(0x{magic:x}" in text]
        expected[bug] = min(at, key=lambda n: (0 if line is None else abs(n - line), n), default=None)
    calls, real = [], placement.greatest_before
    monkeypatch.setattr(placement, "greatest_before", lambda *a: calls.append(1) or real(*a))
    found = placement.locate_trigger_line(spark.createDataFrame(bugs, "bug long, file string, line int, magic long"), spark.createDataFrame(lines, "file string, line int, text string"))
    assert {r["bug"]: r["found_line"] for r in found.collect()} == expected and calls


def test_call_traces_without_stacks(spark):
    rng = random.Random(4)
    calls = spark.createDataFrame([(f"t{t}", seq, rng.random() < 0.5, f"fn{rng.randrange(60)}", "f") for t in range(3) for seq in range(60)], "trace_id string, seq long, is_call boolean, callee string, callee_file string")
    probes = calls.where("seq % 7 = 0").select("trace_id", "seq")
    own = lambda df: {(r["caller"], r["file"], r["call_trace_key"]) for r in df.collect()}
    assert own(replay.call_traces_at(probes, calls)) == own(replay.call_traces(replay.call_stack_at(probes, calls))) != set()


def test_closure_keeps_edges_that_matter(spark, monkeypatch):
    judgement = spark.createDataFrame([("a", 3), ("b", 0), ("c", 0), ("d", 3)], "name string, flag int")
    calls = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "a"), ("c", "far"), ("b", "further")], "name string, containing_function string")
    seen, real = [], callgraph.written
    monkeypatch.setattr(callgraph, "written", lambda df: seen.append(real(df)) or seen[-1])
    assert {(r["name"], r["flag"]) for r in callgraph.close_over_callers(judgement, calls).collect()} == {(n, 3) for n in "abcd"}
    assert seen[-1].count() == 2


def test_rounds_of_url_scores_do_not_double_plans(spark, monkeypatch):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("c", "a", 1.0)], "src string, dst string, weight double")
    seen, real = [], urlfilter.cut
    monkeypatch.setattr(urlfilter, "cut", lambda df: seen.append(df._jdf.queryExecution().logical().toString().count("Join")) or real(df))
    scores = urlfilter.propagated(edges, spark.createDataFrame([("a", 1.0, 0.0)], "host string, good double, bad double"))
    assert scores.agg(F.sum("trust")).first()[0] > 6.6 and max(seen) <= urlfilter.CUT_EVERY


def test_deep_stacks_are_not_gathered(spark):
    """A trace whose stack only gets deeper: frames of all stacks are a hundred times its entries, so none is put together from rows of frames."""
    n = 400
    calls = spark.range(n).select(F.lit("t").alias("trace_id"), F.col("id").alias("seq"), (F.col("id") % 5 < 4).alias("is_call"), F.concat(F.lit("f"), F.col("id") % 7).alias("callee"), F.lit("x").alias("callee_file"))
    found = replay.call_stack_at(calls.select("trace_id", "seq"), calls)
    assert "collect_list" not in found._jdf.queryExecution().toString()
    stack, expected = [], {}
    for seq in range(n):
        if seq % 5 == 4:
            stack.pop()
        expected[seq] = list(stack)
        if seq % 5 < 4:
            stack.append(f"f{seq % 7}")
    assert {r["seq"]: [f["function"] for f in r["stack"]] for r in found.collect()} == expected and sum(map(len, expected.values())) > 40_000


def test_stacks_at_any_probe(spark):
    rng = random.Random(5)
    entries = {t: sorted(rng.sample(range(300), 120)) for t in ("a", "b", "c")}
    calls = [(t, s, rng.random() < p, rng.choice(["f", "g", None]), f"x{s % 3}") for (t, seqs), p in zip(entries.items(), (0.8, 0.5, 0.3), strict=True) for s in seqs]
    probes = [(t, s) for t in ("a", "b", "c", "none", None) for s in [*rng.sample(range(310), 150), 5, 5, None]]
    expected = {}
    for t, s in probes:
        stack = []
        for trace, at, is_call, name, file in calls:
            if trace == t and s is not None and (at < s or at == s and not is_call):
                stack = [*stack, (name, file)] if is_call else stack[:-1]
        expected[t, s] = stack
    known = spark.createDataFrame([*calls, (None, 1, True, "f", "x"), ("a", None, True, "f", "x")], "trace_id string, seq long, is_call boolean, callee string, callee_file string")
    asked = spark.createDataFrame(probes, "trace_id string, seq long")
    found = replay.call_stack_at(asked, known).collect()
    assert {(r["trace_id"], r["seq"]): [tuple(f) for f in r["stack"]] for r in found} == expected and len(found) == len(expected)
    assert replay.call_stack_at(asked.limit(0), known).count() == 0
    assert all(r["stack"] == [] for r in replay.call_stack_at(asked, known.limit(0)).collect())


def test_tasks_follow_the_rows_of_orders(spark, monkeypatch):
    """Bytes of a larger table are dealt to more tasks than the session's, so a task's rows stay as many; d1 looks at its elements once."""
    sf = "/root/testdata/sf0.001"
    found = {}
    for most in (10**9, 100):
        monkeypatch.setattr(adapters, "ROWS_OF_TASK", most)
        found[most] = registry.queries()["d1_query_bytes"](spark, sf)
    plans = [d._jdf.queryExecution().optimizedPlan().toString() for d in found.values()]
    assert "RepartitionByExpression" not in plans[0] and "RepartitionByExpression" in plans[1] and plans[0].count("Join") == 5
    tasks = -(-spark.read.parquet(f"{sf}/lineitem.parquet").count() // 100)
    assert adapters.view(spark, sf, "fx_bytes").rdd.getNumPartitions() == tasks > 8
    assert sorted(map(tuple, found[100].collect())) == sorted(map(tuple, found[10**9].collect())) != []


def test_fake_duas_take_as_many_tasks_as_rows_ask_for(spark, monkeypatch):
    monkeypatch.setattr(adapters, "ROWS_OF_TASK", 100)
    found = registry.queries()["d4_fake_duas"](spark, "/root/testdata/sf0.001")
    assert "RepartitionByExpression" in found._jdf.queryExecution().optimizedPlan().toString() and found.rdd.getNumPartitions() > 8 and found.count() > 0


def test_near_dedup_reads_texts_of_likely_candidates_only(spark, monkeypatch):
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcdefghij") + str(rng.randrange(90)) for _ in range(60)) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate([*texts, texts[0] + " more", texts[1] + " more"])), "doc_id long, text string")
    seen, real = [], neargroups._texts
    monkeypatch.setattr(neargroups, "_texts", lambda rows, wanted: seen.append(wanted.count()) or real(rows, wanted))
    assert {r["doc_id"] for r in simhash.near_dedup(docs).collect()} == set(range(300)) and max(seen) < 20


def test_units_are_aligned_together():
    """Calls in Python do not grow with the units that are new; results do not depend on which units come together, or on those whose bytes are not their tokens'."""
    both, rng = alignment.Tokenizers(), random.Random(7)
    both.bytes_a[both.a.encode(" q", add_special_tokens=False).ids[-1]] = b"??"  # units of this token are not their tokens' bytes
    units = sorted({"".join(rng.choice("abq é漢\U0001f600\t<>'1") for _ in range(rng.randrange(1, 12))) for _ in range(500)})
    calls = []
    sys.setprofile(lambda frame, event, arg: calls.append(frame.f_code.co_name) if event == "call" and frame.f_code.co_filename == alignment.__file__ and frame.f_code.co_name[0] != "<" else None)
    try:
        found = both.encode(units)
    finally:
        sys.setprofile(None)
    assert len(calls) < 50
    sizes, said, links = found
    assert 0 < sizes[:, 0].sum() < len(units)
    both._forget()
    one = [both.encode([u]) for u in reversed(units)][::-1]
    assert [x[1][0] for x in one] == said and [x[0][0].tolist() for x in one] == sizes.tolist() and np.concatenate([x[2] for x in one]).tolist() == links.tolist()
    assert [s.count("|") for s in said] == sizes[:, 3].tolist() and all(not s for s, good in zip(said, sizes[:, 0], strict=True) if not good)


def test_few_texts_are_moved(spark):
    docs = spark.range(5000).select(F.when(F.col("id") > 0, F.col("id")).alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    wanted = docs.where("doc_id IS NULL OR doc_id % 250 = 0").select(F.coalesce("doc_id", F.lit(-1)).alias("node"), F.col("doc_id").alias("id"))
    likely = {r["doc_id"] for r in neargroups.likely(docs, wanted.select(F.col("id").alias("__id"))).collect()}
    assert likely >= {None, *range(250, 5000, 250)} and len(likely) < 60
    found = neargroups._texts(docs, docs.select("text").mapInArrow(neargroups._words, "digest binary, words binary").join(wanted.withColumn("words", F.concat(F.lit("text "), F.coalesce("id", F.lit(0))).cast("binary")), "words").select("node", "digest", "id"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.index("<=>") < plan.index("__map")  # the maps are looked at before texts are dealt by doc_id
    assert {(r["node"], bytes(r["words"])) for r in found.collect()} == {(-1, b"text 0"), *((i, b"text %d" % i) for i in range(250, 5000, 250))}
    buckets = spark.createDataFrame([(1, 0, 10, 0, 2), (1, 0, 11, 0, 2)], "key long, band long, node long, salt int, n long")
    labels, nodes = spark.createDataFrame([], "node long, component long"), spark.createDataFrame([(10, 5, bytes(32)), (11, 5, bytes(32))], "node long, n_shingles long, signature binary")
    assert neargroups.proposals(buckets, labels, nodes, 80, 4, simhash.WideRing(10)).count() == 0


def test_fake_duas_look_at_the_bytes_once(spark):
    found = registry.queries()["d4_fake_duas"](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == adapters.view(spark, "/root/testdata/sf0.001", "fx_bytes")._jdf.queryExecution().optimizedPlan().toString().count("Window") and "LeftSemi" not in plan
    elements = spark.createDataFrame([("t", q, i, i + (q + i) % 3, 8, q % 6, q % 4 == 0) for q in range(40) for i in range(8)], "trace_id string, seq long, pos int, offset int, len int, num_tainted int, real boolean")
    queries = elements.select("trace_id", "seq", "len", "num_tainted", "real").distinct()
    own = lambda df: {(r["seq"], tuple(r["bytes"])) for r in df.collect()}
    assert own(mining.fake_duas(elements)) == own(mining.fake_duas(elements.select("trace_id", "seq", "pos", "offset"), queries)) != set()


def test_tables_written_leave_no_shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    left = lambda: {x for x in (str(f) for f in disk.getAllFiles().mkString("\n").split("\n")) if x.endswith(".data")}
    before, setting = left(), spark.conf.get(common.CLEANUP)
    counts = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().repartition(5, "k")
    for kept in (common.cut(counts), common.written(counts)):
        assert sorted(r["count"] for r in kept.collect()) == [142] + [143] * 6
    deadline = time.monotonic() + 20
    while (more := left() - before) and time.monotonic() < deadline:
        time.sleep(0.2)
    assert not more and spark.conf.get(common.CLEANUP) == setting


def test_few_edges_leave_few_tasks(spark):
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        found = common.components(spark.range(300).where("id % 100 > 0").select(F.col("id").alias("u"), (F.col("id") - 1).alias("v")))
        tasks = found.rdd.getNumPartitions()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert tasks == common.LEAST_TASKS and {(r["node"], r["component"]) for r in found.collect()} == {(i, i // 100 * 100) for i in range(300) if i % 100}


def test_rows_that_spark_sizes_too_low_are_not_broadcast(spark, monkeypatch):
    """Each node has a hundred keys in its buckets, and may have many salts as an end of edges; Spark sizes both by the nodes."""
    nodes = spark.range(300).select(F.col("id").alias("node"), F.unhex(F.sha2((F.col("id") % 200).cast("string"), 256)).alias("signature"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    buckets = neargroups.buckets_of(nodes, simhash.WideRing())
    assert "BroadcastHashJoin" not in plan(buckets) and buckets.select("node").distinct().count() >= 200
    assert "SortMergeJoin [key" in plan(neargroups.stars(spark.createDataFrame(buckets.collect(), buckets.schema)))
    edges = spark.range(1, 60).select((F.col("id") % 7).alias("u"), F.col("id").alias("v"))
    seen, real = [], common.cut
    monkeypatch.setattr(common, "cut", lambda df: seen.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df))
    expected = sorted(map(tuple, common.components(edges).collect()))
    assert expected == [(v, v % 7) for v in range(7, 60)] and not any("strategy=merge" in p for p in seen)
    seen.clear()
    monkeypatch.setattr(common, "EDGES_OF_TASK", 10)
    assert sorted(map(tuple, common.components(edges).collect())) == expected and all("strategy=merge" in p for p in seen[1:])


def test_exploded_pairs_are_not_broadcast(spark, monkeypatch):
    """Pairs, and the DUAs that each looks back at, are many times the rows that Spark sizes them by; they do not go through the driver."""
    labels = F.array((F.col("id") % 5).cast("int"))
    duas = spark.range(400).select(F.col("id").alias("dua"), F.lit("in").alias("inputfile"), (F.col("id") % 3).alias("lval"), F.lit("f").alias("loc"), F.col("id").alias("instr"), F.when(F.col("id") % 40 < 2, F.col("id")).otherwise(1000).alias("ready"), (F.col("id") % 30).alias("run"), labels.alias("labels"))
    execs = duas.select("inputfile", F.lit("a").alias("atp"), "loc", "instr")
    rows = duas.collect()
    eligible = lambda lval, at, pad: [d["dua"] for d in rows if d["lval"] == lval and d["ready"] < at and d["dua"] != pad and d["labels"] != rows[pad]["labels"]]
    expected = {}
    for lval in range(3):
        expected[lval] = next((at, max(eligible(lval, at, at)), at) for at in range(400) if at % 30 >= 20 and eligible(lval, at, at))
    plans, real = [], generation.written
    monkeypatch.setattr(generation, "written", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df))
    found = generation.ret_buffer_bugs(execs, duas).collect()
    assert {r["lval"]: (r["instr"], r["dua"], r["pad"]) for r in found} == expected and len(found) == 3
    looked = [p for p in plans if "Generate explode" in p]
    assert len(looked) >= 2 and all("SortMergeJoin" in p and "BroadcastHashJoin" not in p for p in looked)


def test_exploded_pairs_of_padded_bugs_are_not_broadcast(spark, monkeypatch):
    duas = spark.range(200).select(F.col("id").alias("dua"), F.lit("in").alias("inputfile"), (F.col("id") % 2).alias("lval"), F.lit("f").alias("loc"), F.col("id").alias("instr"), F.col("id").alias("ready"), (F.col("id") % 10).alias("run"), F.array((F.col("id") / 64).cast("int")).alias("labels"))
    execs = spark.range(30, 200, 10).select(F.lit("in").alias("inputfile"), F.lit("a").alias("atp"), F.col("id").alias("instr"))
    plans, real = [], generation.written
    monkeypatch.setattr(generation, "written", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df))
    found = generation.padded_bugs(execs, duas).collect()
    assert {(r["lval"], r["instr"], r["dua"], r["pad"]) for r in found} == {(0, 70, 62, 69), (1, 70, 63, 69)} and len(found) == 2
    looked = [p for p in plans if "Generate explode" in p]
    assert len(looked) >= 2 and all("SortMergeJoin" in p and "BroadcastHashJoin" not in p for p in looked)


def test_few_edges_are_united_without_rounds(spark, monkeypatch):
    """One task gives what the rounds give, and the driver plans two cuts instead of one a round."""
    rng = random.Random(8)
    pairs = [(i, i - 1) for i in range(1, 40)] + [(rng.randrange(40, 400), rng.randrange(40, 400)) for _ in range(150)] + [(5, 5), (1 << 62, -(1 << 62))]
    edges = spark.createDataFrame(pairs, "u long, v long").repartition(5)
    seen, real = [], common.cut
    monkeypatch.setattr(common, "cut", lambda df: seen.append(1) or real(df))
    found = sorted(map(tuple, common.components(edges).collect()))
    assert len(seen) == 2 and found[0] == (1, 0) and (1 << 62, -(1 << 62)) in found and not common.components(edges.where("u = v")).collect()
    seen.clear()
    monkeypatch.setattr(common, "EDGES_OF_TASK", 1)
    assert sorted(map(tuple, common.components(edges).collect())) == found and len(seen) > 3
