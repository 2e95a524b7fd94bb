"""Synthesis of fuzzed inputs, and scoring of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemine.functions.scalars import knob_value, pack_le32, path_value
from tracemine.operators.selection import drawn
from tracemine.sources.logs import numbered

#: The kinds of bugs with three triggers, and of leaks.
REL_WRITE, PRINTF_LEAK = 2, 3
#: Consecutive ids that may share a row.
CHUNK = 10_000


def fuzz_labels(bugs: DataFrame, dua_bytes: DataFrame) -> DataFrame:
    """``bug``, ``lists``: the sorted labels of the trigger and then of each extra, in the order of ``extra_duas``."""
    uses = bugs.select("bug", F.posexplode(F.concat(F.array("trigger"), F.coalesce("extra_duas", F.array().cast("array<bigint>")))).alias("pos", "dua_bytes"))
    full = uses.join(dua_bytes, "dua_bytes").select("bug", "pos", F.sort_array("all_labels").alias("labels"))
    return full.groupBy("bug").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "labels"))), lambda x: x["labels"]).alias("lists"))


def pick_seeds(bugs: DataFrame, corpus: DataFrame, seed: int = 0) -> DataFrame:
    """bugs with the ``name`` of an input each, drawn by md5: names are numbered once, over range partitions, and bugs join on a number."""
    names = numbered(corpus.select("name"), ["name"], "__no").select("name", F.col("__no").cast("bigint").alias("__no"))
    n = corpus.count()
    number = F.conv(F.substring(drawn(seed, "bug"), 1, 8), 16, 10).cast("bigint") % max(1, n)
    return bugs.withColumn("__no", number).join(names, "__no").drop("__no")


def rel_write_values(magic) -> list[Column]:
    """Three values that fulfil a REL_WRITE trigger, by the magic modulo 3."""
    magic = F.col(magic) if isinstance(magic, str) else magic
    form, zero, one = magic % 3, F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    inverse = pow(9, -1, 1 << 32)  # with b = 8 and c = 2**32 - 2: (a + 2) * 9 * 1
    solved = F.pmod(magic.cast("decimal(20,0)") * F.lit(inverse).cast("decimal(12,0)") - 2, F.lit(1 << 32).cast("decimal(12,0)")).cast("bigint")
    pick = lambda *of: F.when(form == 0, of[0]).when(form == 1, of[1]).otherwise(of[2])
    return [pick(magic, magic, solved), pick(zero, one, F.lit(8).cast("bigint")), pick(one, zero, F.lit((1 << 32) - 2))]


def mutate_inputs(jobs: DataFrame, knob: int | None = None) -> DataFrame:
    """``bug``, ``name``, ``content``: inputs with the first four labels of each list overwritten by the bug's magic, the lowest byte first.

    jobs: ``bug``, ``kind``, ``magic``, ``lists``, ``name``, ``content``; REL_WRITE gets three values, from ``solution`` if it is there and not null, else by the magic, and lists beyond the third are not written.
    With a knob the trigger's value (of the first list) carries it in its upper half. Labels beyond the input are ignored; of writes to one byte the last one counts. A null input stays null.
    Writes to bytes that follow one another are one run, and an input is copied once per run.
    """
    magic = F.col("magic").cast("bigint")
    plain = [magic if knob is None else knob_value("magic", knob), magic]
    values = F.transform("lists", lambda _, i: F.when(i == 0, plain[0]).otherwise(plain[1]))
    three = F.array(*rel_write_values(magic))
    if "solution" in jobs.columns:
        three = F.coalesce(F.col("solution").cast("array<bigint>"), three)
    values = F.when(F.col("kind") == REL_WRITE, three).otherwise(values)
    ends = F.length("content")
    bytes_of = lambda labels, i: F.transform(F.slice(labels, 1, 4), lambda at, k: F.struct(at.cast("int").alias("at"), F.substring(pack_le32(F.get(values, i)), k + 1, F.lit(1)).alias("bytes")))
    writes = F.filter(F.flatten(F.transform("lists", bytes_of)), lambda w: w["at"].between(0, ends - 1) & w["bytes"].isNotNull())

    def run(runs, w):
        last = F.get(runs, F.size(runs) - 1)
        longer = F.struct(last["at"].alias("at"), F.concat(last["bytes"], w["bytes"]).alias("bytes"))
        follows = F.coalesce(last["at"] + F.length(last["bytes"]) == w["at"], F.lit(False))
        return F.when(follows, F.array_append(F.slice(runs, F.lit(1), F.greatest(F.size(runs) - 1, F.lit(0))), longer)).otherwise(F.array_append(runs, w))

    runs = F.aggregate(writes, F.array().cast("array<struct<at: int, bytes: binary>>"), run)
    written = F.aggregate(F.col("__runs"), F.col("content"), lambda raw, r: F.overlay(raw, r["bytes"], r["at"] + 1))
    return jobs.withColumn("__runs", runs).select("bug", "name", written.alias("content"))


def generated_inputs(states: DataFrame) -> DataFrame:
    """``name``, ``content`` of each distinct content, at its first index: ``gen_<origin>_<addr>_<i>.bin``. states: ``origin``, ``addr``, ``i``, ``content``."""
    key = F.sha2(F.col("content").cast("binary"), 256)
    first = states.groupBy(key.alias("sha"), "content").agg(F.min(F.struct("i", "origin", "addr")).alias("f"))
    return first.select(F.concat_ws("_", F.lit("gen"), "f.origin", "f.addr", F.concat(F.col("f.i").cast("string"), F.lit(".bin"))).alias("name"), "content")


def baseline_check(runs: DataFrame, expected: int = 0) -> DataFrame:
    """The runs of original inputs (``fuzzed`` is null) that did not exit as expected."""
    return runs.where(F.col("fuzzed").isNull() & ~F.col("exitcode").eqNullSafe(F.lit(expected)))


def validate_runs(runs: DataFrame, bugs: DataFrame) -> DataFrame:
    """Adds ``crashed`` and ``validated`` to fuzzed runs (``run``, ``input``, ``fuzzed``, ``exitcode``, ``output``). bugs: ``bug``, ``kind``, ``fake_dua``.

    A run crashed if its exit code modulo 256 is over 128 and the code is not -9. Leaks are valid if the output differs from that of the input's baseline run, other bugs if
    they crashed; fake triggers are never valid, and ``ok`` says whether they exited with 0.
    """
    base = runs.where("fuzzed IS NULL").groupBy("input").agg(F.min("output").alias("__base"))
    rows = runs.where("fuzzed IS NOT NULL").join(bugs.select(F.col("bug").alias("fuzzed"), "kind", "fake_dua"), "fuzzed").join(base, "input", "left")
    crashed = (F.pmod(F.col("exitcode"), F.lit(256)) > 128) & (F.col("exitcode") != -9)
    valid = F.when(F.col("fake_dua"), False).when(F.col("kind") == PRINTF_LEAK, ~F.col("output").eqNullSafe(F.col("__base"))).otherwise(crashed)
    return rows.select("run", "input", "fuzzed", "exitcode", "kind", "fake_dua", crashed.alias("crashed"), valid.alias("validated"), (~F.col("fake_dua") | (F.col("exitcode") == 0)).alias("ok"))


def crash_bug_ids(outputs: DataFrame) -> DataFrame:
    """``run``, ``bug``: the ids in ``LAVALOG: <id>: ...`` lines of each output, without zeros."""
    ids = F.regexp_extract_all("output", F.lit(r"(?m)^LAVALOG: *([0-9]+) *:"), F.lit(1))
    return outputs.select("run", F.explode(ids).alias("id")).select("run", F.col("id").cast("bigint").alias("bug")).where("bug <> 0")


def grading_agreement(runs: DataFrame, reported: DataFrame) -> DataFrame:
    """``run``, ``agrees`` of crashed runs: whether the reported ids are just the fuzzed bug's. reported: ``run``, ``bug``."""
    ids = reported.groupBy("run").agg(F.sort_array(F.collect_set("bug")).alias("ids"))
    return runs.where("crashed").join(ids, "run", "left").select("run", F.coalesce(F.col("ids") == F.array(F.col("fuzzed").cast("bigint")), F.lit(False)).alias("agrees"))


def yield_with_ci(runs: DataFrame, by: list[str]) -> DataFrame:
    """``by``, ``tried``, ``validated``, ``yield`` and ``ci``, half the width of its 95% confidence interval."""
    f = F.avg(F.col("validated").cast("double"))
    return runs.groupBy(*by).agg(F.count("*").alias("tried"), F.count_if("validated").alias("validated"), f.alias("yield"), (1.96 * F.sqrt(f * (1 - f) / F.count("*"))).alias("ci"))


def type_breakdown(bugs: DataFrame, validated: DataFrame) -> DataFrame:
    """``kind``, ``chunk``, ``potential``, ``potential_ids``, ``validated``, ``validated_ids`` (sorted), in chunks of ``CHUNK`` consecutive ids, so that no row grows with the table. validated: distinct ``bug``s."""
    marked = bugs.join(validated.select("bug").distinct().withColumn("ok", F.lit(True)), "bug", "left")
    good = F.when(F.col("ok"), F.col("bug"))
    return marked.groupBy("kind", F.floor(F.col("bug") / CHUNK).alias("chunk")).agg(F.count("*").alias("potential"), F.array_sort(F.collect_list("bug")).alias("potential_ids"), F.count(good).alias("validated"), F.array_sort(F.collect_list(good)).alias("validated_ids"))


def coverage_summary(lines: DataFrame) -> DataFrame:
    """``report``, ``coverage``: the first percentage of each report's last line (``report``, ``line_no``, ``line``), else -1."""
    last = lines.groupBy("report").agg(F.max_by("line", "line_no").alias("line"))
    found = F.regexp_extract("line", r"([0-9]+\.[0-9]+)%", 1)
    return last.select("report", F.coalesce(F.when(found != "", found.cast("double")), F.lit(-1.0)).alias("coverage"))


def path_jump_score(paths: DataFrame) -> DataFrame:
    """``run``, ``score``: the mean absolute difference between the values of consecutive paths (``run``, ``i``, ``path``); 0 for fewer than two. Paths that are none are left out."""
    values = paths.withColumn("value", path_value("path")).where("value IS NOT NULL")
    jumps = values.withColumn("jump", F.abs(F.col("value") - F.lag("value").over(Window.partitionBy("run").orderBy("i"))))
    return paths.select("run").distinct().join(jumps.groupBy("run").agg(F.avg("jump").alias("score")), "run", "left").select("run", F.coalesce("score", F.lit(0.0)).alias("score"))
