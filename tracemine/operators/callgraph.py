"""Which functions may be instrumented: set operations and a closure over the call graph.

Facts: fun (``name``, ``hasbody``), calls (``name``: the callee, ``containing_function``, ``args``: array of struct with ``name``, ``info``), assigns (``name``).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemine.operators.ordered import shared_folder, sum_so_far, written

#: The flags of functions that may be instrumented, and of those that may not.
OK, BANNED = 0, 3
#: Callers that may share a row.
CHUNK = 10_000


def functions_passed_as_args(calls: DataFrame) -> DataFrame:
    """Distinct ``function``, ``receiver``: functions given to a call as an argument."""
    each = calls.select(F.col("name").alias("receiver"), F.explode("args").alias("a"))
    return each.where("a.info = 'function' AND a.name <> 'None'").select(F.col("a.name").alias("function"), "receiver").distinct()


def all_functions(fun: DataFrame, calls: DataFrame) -> DataFrame:
    """Distinct ``name``s that are declared, defined, called, or passed as an argument."""
    return fun.select("name").unionByName(calls.select("name")).unionByName(functions_passed_as_args(calls).select(F.col("function").alias("name"))).where("name IS NOT NULL").distinct()


def function_counts(fun: DataFrame, calls: DataFrame) -> DataFrame:
    """``step``, ``n``: how many distinct names there are after declarations, calls and arguments."""
    tagged = fun.select("name", F.lit(0).alias("step")).unionByName(calls.select("name", F.lit(1).alias("step"))).unionByName(functions_passed_as_args(calls).select(F.col("function").alias("name"), F.lit(2).alias("step")))
    first = tagged.where("name IS NOT NULL").groupBy("name").agg(F.min("step").alias("first"))
    return first.agg(*[F.count_if(F.col("first") <= i).alias(str(i)) for i in range(3)]).select(F.explode(F.array(*[F.struct(F.lit(s).alias("step"), F.col(str(i)).alias("n")) for i, s in enumerate(("declared", "called", "passed"))])).alias("x")).select("x.*")


def function_index(fun: DataFrame, calls: DataFrame, assigns: DataFrame) -> dict[str, DataFrame]:
    """``defined``: distinct names with a body; ``assigned``: distinct names; ``callers``: ``name``, ``chunk``, ``callers`` (sorted): chunk k holds the callers from k * CHUNK on, so no row grows with the table.

    Callers are numbered by an ordered pass, which spreads a function that all others call.
    """
    each = calls.where("containing_function IS NOT NULL").select("name", "containing_function").distinct()
    placed = sum_so_far(each, ["name"], "containing_function", F.lit(1), "__rank")
    callers = placed.groupBy("name", F.floor(F.col("__rank") / CHUNK).alias("chunk")).agg(F.sort_array(F.collect_list("containing_function")).alias("callers"))
    return {"defined": fun.where("hasbody").select("name").distinct(), "assigned": assigns.select("name").distinct(), "callers": callers}


def initial_judgement(names: DataFrame, fun: DataFrame) -> DataFrame:
    """``name``, ``flag``: OK with a body, else BANNED."""
    body = fun.where("hasbody").select("name").distinct().withColumn("__body", F.lit(True))
    return names.join(body, "name", "left").select("name", F.when(F.col("__body"), OK).otherwise(BANNED).alias("flag"))


def _ban(judgement: DataFrame, names: DataFrame) -> DataFrame:
    bad = names.select("name").distinct().withColumn("__bad", F.lit(True))
    return judgement.join(bad, "name", "left").select("name", F.when(F.col("__bad"), BANNED).otherwise(F.col("flag")).alias("flag"))


def arg_escape_rule(judgement: DataFrame, passed: DataFrame) -> DataFrame:
    """Bans functions that are passed to a banned one, or to one that is not known, all by the judgement given."""
    receivers = judgement.select(F.col("name").alias("receiver"), F.col("flag").alias("__flag"))
    escaping = passed.join(receivers, "receiver", "left").where(F.coalesce("__flag", F.lit(BANNED)) != OK)
    return _ban(judgement, escaping.select(F.col("function").alias("name")))


def fnptr_rule(judgement: DataFrame, assigns: DataFrame, enabled: bool = True) -> DataFrame:
    """If enabled, bans functions that are assigned to pointers."""
    return _ban(judgement, assigns) if enabled else judgement


def close_over_callers(judgement: DataFrame, calls: DataFrame) -> DataFrame:
    """Bans whatever a banned function calls, until nothing changes: a breadth-first search from the banned ones.

    Only edges from judged names to those that are not banned yet can change anything; the others are left out first. A round writes the names that it reaches, and those only, as a folder of its own in the checkpoint folder; what was reached before is read from the folders of the rounds before, and never written again.
    """
    spark, judgement = judgement.sparkSession, written(judgement)
    path = f"{shared_folder(spark)}/closure-{uuid.uuid4().hex}"
    edges = calls.select(F.col("containing_function").alias("caller"), "name").join(judgement.select(F.col("name").alias("caller")), "caller", "left_semi").join(judgement.where(F.col("flag") == OK).select("name"), "name", "left_semi").distinct()
    edges = written(edges)
    of = lambda *rounds: spark.read.schema("name string").parquet(*(f"{path}/round={i}" for i in rounds))
    judgement.where(F.col("flag") != OK).select("name").distinct().write.parquet(f"{path}/round=0")
    last = 0
    while not of(last).isEmpty():
        reached = edges.join(of(last).withColumnRenamed("name", "caller"), "caller", "left_semi").select("name").distinct().join(of(*range(last + 1)), "name", "left_anti")
        last += 1
        reached.write.parquet(f"{path}/round={last}")
    return _ban(judgement, of(*range(last + 1)))


def instrumentable(judgement: DataFrame, blacklist: list[str]) -> DataFrame:
    """The OK names that are not blacklisted, sorted."""
    return judgement.where((F.col("flag") == OK) & ~F.col("name").isin(*blacklist)).select("name").orderBy("name")


def judgement_counts(judgement: DataFrame, fun: DataFrame) -> DataFrame:
    """``flag``, ``n`` over functions with bodies."""
    return judgement.join(fun.where("hasbody").select("name").distinct(), "name", "left_semi").groupBy("flag").agg(F.count("*").alias("n"))
