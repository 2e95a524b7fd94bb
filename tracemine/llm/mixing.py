"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemine.llm.common import SPACES, cut, empty_if_null, running

WEIGHTS, LIMIT, SEED = (1, 2, 3), 3, "mix"
#: Documents that one step of the reduction tree rounds together, on average.
FAN = 64
#: Repeats of one row that are numbered in one place.
REPEATS = 4096
#: Sources up to which their table is broadcast; more are joined by a shuffle.
FEW_SOURCES = 10_000


def n_words(text):
    """How many ``[^\\x20\\x09-\\x0D]+`` a text has: the pieces between white space, less an empty first and last one."""
    at_end = lambda x: x.rlike(SPACES).cast("int")
    pieces = F.size(F.split(text, SPACES)) - at_end(F.substring(text, 1, 1)) - at_end(F.substring(text, -1, 1))
    return F.when(F.length(text) == 0, 0).otherwise(pieces).cast("long")


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """Adds ``target`` to sources (``source``, ``source_size``): its share of all sizes by weight, at most ``limit`` times its size.

    Weights go to the sources in code point order, null last, and repeat. What a source cannot take is shared by weight among
    those below their limit. In order of limit over weight (ties: by source), a source is full if its share of what the fuller ones
    leave reaches its limit; all sources after the first that is not are below theirs. Ranks and sums are taken over range partitions.
    """
    in_order = running(sources, [F.col("source").asc_nulls_last()], {"rank": F.lit(1)})
    ranked = in_order.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))).drop("rank")
    by_limit = [F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()]
    summed = running(ranked, by_limit, {"rank": F.lit(1), "used": F.col("source_size") * limit, "before": F.col("weight")})
    all_sizes, all_weights = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    exact = lambda c: c.cast("decimal(19,0)")
    left, rest, most = F.lit(all_sizes) - F.col("used"), F.lit(all_weights) - F.col("before"), F.col("source_size") * limit
    full = exact(left) * exact(F.col("weight")) >= exact(rest) * exact(most)
    shared = cut(summed.select("source", "source_size", "weight", "rank", left.alias("left"), rest.alias("rest"), most.alias("most"), full.alias("full")))
    first = shared.where("NOT full").agg(F.min(F.struct("rank", "left", "rest"))).first()[0]
    own = F.lit(float(first["left"]) if first else 0.0) * F.col("weight") / F.lit(first["rest"] if first else 1)
    return shared.select("source", "source_size", F.when(F.col("full"), F.col("most").cast("double")).otherwise(own).alias("target"))


def _draw(*parts):
    """A number from 0 to 1, exclusive, that is a hash of parts."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 40)) / float(1 << 40)


def _rounded(level: int, x, y):
    """Moves words of copies between the residual x (with what is done so far) and document y until one of the two is taken or left."""
    up, down = F.least(x["size"] * (1 - x["p"]), y["size"] * y["p"]), F.least(x["size"] * x["p"], y["size"] * (1 - y["p"]))
    raised = _draw(F.lit(f"{SEED}{level}"), x["key"], y["key"]) * (up + down) < down
    x_done = F.when(raised, x["size"] * (1 - x["p"]) <= y["size"] * y["p"]).otherwise(x["size"] * x["p"] <= y["size"] * (1 - y["p"]))
    copy = F.when(raised == x_done, 1.0).otherwise(0.0)  # raised: x becomes 1 or y becomes 0; else x becomes 0 or y becomes 1
    move = F.when(raised, up).otherwise(-down)
    rest = F.when(x_done, y["p"] - move / y["size"]).otherwise(x["p"] + move / x["size"])
    names = ("doc_id", "th", "key", "size")
    decided = F.struct(*(F.when(x_done, x[k]).otherwise(y[k]).alias(k) for k in names), copy.alias("p"), F.lit(True).alias("done"))
    kept = (F.when(x_done, y[k]).otherwise(x[k]).alias(k) for k in names)
    return F.struct(F.concat(x["all"], F.array(decided)).alias("all"), *kept, F.least(F.lit(1.0), F.greatest(F.lit(0.0), rest)).alias("p"))


def _reduced(rows: DataFrame, level: int) -> DataFrame:
    """One level of the tree: rounds each group of rows (``source``, ``groups``, ``doc_id``, ``th``, ``key``, ``size``, ``p``) but for one residual, for which ``done`` is false."""
    member = F.struct(F.xxhash64(F.lit(f"{SEED}{level}"), "key").alias("order"), "doc_id", "th", "key", "size", "p")
    grouped = rows.groupBy("source", "groups", F.pmod(F.xxhash64(F.lit(level), "key"), "groups").alias("group")).agg(F.array_sort(F.collect_list(member)).alias("m"))
    none = F.array().cast("array<struct<doc_id:bigint,th:bigint,key:bigint,size:bigint,p:double,done:boolean>>")
    start = F.struct(none.alias("all"), *(F.col("m")[0][k].alias(k) for k in ("doc_id", "th", "key", "size", "p")))
    folded = grouped.select("source", "groups", F.aggregate(F.slice("m", 2, F.size("m")), start, lambda x, y: _rounded(level, x, y)).alias("f"))
    left = F.struct(*(F.col(f"f.{k}").alias(k) for k in ("doc_id", "th", "key", "size", "p")), F.lit(False).alias("done"))
    return folded.select("source", "groups", F.explode(F.concat(F.col("f.all"), F.array(left))).alias("d")).select("source", "groups", "d.*")


def _separate(sized: DataFrame) -> DataFrame:
    """A row per document with a ``key`` of its own, also where doc_id and text repeat: repeats are counted, and numbered in blocks that are dealt over all tasks."""
    counted = sized.groupBy("source", "doc_id", "th", "size").agg(F.count("*").alias("n"))
    blocks = counted.where(F.col("n") > REPEATS).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / REPEATS))))
    blocks = blocks.repartition("doc_id", "th", "block").withColumn("n", F.least(F.lit(REPEATS), F.col("n") - F.col("block") * REPEATS))
    every = counted.where(F.col("n") <= REPEATS).withColumn("block", F.lit(0).cast("long")).unionByName(blocks)
    each = every.withColumn("no", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return each.select("source", "doc_id", "th", "size", F.xxhash64("source", "doc_id", "th", "block", "no").alias("key"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, limit: int = LIMIT, fan: int = FAN) -> DataFrame:
    """One row per document: ``doc_id``, ``size``, ``source``, ``source_size``, ``target`` (its source's), ``copies``, ``taken`` (copies times size), ``th`` (a hash of its text).

    Every document of a source is taken floor(target / source_size) times, and once more with the probability that is left. These
    probabilities are rounded dependently: two documents exchange probability, weighed by their sizes, until one is certain. A
    source's expected words never change, so its taken words differ from its target by less than its last document's size. Leaves of
    about ``fan`` documents leave one residual each; residuals meet in further levels, of which there are log(n) to the base fan.
    Draws are hashes of the ids and texts, so reruns agree. Null or wordless texts have size 0 and are not taken; null is a source of its
    own, the last. Rows that repeat are separate documents, as are those without a doc_id. Sources of equal size and weight, or size over
    weight, get the targets that the contract's rule gives them. Other columns are ignored; an empty table gives an empty result. The limit
    bounds copies, as no target exceeds it.
    """
    text = empty_if_null("text")
    sized = cut(docs.select("doc_id", "source", n_words(text).alias("size"), F.xxhash64(text).alias("th")))
    by_source = cut(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, limit))
    few = by_source.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES

    def with_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
        sources = sources.withColumnRenamed("source", "of")
        return rows.join(F.broadcast(sources) if few else sources, F.col("source").eqNullSafe(F.col("of"))).drop("of")

    worded = _separate(sized.where("size > 0"))
    counted = with_source(by_source, sized.where("size > 0").groupBy("source").agg(F.ceil(F.count("*") / fan).alias("groups")))
    share = F.col("target") / F.col("source_size")
    shares = cut(counted.select("source", F.floor(share).alias("whole"), (share - F.floor(share)).alias("p"), "groups"))
    now = with_source(worded, shares).where("p > 0").select("source", "groups", "doc_id", "th", "key", "size", "p")
    most = shares.where("p > 0").agg(F.max("groups")).first()[0] or 0
    done, level = [], 0
    out_columns = ("source", "doc_id", "th", "size")
    while most:
        out = cut(_reduced(now, level))
        done.append(out.where("done").select(*out_columns, F.col("p").cast("long").alias("extra")))
        rest = out.where("NOT done")
        done.append(rest.where("groups = 1").select(*out_columns, (_draw(F.lit(f"{SEED}last"), "key") < F.col("p")).cast("long").alias("extra")))
        now = rest.where("groups > 1").select("source", F.ceil(F.col("groups") / fan).alias("groups"), "doc_id", "th", "key", "size", "p")
        most, level = -(-most // fan) if most > 1 else 0, level + 1
    certain = with_source(sized.where("size > 0"), shares.where("p = 0").select("source")).select(*out_columns, F.lit(0).cast("long").alias("extra"))
    rows = certain.unionByName(sized.where("size = 0").select(*out_columns, F.lit(0).cast("long").alias("extra")))
    for x in done:
        rows = rows.unionByName(x)
    copies = F.when(F.col("size") == 0, 0).otherwise(F.floor(F.col("target") / F.col("source_size")) + F.col("extra")).cast("long")
    return with_source(rows, by_source).withColumn("copies", copies).select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "th")


def mixed(docs: DataFrame, weights: Sequence[int] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """The rows of docs as often as the mix takes them, with all their columns.

    Documents without words are not taken; those without a doc_id are told apart by their texts. Rows with the same doc_id and text share
    their copies as evenly as whole numbers allow. Rows find their copies by doc_id and a hash of the text, so only such repeats meet.
    """
    no_id = F.lit(-(1 << 63))
    take = mix(docs, weights, limit).where("copies > 0").groupBy(F.coalesce("doc_id", no_id).alias("__of"), F.col("th").alias("__text")).agg(F.sum("copies").alias("__n"), F.count("*").alias("__taken"))
    keyed = docs.withColumns({"__id": F.coalesce("doc_id", no_id), "__th": F.xxhash64(empty_if_null("text"))})
    rows = keyed.join(take, (F.col("__id") == F.col("__of")) & (F.col("__th") == F.col("__text")))
    each = Window.partitionBy("__id", "__th")
    rank, n = F.row_number().over(each.orderBy(F.xxhash64("source"))), F.count("*").over(each)
    copies = F.floor(F.col("__n") / n) + (rank <= F.col("__n") % n).cast("long")
    taken = rows.withColumn("__copies", copies).where("__copies > 0").withColumn("__copy", F.explode(F.expr("sequence(1, CAST(__copies AS INT))")))
    return taken.drop("__id", "__th", "__of", "__text", "__n", "__taken", "__copies", "__copy")
