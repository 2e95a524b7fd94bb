"""Queries, statistics and selection of bugs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemine.schemas import BUG_KINDS

#: Kinds that change the program's structure; kinds of which one place may have any number.
STRUCTURAL, UNLIMITED = (2, 4), (0, 1, 3)


def drawn(seed, *keys) -> Column:
    """A random-looking order that any engine can repeat: md5 of the seed and the keys."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)))


def entity_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``entity``, ``n`` of each table."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("entity"), "n") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def bug_counts_by_type(bugs: DataFrame) -> DataFrame:
    """``kind``, ``name``, ``n`` for all kinds, those without bugs included, and a row for the total (kind null)."""
    kinds = bugs.sparkSession.createDataFrame([(v, k) for k, v in BUG_KINDS.items()], "kind int, name string")
    counts = bugs.groupBy("kind").agg(F.count("*").alias("n"))
    each = kinds.join(counts, "kind", "left").select("kind", "name", F.coalesce("n", F.lit(0)).alias("n"))
    return each.unionByName(counts.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n")).select(F.lit(None).cast("int").alias("kind"), F.lit("total").alias("name"), "n"))


def bug_detail(bugs: DataFrame, dua_bytes: DataFrame, atps: DataFrame) -> DataFrame:
    """Bugs with their trigger's bytes (``low``, ``high``), those of the first extra (null without one) and the point's ``file``, ``line``, ``atp_type``, in order of ``bug``."""
    extra = dua_bytes.select(F.col("dua_bytes").alias("__extra"), F.col("low").alias("extra_low"), F.col("high").alias("extra_high"))
    own = dua_bytes.select(F.col("dua_bytes").alias("trigger"), "low", "high")
    joined = bugs.select("bug", "kind", "trigger", "atp", "extra_duas").withColumn("__first", F.get("extra_duas", F.lit(0))).join(own, "trigger").join(extra, F.col("__first") == F.col("__extra"), "left").join(atps.select("atp", "file", "line", F.col("type").alias("atp_type")), "atp")
    return joined.select("bug", "kind", "trigger", "low", "high", "extra_low", "extra_high", "file", "line", "atp_type").orderBy("bug")


def bug_report(bugs: DataFrame, dua_bytes: DataFrame, duas: DataFrame, atps: DataFrame) -> DataFrame:
    """A row per bug and extra DUA (``pos`` null without any): the point, the trigger's ``lval``, ``max_tcn``, ``max_liveness``, and ``missing``: whether the extra is unknown."""
    trigger = dua_bytes.join(duas, "dua").select(F.col("dua_bytes").alias("trigger"), "lval", "max_tcn")
    known = dua_bytes.select(F.col("dua_bytes").alias("extra"), F.lit(True).alias("__known"))
    rows = bugs.select("bug", "kind", "trigger", "atp", "max_liveness", "extra_duas").join(trigger, "trigger").join(atps.select("atp", "file", "line"), "atp").select("bug", "kind", "file", "line", "lval", "max_tcn", "max_liveness", F.posexplode_outer("extra_duas").alias("pos", "extra"))
    return rows.join(known, "extra", "left").withColumn("missing", F.col("extra").isNotNull() & F.col("__known").isNull()).drop("__known")


def source_files_for_bugs(bugs: DataFrame, dua_files: DataFrame, atp_files: DataFrame) -> DataFrame:
    """Distinct ``file``s to edit: those of triggers, points and extras (``dua_bytes``/``atp``, ``path``); of a nested path the second part."""
    path = lambda df: df.select("path")
    extras = bugs.select(F.explode("extra_duas").alias("dua_bytes")).join(dua_files, "dua_bytes")
    all_ = path(bugs.select(F.col("trigger").alias("dua_bytes")).join(dua_files, "dua_bytes")).unionByName(path(bugs.join(atp_files, "atp"))).unionByName(path(extras))
    parts = F.split("path", "/")
    return all_.select(F.when(F.size(parts) > 1, parts[1]).otherwise(parts[0]).alias("file")).distinct()


def is_huge(bugs: DataFrame, n: int = 1_000_000) -> bool:
    """Whether there are more than n bugs; no more than n + 1 are counted."""
    return bugs.limit(n + 1).count() > n


def uninjected(bugs: DataFrame, build_bugs: DataFrame) -> DataFrame:
    """The bugs that no build has."""
    return bugs.join(build_bugs.select("bug"), "bug", "left_anti")


def uninjected_by_realness(bugs: DataFrame, build_bugs: DataFrame, dua_bytes: DataFrame, duas: DataFrame, fake: bool, kinds: list[int] | None = None) -> DataFrame:
    """Those of a fake or real trigger and, if given, of these kinds."""
    chosen = dua_bytes.join(duas.where(F.col("fake_dua") == F.lit(fake)), "dua").select(F.col("dua_bytes").alias("trigger"))
    rows = bugs if kinds is None else bugs.where(F.col("kind").isin(kinds))
    return uninjected(rows, build_bugs).join(chosen, "trigger", "left_semi")


def sample_uninjected(bugs: DataFrame, build_bugs: DataFrame, count: int, kinds: list[int] | None = None, seed: int = 0) -> DataFrame:
    """count random ones of these kinds: a top-k, not a full sort."""
    rows = bugs if kinds is None else bugs.where(F.col("kind").isin(kinds))
    return uninjected(rows, build_bugs).orderBy(drawn(seed, "bug"), "bug").limit(count)


def next_uninjected(bugs: DataFrame, build_bugs: DataFrame) -> DataFrame:
    """The one with the smallest id."""
    return uninjected(bugs, build_bugs).orderBy("bug").limit(1)


def sample_balanced(bugs: DataFrame, n: int, kinds: list[int], seed: int = 0, salts: int = 16) -> DataFrame:
    """floor(n / kinds that have bugs) random bugs of each of these kinds.

    There are few kinds, so each is cut to its share in ``salts`` parts before the parts meet.
    """
    rows = bugs.where(F.col("kind").isin(kinds))
    share = n // max(1, rows.select("kind").distinct().count())
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(drawn(seed, "bug"), "bug"))
    local = rows.withColumn("__salt", F.pmod(F.xxhash64("bug"), F.lit(salts))).withColumn("__rank", rank("kind", "__salt")).where(F.col("__rank") <= share)
    return local.withColumn("__rank", rank("kind")).where(F.col("__rank") <= share).drop("__salt", "__rank")


def pick_bugs(bugs: DataFrame, ids: DataFrame) -> DataFrame:
    """The bugs of a list of ids (``bug``)."""
    return bugs.join(ids.select("bug"), "bug", "left_semi")


def parse_bug_types(specs: DataFrame) -> DataFrame:
    """``spec``, ``name``, ``kind`` of comma lists of names; an unknown name is an error."""
    kinds = specs.sparkSession.createDataFrame([(k, v) for k, v in BUG_KINDS.items()], "name string, kind int")
    names = specs.select("spec", F.explode(F.split("spec", ",")).alias("name")).select("spec", F.upper(F.trim("name")).alias("name"))
    known = names.join(F.broadcast(kinds), "name", "left")
    return known.select("spec", "name", F.coalesce("kind", F.raise_error(F.concat(F.lit("unknown kind of bug: "), "name")).cast("int")).alias("kind"))


def limit_atp_reuse(bugs: DataFrame) -> DataFrame:
    """Bugs (``file``, ``line``, ``kind``, ``pos``: their order) that may share places: the first at a place decides whether it is structural, bugs of the other sort
    go, and kinds that are not unlimited may occur once there."""
    place = Window.partitionBy("file", "line")
    structural = F.col("kind").isin(*STRUCTURAL)
    same = bugs.withColumn("__s", structural).withColumn("__first", F.min_by("__s", "pos").over(place)).where("__s = __first").drop("__s", "__first")
    rank = F.row_number().over(Window.partitionBy("file", "line", "kind").orderBy("pos"))
    return same.withColumn("__rank", rank).where(F.col("kind").isin(*UNLIMITED) | (F.col("__rank") == 1)).drop("__rank")


def entity_dump(rows: DataFrame, order: list[str], most: int = 10) -> DataFrame:
    """Rows in a fixed order with arrays shortened to their first elements and the count of the rest."""
    def short(name: str, kind: str) -> Column:
        if not kind.startswith("array"):
            return F.col(name)
        return F.concat(F.array_join(F.slice(F.col(name).cast("array<string>"), 1, most), ","), F.when(F.size(name) > most, F.concat(F.lit(",+"), (F.size(name) - most).cast("string"))).otherwise(""))

    return rows.select(*(short(n, k).alias(n) for n, k in rows.dtypes)).orderBy(*order)
