"""Mining of DUAs: dead, uncomplicated and available values of a trace.

Bytes are rows: ``trace_id``, ``seq`` (the query), ``inputfile``, ``lval``, ``offset``, ``ptr``, ``tcn``, ``labels``; untainted bytes have null labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemine.functions.scalars import count_viable, first_dead_run, is_header_file, labels_in_range
from tracemine.operators.lives import Lives, given, plain, with_shards
from tracemine.operators.ordered import least_after, sum_so_far, with_next, written
from tracemine.schemas import MAGIC
from tracemine.sources.logs import first_by

#: Sizes of dyadic intervals, as powers of two: seq is under 2**LEVELS, as read_trace_log makes it for files of under 2 TB.
LEVELS = 61
#: Fixed value: the length that values are capped to.
MAX_LVAL = 100


def query_bytes(queries: DataFrame, elements: DataFrame, sets: DataFrame, max_lval_size: int = MAX_LVAL, keep: tuple[str, ...] = ()) -> DataFrame:
    """Tainted bytes of the queries with the labels of their pointers, first seen at or before the query.

    queries: ``trace_id``, ``seq``, ``inputfile``, ``lval``, ``filename``, ``len``, ``instr``; those in header files are dropped. elements: ``trace_id``, ``seq``,
    ``offset``, ``ptr``, ``tcn`` and others to ``keep``; offsets from the capped length on are dropped, as are pointers not known yet.
    """
    capped = queries.where(~is_header_file("filename")).withColumn("len", F.least("len", F.lit(max_lval_size)))
    inside = elements.select("trace_id", "seq", "offset", "ptr", "tcn", *keep).join(capped, ["trace_id", "seq"]).where("offset < len")
    known = sets.select("trace_id", "ptr", "labels", "first_seq")
    return inside.join(known, ["trace_id", "ptr"]).where("first_seq <= seq").drop("first_seq")


def viable_bytes(rows: DataFrame, max_tcn: int, max_card: int, enforce: bool = False) -> DataFrame:
    """Adds ``viable``; without enforce every byte with labels is, else only those within both limits."""
    within = (F.col("tcn") <= max_tcn) & (F.size("labels") <= max_card)
    return rows.withColumn("viable", F.col("labels").isNotNull() & (within if enforce else F.lit(True)))


def byte_death(rows: DataFrame, death: DataFrame) -> DataFrame:
    """Adds ``dead_at``: the seq at which the first of a byte's labels becomes too live; null if none does.

    A byte's labels are exploded and equi-joined to the one row per label that label_death gives, so hot labels do not multiply rows.
    """
    key = ["trace_id", "seq", "offset"]
    each = rows.select(*key, "inputfile", F.explode("labels").alias("label")).join(death, ["inputfile", "label"])
    return rows.join(each.groupBy(*key).agg(F.min("death_seq").alias("dead_at")), key, "left")


def dua_candidates(rows: DataFrame, n: int = MAGIC, death: DataFrame | None = None) -> DataFrame:
    """One row per query: arrays by offset, label union, maxima, and whether it is real now.

    rows: bytes with ``viable``, ``len``, ``num_tainted`` and, without death, ``dead_at``. With death (``inputfile``, ``label``, ``death_seq``), that is looked up once per query and label instead of once per byte. Real: num_tainted, viable bytes and labels are n each at least, and n consecutive
    viable bytes are not too live yet. Columns: ``trace_id``, ``seq``, ``inputfile``, ``lval``, ``ptrs``, ``tcns``, ``labels``, ``deaths``, ``all_labels``, ``max_tcn``,
    ``max_cardinality``, ``low``, ``high``, ``real``; arrays have null where a byte is not viable. A query without viable bytes has no row.
    """
    kept = rows.where("viable")
    parts = ["ptr", "tcn", "labels", *(["dead_at"] if death is None else [])]
    grouped = kept.groupBy("trace_id", "seq").agg(
        F.first("inputfile").alias("inputfile"), F.first("lval").alias("lval"), F.max("len").cast("int").alias("len"), F.max("num_tainted").alias("num_tainted"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("offset", F.struct(*parts))))).alias("b"), F.max("tcn").alias("max_tcn"), F.max(F.size("labels")).alias("max_cardinality"),
    )
    slots = F.transform(F.sequence(F.lit(0), F.col("len") - 1), lambda i: F.try_element_at("b", i))
    arrays = grouped.withColumn("slots", slots).drop("b").withColumns({"ptrs": F.col("slots.ptr"), "tcns": F.col("slots.tcn"), "labels": F.col("slots.labels")})
    if death is None:
        arrays = arrays.withColumn("deaths", F.col("slots.dead_at")).drop("slots")
    else:
        arrays = written(arrays.drop("slots").withColumn("all_labels", labels_in_range("labels", F.lit(0), F.size("labels"))))
        each = arrays.select("trace_id", "seq", "inputfile", F.explode("all_labels").alias("label")).join(death, ["inputfile", "label"])
        dying = each.groupBy("trace_id", "seq").agg(F.map_from_entries(F.collect_list(F.struct("label", "death_seq"))).alias("dying"))
        first = lambda b: F.array_min(F.transform(b, lambda x: F.try_element_at("dying", x)))
        arrays = arrays.join(dying, ["trace_id", "seq"], "left").withColumn("deaths", F.transform("labels", first)).drop("dying")
    alive = F.zip_with("ptrs", "deaths", lambda p, d: p.isNotNull() & (d.isNull() | (d > F.col("seq"))))
    ready = arrays.withColumn("run", first_dead_run(alive, n)).withColumn("all_labels", F.col("all_labels") if death is not None else labels_in_range("labels", F.lit(0), F.size("labels")))
    real = (F.col("num_tainted") >= n) & (count_viable("ptrs") >= n) & (F.size("all_labels") >= n) & (F.col("run.high") > 0)
    return ready.select("trace_id", "seq", "inputfile", "lval", "ptrs", "tcns", "labels", "deaths", "all_labels", "max_tcn", "max_cardinality", F.col("run.low").alias("low"), F.col("run.high").alias("high"), real.alias("real"))


def fake_duas(elements: DataFrame, queries: DataFrame | None = None, n: int = MAGIC) -> DataFrame:
    """``trace_id``, ``seq``, ``bytes``: for chaff, the first n free bytes of queries with n untainted bytes at least. The i-th entry of a query frees byte i if its offset is beyond i.

    queries: ``trace_id``, ``seq``, ``len``, ``num_tainted``, ``real``; elements: ``trace_id``, ``seq``, ``pos``, ``offset``. Without queries, elements have the other columns of their query too, and nothing is joined.
    """
    wanted = ~F.col("real") & (F.col("len") - F.col("num_tainted") >= n)
    free = elements.where("offset > pos")
    free = free.where(wanted) if queries is None else free.join(queries.where(wanted).select("trace_id", "seq"), ["trace_id", "seq"], "left_semi")
    found = free.groupBy("trace_id", "seq").agg(F.slice(F.array_sort(F.collect_list("pos")), 1, n).alias("bytes"))
    return found.where(F.size("bytes") == n)


def source_lvals(queries: DataFrame) -> DataFrame:
    """Distinct ``loc``, ``ast_name`` with the length at first sight (``len_bytes``) and a key hashed from the two. queries: those columns, ``trace_id`` and ``seq``."""
    first = first_by(queries.select("loc", "ast_name", "len_bytes", "trace_id", "seq"), ["loc", "ast_name"], ["trace_id", "seq"])
    return first.select(F.xxhash64("loc", "ast_name").alias("lval_key"), "loc", "ast_name", "len_bytes")


def duas(candidates: DataFrame) -> DataFrame:
    """The first candidate per ``lval``, ``inputfile``, ``instr``, ``fake_dua``, with a key hashed from these."""
    keys = ["lval", "inputfile", "instr", "fake_dua"]
    return first_by(candidates, keys, ["trace_id", "seq"]).withColumn("dua_key", F.xxhash64(*keys))


def dua_byte_table(found: DataFrame) -> DataFrame:
    """``dua_key``, ``offset``, ``ptr``: a row per byte, null pointers included."""
    return found.select("dua_key", F.posexplode_outer("byte_ptr").alias("offset", "ptr"))


def label_to_duas(found: DataFrame) -> DataFrame:
    """``label``, ``dua_key`` of real DUAs."""
    return found.where("NOT fake_dua").select(F.explode("all_labels").alias("label"), "dua_key").distinct()


def dua_lifetimes(found: DataFrame, branches: DataFrame | None = None, n: int = MAGIC) -> DataFrame:
    """Adds ``start`` (its seq), ``end`` (exclusive; null: never) and ``reason``: until when a DUA may be used.

    found: ``trace_id``, ``inputfile``, ``lval``, ``seq``, ``deaths`` (seq by byte; null: never), ``usable`` (by byte), ``fake_dua``, ``ast_name``, ``all_labels``. It ends at the earlier of the next DUA of
    its lvalue and the death of its last window of n usable bytes; liveness only grows, so a window dies with its first byte, and a DUA with its last window.
    Names that contain ``nodua`` die at the first branch (``inputfile``, ``seq``, ``label``) that touches a label of theirs; fake ones are only replaced.
    """
    never = F.lit(1 << 62)
    byte = F.zip_with("usable", "deaths", lambda ok, d: F.when(ok, F.coalesce(d, never)).otherwise(F.lit(-1)))
    windows = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(byte) - n + 1)), lambda i: F.array_min(F.slice(byte, i, F.lit(n))))
    last = F.array_max(windows)
    rows = found.withColumn("__death", F.when(F.col("fake_dua"), never).otherwise(last))
    if branches is not None:
        marked = rows.where("ast_name LIKE '%nodua%' AND NOT fake_dua").select("trace_id", "lval", "seq", "inputfile", F.explode("all_labels").alias("label"))
        both = marked.unionByName(branches.select("inputfile", "label", "seq", F.col("seq").alias("__at")), allowMissingColumns=True)
        first = least_after(both, ["inputfile", "label"], "seq", "__at", "__first").where("__at IS NULL AND __first IS NOT NULL")
        touched = first.groupBy("trace_id", "lval", "seq").agg(F.min("__first").alias("__touched"))
        rows = rows.join(touched, ["trace_id", "lval", "seq"], "left").withColumn("__death", F.least("__death", F.coalesce("__touched", never))).drop("__touched")
    rows = with_next(written(rows), ["trace_id", "lval"], "seq", [], "__after").withColumn("__next", F.coalesce("__after.seq", never))
    end = F.least("__next", "__death")
    reason = F.when(end == never, "alive").when(F.col("__next") <= F.col("__death"), "replaced").otherwise("died")
    return rows.select(*found.columns, F.col("seq").alias("start"), F.when(end < never, F.greatest(end, F.col("seq"))).alias("end"), reason.alias("reason"))


def _shift(x, k, left: bool = False):
    return F.call_function("shiftleft" if left else "shiftright", x, k)


def cover(low, high):
    """The dyadic intervals (``level``, ``place``: place * 2**level on) that make up [low, high], which hold whole numbers from 0 to 2**LEVELS - 1: two of a level at most."""

    def parts(k):
        size = _shift(F.lit(1).cast("bigint"), k, left=True)
        first, last = _shift(low + size - 1, k), _shift(high + 1, k) - 1  # of the intervals of this level that lie within
        whole = lambda x: (_shift(_shift(x, F.lit(1)), k + 1, left=True) >= low) & (_shift(_shift(x, F.lit(1)) + 1, k + 1, left=True) - 1 <= high)
        ends = F.when(first <= last, F.array_distinct(F.array(first, last))).otherwise(F.array().cast("array<bigint>"))
        return F.transform(F.filter(ends, lambda x: ~whole(x)), lambda x: F.struct(k.alias("level"), x.alias("place")))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), parts))


def ancestors(at):
    """The dyadic intervals that hold a number, one of each level."""
    return F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), lambda k: F.struct(k.alias("level"), _shift(at, k).alias("place")))


def dyadic(probes: DataFrame, lifetimes: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """probes and lifetimes, dealt to dyadic intervals (``__level``, ``__place`` of a trace): a probe meets each lifetime that holds it in one of them."""
    last = probes.groupBy("trace_id").agg(F.max("probe_seq").alias("__last"))
    low = F.col("start") + 1 if strict else F.col("start")
    high = F.least(F.coalesce(F.col("end") - 1, F.col("__last")), "__last")
    spans = lifetimes.join(last, "trace_id").where(low <= high).withColumn("__in", F.explode(cover(low, high))).drop("__last")
    dealt = written(spans.withColumns({"__level": F.col("__in.level"), "__place": F.col("__in.place")}).drop("__in"))  # for the levels, and for the join
    levels = [r[0] for r in dealt.select("__level").distinct().collect()]  # LEVELS + 1 at most
    own = F.filter(ancestors(F.col("probe_seq")), lambda x: x["level"].isin(levels))
    asked = probes.withColumn("__in", F.explode(own)).withColumns({"__level": F.col("__in.level"), "__place": F.col("__in.place")}).drop("__in")
    return asked, dealt


def active_duas(probes: DataFrame, lifetimes: DataFrame, strict: bool = False) -> DataFrame:
    """Pairs of probes (``trace_id``, ``probe_seq``) and DUAs (``start``, ``end``) alive there: start <= probe < end; with strict, start < probe.

    A lifetime is made up of dyadic intervals, two for each doubling of its length at most, and a probe lies in one of each size; they are equi-joined on (trace, size,
    place). So each pair meets once, a long lifetime costs few rows, and a single trace spreads over many tasks. Sizes that no lifetime uses drop out of the join.
    """
    asked, dealt = dyadic(probes, lifetimes, strict)
    return asked.join(dealt, ["trace_id", "__level", "__place"]).drop("__level", "__place")


def replay_exact(events: DataFrame, max_liveness: int, n: int = MAGIC, erase_siblings: bool = True) -> DataFrame:
    """``trace_id``, ``lval``, ``seq``, ``end``, ``reason`` of each DUA by replaying traces entry by entry; for audits.

    events: ``trace_id``, ``seq``, ``lval`` (null for a branch) and ``labels``: an array by byte for queries, one array in it for branches; queries may bring
    ``num_tainted``, ``fake`` and ``nodua``. The rule is that of ``Lives``; with erase_siblings, siblings of a DUA that died are not looked at again through its labels (which dua_lifetimes does not repeat).
    A trace is cut into shards, whose lvalues share no label with others, and each is replayed in order in one task; shard_sizes tells how large they are. A task reads batch by batch,
    and keeps what is alive only: a number per label, a DUA per lvalue.
    """

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, lives, since = None, None, {}
        framed = lambda out: pd.DataFrame(out, columns=["trace_id", "lval", "seq", "end", "reason"]).astype({"seq": "int64", "end": "Int64"})
        for rows in batches:
            out = []
            for r in rows.itertuples():
                if shard != (r.trace_id, r.shard):
                    out += [(shard[0], lval, seq, None, "alive") for lval, seq in since.items()]
                    shard, lives, since = (r.trace_id, r.shard), Lives(max_liveness, n, erase_siblings, {}, {}, {}), {}
                labels = plain(r.labels)
                if r.lval is None:
                    happened = lives.branch(x for b in labels for x in b or ())
                else:
                    happened = lives.query(r.seq, r.lval, labels, given(r, "num_tainted"), bool(given(r, "fake", False)), bool(given(r, "nodua", False)))
                for lval, seq, what in happened:
                    if what == "born":
                        since[lval] = seq
                    else:
                        out.append((r.trace_id, lval, seq, r.seq, what))
                        del since[lval]
            yield framed(out)
        yield framed([(shard[0], lval, seq, None, "alive") for lval, seq in since.items()])

    dealt = with_shards(events).repartition("trace_id", "shard").sortWithinPartitions("trace_id", "shard", "seq")
    return dealt.mapInPandas(replay, "trace_id string, lval string, seq long, end long, reason string")


def dua_bytes(found: DataFrame) -> DataFrame:
    """Distinct ``dua_key``, ``low``, ``high`` with the label union of the slice and a key hashed from the three. found: those and ``labels`` by byte."""
    slices = found.select("dua_key", "low", "high", labels_in_range("labels", "low", "high").alias("all_labels")).dropDuplicates(["dua_key", "low", "high"])
    return slices.withColumn("dua_bytes_key", F.xxhash64("dua_key", "low", "high"))


def dead_extents(rows: DataFrame, snapshot: DataFrame, max_liveness: int, max_tcn: int, max_card: int, size_min: int, size_max: int) -> DataFrame:
    """Extents (queries) all of whose bytes are dead and uncomplicated: ``trace_id``, ``seq``, ``lval``, sizes, least and most liveness, tcn, cardinality, labels, and the sorted ``labels``.

    rows: bytes with labels. Extents of size_min to size_max bytes are reported, so a row's labels are bounded by size_max times max_card.
    """
    key = ["trace_id", "seq", "lval"]
    each = rows.select(*key, "inputfile", "offset", "tcn", F.size("labels").alias("card"), F.explode("labels").alias("label"))
    live = each.join(snapshot, ["inputfile", "label"], "left").withColumn("liveness", F.coalesce("death_instr", F.lit(0)))
    ends = [f(c).cast("long").alias(f"{name}_{c}") for c in ("liveness", "tcn", "card", "label") for name, f in (("min", F.min), ("max", F.max))]
    grouped = live.groupBy(*key, "inputfile").agg(F.countDistinct("offset").alias("size"), F.sort_array(F.collect_set(F.col("label").cast("long"))).alias("labels"), *ends)
    return grouped.where(F.col("size").between(size_min, size_max) & (F.col("max_liveness") <= max_liveness) & (F.col("max_tcn") <= max_tcn) & (F.col("max_card") <= max_card))


def extent_bytes(extents: DataFrame, corpus: DataFrame) -> DataFrame:
    """Adds ``file_bytes`` (hex): the input's byte at each of the extent's labels, in the order of these; labels beyond the input give none. corpus: ``inputfile``, ``content``."""
    at = F.transform("labels", lambda x: F.hex(F.substring(F.col("content"), x.cast("int") + 1, F.lit(1))))
    return extents.join(corpus, "inputfile").withColumn("file_bytes", F.array_join(at, "")).drop("content")


def mining_counters(log: DataFrame, period: int = 10_000) -> DataFrame:
    """Per ``period`` entries of a trace: running ``entries``, ``real`` and ``fake`` counts. log: ``trace_id``, ``seq``, ``real``, ``fake`` (0 or 1)."""
    per = log.groupBy("trace_id", F.floor(F.col("seq") / period).alias("period")).agg(F.count("*").alias("entries"), F.sum("real").alias("real"), F.sum("fake").alias("fake"))
    so_far = Window.partitionBy("trace_id").orderBy("period").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return per.select("trace_id", "period", *(F.sum(c).over(so_far).cast("long").alias(c) for c in ("entries", "real", "fake")))


def curtail(log: DataFrame, real: DataFrame, n: int) -> DataFrame:
    """The entries of each trace up to the one at which it has more than n real DUAs (``trace_id``, ``seq``)."""
    ranked = sum_so_far(real.select("trace_id", "seq"), ["trace_id"], "seq", F.lit(1), "__before")
    stop = ranked.where(F.col("__before") == n).select("trace_id", F.col("seq").alias("__stop"))
    return log.join(stop, "trace_id", "left").where("__stop IS NULL OR seq <= __stop").drop("__stop")

