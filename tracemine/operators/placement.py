"""Planning of where bugs go: places, slots, roles of functions, solutions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemine.operators.ordered import greatest_before, least_after, shared_folder
from tracemine.sources.logs import numbered

_MOD = 1 << 32
#: Consecutive ids that may share a row.
CHUNK = 10_000


def bugs_by_location(bugs: DataFrame, atps: DataFrame) -> DataFrame:
    """``loc``, ``atp_type``, ``chunk``, ``bugs``: the sorted bugs of each place and kind of point, in chunks of ``CHUNK`` ids, so that no row grows with the table.

    Chunk k holds the bugs whose id is from k * CHUNK to (k + 1) * CHUNK - 1.
    """
    placed = bugs.join(atps.select("atp", "loc", F.col("type").alias("atp_type")), "atp")
    return placed.groupBy("loc", "atp_type", F.floor(F.col("bug") / CHUNK).alias("chunk")).agg(F.array_sort(F.collect_list("bug")).alias("bugs"))


def siphon_slots(bugs: DataFrame, dua_bytes: DataFrame, duas: DataFrame, traces: DataFrame) -> DataFrame:
    """``list``, ``lval``, ``low``, ``high``, ``loc``, ``slot``: where the values that bugs use are read, and the slot that each is kept in.

    Triggers and extras have a list of slots each (``trigger``, ``extra``), with dense ids in the order of the first bug, and of the place in its extras, that uses the value; extras of bugs
    of unused stacks do not count. A value is read at the place of the source trace's step at which its DUA was seen, so one that several DUAs give is read
    at several places but has one slot. Values whose step is not in traces (``index``, ``loc``) are not placed. Slots are numbered over range partitions.
    """
    uses = bugs.select(F.lit("trigger").alias("list"), "bug", F.lit(0).alias("pos"), F.col("trigger").alias("dua_bytes"))
    uses = uses.unionByName(bugs.where("kind <> 5").select(F.lit("extra").alias("list"), "bug", F.posexplode("extra_duas").alias("pos", "dua_bytes")))
    value = ["list", "lval", "low", "high"]
    full = uses.join(dua_bytes, "dua_bytes").join(duas.select("dua", "lval", F.col("trace_index").alias("index")), "dua").join(traces.select("index", "loc"), "index")
    shared_folder(bugs.sparkSession)
    reads = full.groupBy(*value, "loc").agg(F.min(F.struct("bug", "pos")).alias("first")).checkpoint()  # used by both lists and by the result
    firsts = reads.groupBy(*value).agg(F.min("first").alias("first")).select(*value, "first.bug", "first.pos")
    order = ["bug", "pos", "lval", "low", "high"]
    slots = numbered(firsts.where("list = 'trigger'"), order, "slot").unionByName(numbered(firsts.where("list = 'extra'"), order, "slot"))
    return reads.select(*value, "loc").join(slots.select(*value, "slot"), value)


def _draw(seed, salt: str, key, n):
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(salt), F.col(key).cast("string"))), 1, 8), 16, 10).cast("bigint") % n


def overconstraint_points(bugs: DataFrame, traces: DataFrame, seed: int = 0) -> DataFrame:
    """``bug``, ``first_index``, ``first_loc``, ``second_index``, ``second_loc``: two steps between the extra DUA's and the point's (``a``, ``b``; swapped if reversed), the second after the first.

    Bugs with fewer than two steps between are dropped.
    """
    ends = bugs.select("bug", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where("hi - lo >= 2")
    first = ends.withColumn("first_index", F.col("lo") + _draw(seed, "first", "bug", F.col("hi") - F.col("lo") - 1))
    both = first.withColumn("second_index", F.col("first_index") + 1 + _draw(seed, "second", "bug", F.col("hi") - F.col("first_index") - 1))
    named = lambda k: traces.select(F.col("index").alias(f"{k}_index"), F.col("loc").alias(f"{k}_loc"))
    return both.join(named("first"), "first_index").join(named("second"), "second_index").select("bug", "first_index", "first_loc", "second_index", "second_loc")


def unplaced(wanted: DataFrame, placed: DataFrame, keys: list[str]) -> DataFrame:
    """What was wanted at places that were never reached."""
    return wanted.join(placed.select(*keys), keys, "left_anti")


def dataflow_roles(bugs: DataFrame, calltraces: DataFrame, defined: DataFrame, assigned: DataFrame, calls: DataFrame) -> DataFrame:
    """Distinct ``function``, ``role`` for bugs of unused stacks, from their call traces (``bug``, ``pos``, ``function``: the innermost has the largest pos).

    From the innermost frame outwards, functions are good while they are defined (``function``) and never assigned to a pointer (``function``). The first bad frame
    stops: it is a root only if it is the innermost. Of the good ones the innermost gets ``addvar``, the last is a ``root``, the others are ``df``. A bug without frames takes main as both
    root and addvar. All callers (calls: ``callee``, ``caller``) of a df function are roots too.
    """
    frames = bugs.where("kind = 5").select("bug").join(calltraces, "bug", "left").withColumn("function", F.coalesce("function", F.lit("main")))
    own = Window.partitionBy("bug")
    inward = frames.withColumn("depth", F.row_number().over(own.orderBy(F.desc("pos"))) - 1)
    good = defined.select("function").distinct().join(assigned.select("function"), "function", "left_anti").withColumn("good", F.lit(True))
    judged = inward.join(good, "function", "left").withColumn("good", F.coalesce("good", F.col("pos").isNull()))
    stop = judged.withColumns({"stop": F.min(F.when(~F.col("good"), F.col("depth"))).over(own), "n": F.count("*").over(own)}).withColumn("last", F.coalesce("stop", "n") - 1)
    addvar = stop.where("depth = 0 AND good").select("function", F.lit("addvar").alias("role"))
    root = stop.where("depth = last OR (depth = 0 AND stop = 0)").select("function", F.lit("root").alias("role"))
    df = stop.where("depth < last").select("function", F.lit("df").alias("role"))
    callers = df.select(F.col("function").alias("callee")).distinct().join(calls, "callee").select(F.col("caller").alias("function"), F.lit("root").alias("role"))
    return addvar.unionByName(root).unionByName(df).unionByName(callers).distinct()


def stack_var_functions(bugs: DataFrame, calltraces: DataFrame) -> DataFrame:
    """Distinct ``function``, ``role`` addvar for bugs with a constant on the stack: the innermost function, or main."""
    inner = calltraces.groupBy("bug").agg(F.max_by("function", "pos").alias("function"))
    return bugs.where("kind = 6").select("bug").join(inner, "bug", "left").select(F.coalesce("function", F.lit("main")).alias("function"), F.lit("addvar").alias("role")).distinct()


def _letters(seed, salt: str, key):
    """Four bytes of 0-9A-Za-z as a number."""
    alphabet = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    out = F.lit(0).cast("bigint")
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(salt), F.col(key).cast("string")))
    for i in range(4):
        at = F.conv(F.substring(h, 1 + 2 * i, 2), 16, 10).cast("int") % len(alphabet)
        out = out * 256 + F.ascii(F.substring(F.lit(alphabet), at + 1, F.lit(1)))
    return out


def multi_dua_solutions(bugs: DataFrame, seed: int = 0) -> DataFrame:
    """``bug``, ``a``, ``b``, ``c`` (four letters or digits each) and ``magic``, modulo 2**32: by the bug's magic modulo 3 it is (a + b) c, a b - c or (a + 2)(b + 1)(c + 3)."""
    rows = bugs.select("bug", (F.col("magic") % 3).alias("form"), *(_letters(seed, k, "bug").alias(k) for k in "abc"))
    a, b, c = (F.col(k).cast("decimal(12,0)") for k in "abc")
    one, two = (a + b) * c, a * b - c
    low = lambda x: F.pmod(x.cast("decimal(38,0)"), F.lit(_MOD).cast("decimal(38,0)"))
    three = low((a + 2) * (b + 1)).cast("decimal(12,0)") * (c + 3)
    value = F.when(F.col("form") == 0, low(one)).when(F.col("form") == 1, low(two)).otherwise(low(three))
    return rows.select("bug", "form", "a", "b", "c", value.cast("bigint").alias("magic"))


def parse_solutions(lines: DataFrame) -> DataFrame:
    """``bug`` and ``values`` (in order) of lines ``SOL 0x<id> == ... 0x<value> ...``; other lines are ignored."""
    hexes = F.regexp_extract_all("value", F.lit("0x([0-9a-fA-F]+)"), F.lit(1))
    numbers = F.transform(hexes, lambda h: F.conv(h, 16, 10).cast("bigint"))
    return lines.where(F.col("value").rlike(r"^SOL 0x[0-9a-fA-F]+ ==")).select(F.get(numbers, F.lit(0)).alias("bug"), F.slice(numbers, F.lit(2), F.greatest(F.lit(0), F.size(numbers) - 1)).alias("values"))


def locate_trigger_line(bugs: DataFrame, lines: DataFrame) -> DataFrame:
    """``bug``, ``found_line``: of the lines (``file``, ``line``, ``text``) of its file that contain ``(0x<magic>`` the nearest to its old line; of two the first. Bugs without one have null.

    What a line holds after each ``(0x``, cut at every length that a magic value can have, is put in order with the lines that bugs ask for, each of these once; ordered passes give the matching line before and the one after, so neither many bugs nor many lines of a value multiply.
    """
    digits = F.explode(F.regexp_extract_all("text", F.lit("\\(0x([0-9a-f]{1,16})"), F.lit(1)))
    cuts = lines.select("file", F.col("line").alias("at"), digits.alias("digits")).withColumn("size", F.explode(F.sequence(F.lit(1), F.length("digits"))))
    values = cuts.select("file", "at", F.left("digits", F.col("size")).alias("hex")).distinct()
    asked = bugs.select("bug", "file", "line", F.lower(F.hex("magic")).alias("hex")).withColumn("order", F.coalesce(F.col("line").cast("long") * 2 + 1, F.lit(-(1 << 62))))
    places = asked.where("hex IS NOT NULL").select("file", "hex", "order").distinct()
    marked = places.unionByName(values.withColumn("order", F.col("at").cast("long") * 2), allowMissingColumns=True)
    before = greatest_before(marked, ["file", "hex"], "order", "at", "before")
    both = least_after(before, ["file", "hex"], "order", "at", "after").where("at IS NULL").select("file", "hex", "order", F.explode(F.filter(F.array("before", "after"), lambda x: x.isNotNull())).alias("at"))
    hits = asked.join(both, ["file", "hex", "order"])
    nearest = hits.groupBy("bug").agg(F.min_by("at", F.struct(F.abs(F.col("at") - F.col("line")), F.col("at"))).alias("found_line"))
    return bugs.select("bug").join(nearest, "bug", "left")
