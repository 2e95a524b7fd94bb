"""The sequential rule by which DUAs are born, replaced and die, over state that may be kept anywhere; and the parts of a trace that do not touch each other."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemine.operators.ordered import shared_folder, written


class Lives:
    """One trace, entry by entry. ``live``: how many branches each label has decided; ``alive``: each lvalue's DUA as (seq, fake, nodua, labels by byte); ``holders``: the lvalues that are looked at when a label is touched.

    A query is a DUA if it is fake, or has n tainted bytes, viable bytes and labels at least and n consecutive bytes that are not too live. Only a DUA replaces the live one of its lvalue.
    A branch that touches a label of a DUA ends it if it has no such bytes left, or if it is marked nodua; fake ones are only replaced. With erase_siblings
    a death takes the DUA's labels off the index, so that siblings are not looked at again through them.
    """

    def __init__(self, max_liveness: int, n: int, erase_siblings: bool, live, alive, holders):
        self.max_liveness, self.n, self.erase_siblings = max_liveness, n, erase_siblings
        self.live, self.alive, self.holders = live, alive, holders

    def usable(self, labels: list) -> bool:
        ok = [b is not None and all(self.live.get(x, 0) <= self.max_liveness for x in b) for b in labels]
        return any(all(ok[i : i + self.n]) for i in range(len(ok) - self.n + 1))

    def query(self, seq: int, lval: str, labels: list, num_tainted: int | None = None, fake: bool = False, nodua: bool = False) -> list[tuple[str, int, str]]:
        """What happens, as (lvalue, seq of its DUA, born or replaced)."""
        viable = [b for b in labels if b is not None]
        tainted = len(viable) if num_tainted is None else num_tainted
        if not fake and (min(tainted, len(viable), len({x for b in viable for x in b})) < self.n or not self.usable(labels)):
            return []
        out = []
        old = self.alive.get(lval)
        if old is not None:
            out.append((lval, old[0], "replaced"))
            self._let_go(lval, old[3])
        self.alive[lval] = (seq, fake, nodua, labels)
        if not fake:
            for x in {x for b in viable for x in b}:
                self.holders[x] = {*self.holders.get(x, ()), lval}
        return [*out, (lval, seq, "born")]

    def branch(self, touched: Iterable[int]) -> list[tuple[str, int, str]]:
        """What dies, as (lvalue, seq of its DUA, died)."""
        touched = set(touched)
        for x in touched:
            self.live[x] = self.live.get(x, 0) + 1
        out = []
        for lval in sorted({v for x in touched for v in self.holders.get(x, ())}):
            own = self.alive.get(lval)
            if own is None or not (own[2] or not self.usable(own[3])):
                continue
            self.alive.pop(lval, None)
            out.append((lval, own[0], "died"))
            if self.erase_siblings:
                for x in {x for b in own[3] for x in b or ()}:
                    self.holders.pop(x, None)
            else:
                self._let_go(lval, own[3])
        return out

    def _let_go(self, lval: str, labels: list) -> None:
        for x in {x for b in labels for x in b or ()}:
            left = set(self.holders.get(x, ())) - {lval}
            if left:
                self.holders[x] = left
            else:
                self.holders.pop(x, None)


def plain(labels) -> list:
    """Labels by byte as lists of whole numbers."""
    return [None if b is None else [int(x) for x in b] for b in labels]


def given(row, name: str, default=None):
    """A column that rows may lack, and that may be null."""
    value = getattr(row, name, default)
    return default if value is None or value != value else value


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``component`` (the least node reachable) of every node of edges (``u``, ``v``, of any type with an order) that is not the least itself, by alternating large and small stars; each round is cut by a checkpoint."""
    shared_folder(edges.sparkSession)
    now, before = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint(), None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        ends = F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u").select(ends.alias("e")).select("e.u", "e.v")
        now = small.where("u <> v").distinct().checkpoint()


def with_shards(events: DataFrame) -> DataFrame:
    """events (``trace_id``, ``seq``, ``lval``, null for a branch, ``labels`` by byte) with ``shard``: lvalues that share a label, directly or through others, are in one shard of their trace.

    A branch comes once to each shard that has a label of it, with those labels only; so shards can be replayed apart. Lvalues without labels are shards of their own.
    """
    events = written(events)
    each = F.explode(F.array_distinct(F.flatten(F.filter("labels", lambda b: b.isNotNull())))).alias("label")
    own = events.where("lval IS NOT NULL").select("trace_id", "lval", each).distinct()
    least = own.groupBy("trace_id", "lval").agg(F.min("label").alias("least"))
    node = lambda label: F.struct("trace_id", F.col(label).alias("label"))
    roots = components(own.join(least, ["trace_id", "lval"]).select(node("label").alias("u"), node("least").alias("v")).distinct())
    roots = roots.select("node.trace_id", "node.label", F.col("component.label").alias("root"))
    of_label = own.select("trace_id", "label").distinct().join(roots, ["trace_id", "label"], "left").select("trace_id", "label", F.concat(F.lit("label "), F.coalesce("root", "label").cast("string")).alias("shard")).checkpoint()
    of_lval = least.select("trace_id", "lval", F.col("least").alias("label")).join(of_label, ["trace_id", "label"]).select("trace_id", "lval", "shard")
    queries = events.where("lval IS NOT NULL").join(of_lval, ["trace_id", "lval"], "left").withColumn("shard", F.coalesce("shard", F.concat(F.lit("lvalue "), "lval")))
    touched = events.where("lval IS NULL").select("trace_id", "seq", each).join(of_label, ["trace_id", "label"])
    dealt = touched.groupBy("trace_id", "seq", "shard").agg(F.array(F.sort_array(F.collect_set("label"))).alias("labels")).withColumn("lval", F.lit(None).cast("string"))
    return queries.unionByName(dealt, allowMissingColumns=True)


def shard_sizes(events: DataFrame) -> DataFrame:
    """``trace_id``, ``shard``, ``lvals``, ``entries``: how a trace falls apart, and so what one task of an exact replay has to take."""
    return with_shards(events).groupBy("trace_id", "shard").agg(F.countDistinct("lval").alias("lvals"), F.count("*").alias("entries"))
