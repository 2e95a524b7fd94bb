"""URL filters: rules on hosts and paths, and link-graph propagation of trust and distrust for what no rule fits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemine.llm.common import cut, per_salt, salt, salts_of

#: The rules as (verdict, host, path).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: A host is a seed if rules decide this share of its pages, all the same way.
SEED_SHARE = 0.5
#: Share of mass that follows links, and how far a host's distrust must exceed its trust, in shares of a mean seed's mass.
DAMPING, THRESHOLD = 0.85, 0.1
#: What all further rounds together may still add to the scores of all hosts together.
TOLERANCE = 1e-6
#: Rounds between checkpoints, at which the mass left is looked at.
CUT_EVERY = 5
#: Scores of so many hosts share a task.
HOSTS_PER_TASK = 50_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed pattern: the host of an absolute link in a page.
LINK = r"""(?i)href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""


def host_of(url):
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; empty for null and for urls without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url):
    """After the host up to ``?``, ``#`` or the end; empty for null and for urls without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host, path, rules: Sequence[tuple[str, str, str]] = RULES):
    """Struct (``verdict``, ``rule``) of the longest rule (host and path, as written) that fits; null if none does. Of equally long ones a blocking one wins, then the first by code point."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block", r[1] + r[2]), reverse=True):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """``src``, ``dst``, ``weight``: links between the hosts of pages (``host``, ``html``), and from each host to its parent domain and back (weight 1)."""
    linked = pages.select("host", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)))).alias("dst"))
    links = linked.select(F.col("host").alias("src"), F.translate("dst", _UPPER, _LOWER).alias("dst")).where("src != '' AND dst != '' AND src != dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    hosts = pages.select("host").distinct()
    parents = hosts.select("host", F.regexp_extract("host", r"^[^.]+\.([^.]+\..+)$", 1).alias("parent")).where("parent != ''")
    both = parents.select(F.explode(F.array(F.struct(F.col("host").alias("src"), F.col("parent").alias("dst")), F.struct(F.col("parent").alias("src"), F.col("host").alias("dst")))).alias("e"))
    return links.unionByName(both.select("e.src", "e.dst", F.lit(1.0).alias("weight"))).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def propagated(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """``host``, ``trust``, ``distrust``: personalised PageRank from seeds (``host``, ``good``, ``bad``: 0 or 1), for distrust along reversed edges.

    Mass starts at 1 per seed, so that a host's score does not depend on how many hosts there are; mass of hosts without edges is lost.
    Each round moves the mass that the round before has brought: a join on edges and a sum by host, which Spark combines before the shuffle.
    Rounds end when all that could still follow is below the tolerance, so chains and cycles of any length get their converged scores;
    a round keeps the share ``damping`` of the mass at most, so their number grows with the logarithm of the number of seeds.
    """
    both = edges.select("src", "dst", "weight", F.lit("trust").alias("kind")).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight", F.lit("distrust").alias("kind")))
    degrees = both.groupBy("kind", "src").agg(F.sum("weight").alias("degree"))
    steps = cut(both.join(degrees, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", (F.col("weight") / F.col("degree") * damping).alias("share")))
    start = cut(
        seeds.select("host", F.explode(F.array(F.struct(F.lit("trust").alias("kind"), F.col("good").alias("mass")), F.struct(F.lit("distrust").alias("kind"), F.col("bad").alias("mass")))).alias("s"))
        .select("host", "s.kind", (F.col("s.mass") * (1 - damping)).alias("mass")).where("mass > 0")
    )
    # an edge to itself keeps what a host has got, so a round reads the scores once and plans grow by one join a round
    known = cut(steps.select("kind", "host").unionByName(steps.select("kind", F.col("dst").alias("host"))).unionByName(start.select("kind", "host")).distinct())
    steps = cut(steps.unionByName(known.select("kind", "host", F.col("host").alias("dst"), F.lit(None).cast("double").alias("share"))))
    # scores of few hosts are kept in few partitions: a round's shuffle writes files for each of them
    tasks = 1 + known.count() // HOSTS_PER_TASK
    few = lambda df: df.coalesce(tasks) if tasks < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df
    now = few(start.withColumn("left", F.col("mass")))
    while (now.agg(F.sum("left")).first()[0] or 0.0) / (1 - damping) * damping / (1 - damping) > tolerance:
        for _ in range(CUT_EVERY):
            moved, stays = F.col("left") * F.col("share"), F.col("share").isNull()
            sent = now.join(steps, ["kind", "host"]).where(stays | (F.col("left") > 0))
            now = few(sent.groupBy("kind", F.col("dst").alias("host")).agg(F.sum(F.when(stays, F.col("mass")).otherwise(moved)).alias("mass"), F.sum(F.when(stays, 0.0).otherwise(moved)).alias("left")))
        now = cut(now)
    by_kind = lambda k: F.sum(F.when(F.col("kind") == k, F.col("mass")).otherwise(0.0)) / (1 - damping)
    return now.groupBy("host").agg(by_kind("trust").alias("trust"), by_kind("distrust").alias("distrust"))


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, threshold: float = THRESHOLD, seed_share: float = SEED_SHARE) -> DataFrame:
    """One row per page: ``page_id``, ``host``, ``path``, ``rule``, ``verdict``, ``trust``, ``distrust`` (its host's scores).

    The longest rule that fits decides. Where none does, the host's scores do: it is blocked if its distrust exceeds its trust by more
    than the threshold. Seeds are hosts of which rules allow (trusted) or block (blocked) at least ``seed_share`` of the pages. Edges are the
    absolute links in ``html`` and the steps between a host and its parent domain. Null urls, and urls without ``://``, have an empty host
    and path, no rule and no scores, so they are allowed. Null html has no links. Repeated rows are kept, and each counts towards its host's share; other columns are ignored; an empty table gives an empty result.
    """
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    ruled = parts.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    is_kind = lambda v: F.avg((F.coalesce("fit.verdict", F.lit("")) == v).cast("double"))
    ruled = ruled.withColumn("salt", salt("page_id"))
    shares = ruled.where("host != ''").groupBy("host").agg(is_kind("allow").alias("good"), is_kind("block").alias("bad"), salts_of(F.col("salt")).alias("salts"))
    seeds = shares.select("host", *((F.col(k) >= seed_share).cast("double").alias(k) for k in ("good", "bad")))
    scores = propagated(host_edges(parts.select("host", "html")), seeds)
    # pages of a hot host are dealt over several tasks; those without a host have no scores
    salted = per_salt(scores.join(shares.select("host", "salts"), "host"))
    known = ruled.where("host != ''").select("page_id", "host", "path", "fit", "salt").join(salted, ["host", "salt"], "left").drop("salt")
    judged = known.unionByName(ruled.where("host = ''").select("page_id", "host", "path", "fit"), allowMissingColumns=True)
    score = lambda k: F.round(F.coalesce(k, F.lit(0.0)), 9).alias(k)
    out = judged.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("by_rule"), score("trust"), score("distrust"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("distrust") - F.col("trust") > threshold, "block").otherwise("allow")).alias("verdict"), "trust", "distrust")
