"""I-Match document fingerprints, in DataFrame operations only."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemine.llm.common import cut, empty_if_null

#: The band of document frequency of the terms that are kept (idf is its negative logarithm), as shares of the documents, and at least so many documents.
RAREST, COMMONEST, LEAST_DOCS = 1 / 500, 1 / 4, 2
#: Draws of lexicons, each read from four digits of a term's md5: so many have lexicons of 2**-first to 2**-last of the band. Large lexicons serve short texts only.
DRAWS = ((8, 4, 11), (2, 1, 3))
#: Hex digits of the hash of a lexicon, and of the last one, which is the whole band; what stands for no term in a lexicon.
DIGITS, WHOLE = 4, 16
NONE = "-" * DIGITS
#: The lexicons' draws and halvings, in the order of their hashes in a fingerprint.
LEXICONS = [(d, k) for n, first, last in DRAWS for k in range(last, first - 1, -1) for d in range(n)]
#: Lexicons that two fingerprints are compared by: the smallest ones in which either has a term.
COMPARED = 24
#: Terms of the band that share a list of the table they are looked up in, about.
PER_LIST = 2


def terms(text):
    """Distinct terms of a text: runs of letters and digits, lower-cased; the text's ends may add an empty one."""
    return F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+"))


def band(docs: DataFrame, rarest: float = RAREST, commonest: float = COMMONEST) -> list[str]:
    """The terms of docs' texts whose document frequency lies in the band.

    A term of the band occurs in a share ``rarest`` of the documents at least, so there are at most (mean terms per document) / rarest of them,
    however large the table: the bound that lets them go to all tasks.
    """
    n = docs.count()
    each = docs.select(F.explode(terms(empty_if_null("text"))).alias("term")).where("term != ''")
    kept = each.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df").between(max(LEAST_DOCS, rarest * n), max(LEAST_DOCS, commonest * n)))
    return sorted(kept.select("term").toArrow()["term"].to_pylist())


def _in_band(words: list[str]):
    """A test of terms: whether they are among words. Words are dealt to short lists by a hash, all in one constant array; a term is looked for in its list only."""
    lists = max(1, len(words) // PER_LIST)
    dealt: list[list[str]] = [[] for _ in range(lists)]
    for w in words:
        dealt[zlib.crc32(w.encode()) % lists].append(w)
    table = F.split(F.lit(";".join(f",{','.join(x)}," for x in dealt)), ";")  # one constant, split when the plan is optimised; terms have neither sign
    return lambda term: (term != "") & F.contains(F.get(table, (F.crc32(term) % lists).cast("int")), F.concat(F.lit(","), term, F.lit(",")))


def fingerprint(text, words: list[str]):
    """The I-Match fingerprint of a text column: a hash for each of the fixed random lexicons (LEXICONS) and the whole band, the smallest first.

    Lexicons are subsets of the band that do not depend on any text: a term is in the k-th lexicon of a draw if the draw's four md5 digits begin with k zero bits.
    A lexicon's hash is that of all the text's distinct terms in it, sorted; without any it is NONE. The last lexicon is the whole band; a text without a term of the
    band has the hash of itself there, so that only equal ones agree.
    """
    known = F.filter(terms(text), _in_band(words))
    marked = F.array_sort(F.transform(known, lambda t: F.struct(t.alias("t"), F.md5(t).alias("h"))))
    def joined(found):
        return F.md5(F.array_join(F.transform(found, lambda x: x["t"]), " "))

    def hashed(found):
        return F.when(F.size(found) == 0, NONE).otherwise(F.left(joined(found), F.lit(DIGITS)))

    def draw(rows, d: int, first: int, last: int):
        """The hashes of a draw's lexicons, the smallest first. Each lexicon is searched for in the one before, twice its size."""
        limits = F.array(*(F.lit(f"{(1 << 16 - k) - 1:04x}") for k in range(first, last + 1)))
        inside = lambda rows, k: F.filter(rows, lambda x: F.substring(x["h"], 4 * d + 1, 4) <= F.element_at(limits, k))

        def step(s, k):
            return F.struct(inside(s["rows"], k).alias("rows"), F.concat(F.array(hashed(s["rows"])), s["hashes"]).alias("hashes"))

        start = F.struct(inside(rows, F.lit(1)).alias("rows"), F.array().cast("array<string>").alias("hashes"))
        return F.aggregate(F.sequence(F.lit(2), F.lit(last - first + 1)), start, step, lambda s: F.concat(F.array(hashed(s["rows"])), s["hashes"]))

    def all_hashes(rows):
        each_of = lambda n: lambda x: F.array(*(x[f"d{d}"] for d in range(n)))
        by_size = lambda n, *sizes: F.arrays_zip(*(draw(rows, d, *sizes).alias(f"d{d}") for d in range(n)))
        parts = [F.flatten(F.transform(by_size(*x), each_of(x[0]))) for x in DRAWS]
        whole = F.left(F.when(F.size(rows) == 0, F.md5(F.concat(F.lit("text "), text))).otherwise(joined(rows)), F.lit(WHOLE))
        return F.array_join(F.concat(*parts, F.array(whole)), "")

    return F.element_at(F.transform(F.array(marked), all_hashes), 1)  # marked is made once


def likeness(a, b):
    """Of the COMPARED smallest lexicons in which either fingerprint has a hash, the share in which both have the same."""
    n = len(LEXICONS)
    cut_up = lambda x: F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: F.substring(x, i * DIGITS + 1, F.when(i == n, WHOLE).otherwise(DIGITS)))
    pairs = F.slice(F.filter(F.arrays_zip(cut_up(a).alias("a"), cut_up(b).alias("b")), lambda p: (p["a"] != NONE) | (p["b"] != NONE)), 1, COMPARED)
    same = lambda ps: F.size(F.filter(ps, lambda p: p["a"] == p["b"])) / F.size(ps)
    return F.element_at(F.transform(F.array(pairs), same), 1)


def _in_order(keys: DataFrame) -> DataFrame:
    """Adds ``next_of``, ``next_th`` to distinct keys (``of``, ``th``): the next key in order, after the last the first.

    Keys are put in order by range partitions; only each one's first key is looked at by a single task.
    """
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(keys.repartitionByRange(parts, "of", "th").withColumn("part", F.spark_partition_id()))
    firsts = placed.groupBy("part").agg(F.min(F.struct("of", "th")).alias("first"))
    everything = Window.orderBy("part")
    after = firsts.select("part", F.coalesce(F.lead("first").over(everything), F.first("first").over(everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))
    own = F.lead(F.struct("of", "th")).over(Window.partitionBy("part").orderBy("of", "th"))
    linked = placed.withColumn("next", own).join(after, "part").withColumn("next", F.coalesce("next", "after"))
    return linked.select("of", "th", "n_chars", F.col("next.of").alias("next_of"), F.col("next.th").alias("next_th"))


def imatch(docs: DataFrame, rarest: float = RAREST, commonest: float = COMMONEST) -> DataFrame:
    """One row per document: ``doc_id``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next``.

    The edited text has the last quarter of the code points (rounded down) replaced by as many first ones, or all, of the next document by
    doc_id; after the last comes the first. Null text counts as empty. Null doc_ids come first; documents with the same doc_id follow
    each other by a hash of their texts, and rows that repeat both are one document in the order but each have a row. Other columns are
    ignored. near_edited and near_next are the likeness of the fingerprint to the edited text's and to the next document's.
    """
    words = band(docs, rarest, commonest)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # fixed, as work per row is large
    rows = docs.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("of"), empty_if_null("text").alias("text")).withColumn("th", F.xxhash64("text"))
    keys = rows.select("of", "th", F.length("text").cast("long").alias("n_chars"))
    order = cut(_in_order(keys.distinct()))
    texts = rows.select("of", "th", "text")
    wanted = order.select(F.col("of").alias("to_of"), F.col("th").alias("to_th"), F.floor(F.col("n_chars") / 4).cast("int").alias("m"), F.col("next_of").alias("of"), F.col("next_th").alias("th"))
    heads = texts.repartition(parts, "of", "th").join(wanted, ["of", "th"]).select(F.col("to_of").alias("of"), F.col("to_th").alias("th"), "m", F.substring("text", F.lit(1), F.col("m")).alias("head")).repartition(parts, "of", "th").distinct()
    both = texts.repartition(parts, "of", "th").join(heads, ["of", "th"]).select("of", "th", "text", F.concat(F.substring("text", F.lit(1), F.length("text") - F.col("m")), "head").alias("edited"))
    printed = both.select("of", "th", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("text"), words).alias("fingerprint"), fingerprint(F.col("edited"), words).alias("edited_fingerprint"))
    own = cut(printed.distinct())
    nexts = own.select(F.col("of").alias("next_of"), F.col("th").alias("next_th"), F.col("fingerprint").alias("next_fingerprint"))
    judged = order.join(own, ["of", "th"]).join(nexts, ["next_of", "next_th"])
    judged = judged.select("of", "th", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
    return rows.select("doc_id", "of", "th").join(judged, ["of", "th"]).drop("of", "th")
