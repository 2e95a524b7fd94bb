"""Exact dedup by skew-safe combining, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemine.llm.common import cut, empty_if_null, per_salt, salt, salts_of


def _combined(docs: DataFrame, digest) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """The rows with their digests and salts; a row per digest; a row per text of the digests that several texts share, if there are any.

    Full texts are compared at each of three stages, all of which group by the text itself beside its digest: inside each map
    task (the partial aggregate), per salted digest (a hot text meets in SALTS tasks), and over the salts' winners, of which
    a text has SALTS at most. ``salts`` says which salts a digest has rows in.
    """
    rows = docs.select("doc_id", empty_if_null("text").alias("text")).withColumns({"digest": digest(F.col("text")), "salt": salt("doc_id")})
    salted = rows.groupBy("digest", "salt", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))
    texts = salted.groupBy("digest", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("n"), salts_of(F.col("salt")).alias("salts"))
    by_digest = cut(texts.groupBy("digest").agg(F.count("*").alias("texts"), F.max("keep_id").alias("keep_id"), F.sum("n").alias("n"), F.bit_or("salts").alias("salts")))
    shared = by_digest.where("texts > 1").select("digest")
    return rows, by_digest.where("texts = 1").drop("texts"), None if shared.isEmpty() else texts.join(shared, "digest", "left_semi")


def exact_groups(docs: DataFrame, digest=lambda text: F.sha2(text, 256)) -> DataFrame:
    """One row per document: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when they are identical; null counts as empty. Of equal texts the row with the largest doc_id stays. Rows
    that repeat both doc_id and text are each counted, and each is marked kept if its doc_id is the group's. A null doc_id is
    smaller than any other. Other columns are ignored. An empty table gives an empty result. ``digest`` may be any function of
    the text: where different texts share a digest, rows are matched by their full texts again. Rows find their winner by digest
    and salt, so those of a hot text are dealt over SALTS tasks on the way back too.
    """
    rows, by_digest, shared = _combined(docs, digest)
    out = rows.select("doc_id", "digest", "salt", F.sha2("text", 256).alias("text_sha256")).join(per_salt(by_digest), ["digest", "salt"]).drop("digest", "salt")
    if shared is not None:
        out = out.unionByName(rows.join(per_salt(shared), ["digest", "salt", "text"]).select("doc_id", F.sha2("text", 256).alias("text_sha256"), "keep_id", "n"))
    return out.select("doc_id", "keep_id", F.col("n").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each text the one with the largest doc_id.

    Where that row itself is repeated, one of the repeats stays. Null text counts as empty and null doc_id as the smallest.
    """
    none = F.lit(-(1 << 63))
    _, by_digest, shared = _combined(docs, lambda text: F.sha2(text, 256))
    stay = by_digest.select("digest", "keep_id") if shared is None else by_digest.select("digest", "keep_id").unionByName(shared.select("digest", "keep_id"))
    stay = stay.select(F.col("digest").alias("__digest"), F.coalesce("keep_id", none).alias("__id"))
    keyed = docs.withColumns({"__digest": F.sha2(empty_if_null("text"), 256), "__id": F.coalesce("doc_id", none)})
    return keyed.join(stay, ["__digest", "__id"], "left_semi").dropDuplicates(["__digest", "__id"]).drop("__digest", "__id")
