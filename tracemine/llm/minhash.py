"""Near-dedup by MinHash: one-permutation hashing with optimal densification, banded buckets, star-shaped candidate edges."""

from __future__ import annotations

from functools import cache

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemine.llm.common import per_salt, salt, salts_of
from tracemine.llm.neargroups import PERCENT, SHINGLE, labelled

#: Bins of a band, and bands. A link at 0.8 shares none of the bands with a probability of 5 in ten million.
BAND, BANDS = 6, 48
BINS = BAND * BANDS
#: Pairs of a bucket whose shares of equal bins are so much below the least similarity are not compared: it is five standard deviations or more.
SLACK = 0.15


@cache
def _donors() -> np.ndarray:
    """For each bin the place of every other in the order in which it is asked when the bin is empty: a random permutation of its own, the same for all texts."""
    draws = np.array([xxhash.xxh64_intdigest(f"{i} {j}".encode(), 7) for i in range(BINS) for j in range(BINS)], dtype=np.uint64)
    return draws.reshape(BINS, BINS).argsort(axis=1).argsort(axis=1).astype(np.uint16)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The least hash of each of BINS ranges of hashes, as 16 bits. An empty bin takes the value of the first bin in its own order that is not, so equal shares stay the similarity however few hashes there are."""
    bins = ((hashes >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)
    first = np.flatnonzero(np.concatenate(([True], bins[1:] != bins[:-1])))
    filled = bins[first].astype(np.int64)
    out = np.zeros(BINS, np.uint16)
    out[filled] = (hashes[first] & np.uint64(0xFFFF)).astype(np.uint16)
    if len(filled) < BINS:
        empty = np.setdiff1d(np.arange(BINS), filled)
        out[empty] = out[filled[_donors()[empty][:, filled].argmin(axis=1)]]
    return out


class Bands:
    """Signatures of BINS bins; the bins of a band are a key."""

    prunes = False

    def sign(self, hashes: np.ndarray) -> bytes:
        return signature(hashes).tobytes()

    def keyed(self, nodes: DataFrame) -> DataFrame:
        width = 2 * BAND
        keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring(F.col("signature"), i * width + 1, F.lit(width))))
        return nodes.select("node", F.posexplode(keys).alias("band", "key"))

    def read(self, signatures: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(signatures), np.uint16).reshape(-1, BINS)

    def near(self, prints: np.ndarray, at: int, others: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        same = prints[others] == prints[at]
        equal = same.sum(axis=1)
        hits = np.flatnonzero(equal >= round(BINS * (percent / 100 - SLACK)))
        return others[hits], equal[hits], same[hits].reshape(-1, BANDS, BAND).all(axis=2).argmax(axis=1)


def near_groups(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles``, ``component_id`` (the smallest doc_id that links reach, its own included), ``kept`` (doc_id = component_id).

    A-Z are lower-cased; words are ``[^\\x20\\x09-\\x0D]+`` of the whole text; the set has the distinct shingles of ``size`` words, or the whole sequence where words are fewer.
    Texts link if 100 times the intersection is ``percent`` times the union at least (the bands are made for 80 or more); every link is confirmed on full sets. Null, empty and blank texts have an empty
    set and link with nothing. Texts of equal words are one node. Candidates are the stars of the bands' buckets; where a bucket is not one component after that, members
    outside its largest one propose their likeliest partners by signature, and then all that may be links. So pairs of a group that is connected are never listed,
    and links between different texts are missed only with the bands' probability. Repeated rows are kept; rows with a null doc_id take part, and a component's id is null only if no
    row of it has one. Other columns are ignored; an empty table gives an empty result.
    """
    rows, nodes, labels = labelled(docs, size, percent, Bands())
    salted = rows.withColumn("salt", salt("doc_id"))
    placed = nodes.join(labels, "node", "left").select("digest", "id", "salts", F.coalesce("component", "node").alias("root"), salt("node").alias("of_root"))
    roots = per_salt(placed.groupBy("root").agg(F.min("id").alias("component_id"), salts_of(F.col("of_root")).alias("all")), "all", "of_root")
    named = per_salt(placed.join(roots, ["root", "of_root"]).select("digest", "salts", "component_id"))
    found = salted.where("n_shingles > 0").join(named, ["digest", "salt"]).select("doc_id", "n_shingles", "component_id")
    whole = found.unionByName(salted.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return whole.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
