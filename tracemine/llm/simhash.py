"""SimHash fingerprints and near-dedup with pigeonring filtering."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from tracemine.llm.common import components, cut, empty_if_null, per_salt, salt, salts_of, signed
from tracemine.llm.neargroups import PERCENT, labelled, normal
from tracemine.llm.neargroups import SHINGLE as SHINGLES

SHINGLE, SEED, DISTANCE = 4, 42, 4
#: Distinct fingerprints up to which rings of so many segments are used: about as many as the values of a bucket's key, so buckets stay small.
RINGS = ((1 << 23, 6), (1 << 28, 7), (1 << 63, 8))
#: Fingerprints of a bucket that one task compares; larger buckets are cut into tiles, all pairs of which are compared.
TILE = 4096


class Ring:
    """64 bits as a ring of segments, from the highest bit down. In fingerprints that differ in DISTANCE bits or fewer, at least n - DISTANCE of n segments are
    equal, so an equi-join on each group of so many segments finds all links, whatever n is; with more segments keys are longer and there are more groups."""

    def __init__(self, n: int):
        widths = [64 // n + (i < 64 % n) for i in range(n)]
        shifts = [64 - sum(widths[: i + 1]) for i in range(n)]
        self.masks = [((1 << w) - 1) << k for w, k in zip(widths, shifts, strict=True)]
        self.groups = list(itertools.combinations(range(n), n - DISTANCE))
        #: The most that the first l segments of a viable chain may differ by: its share of the distance.
        self.budgets = [DISTANCE * k // n for k in range(1, n + 1)]
        self._masks = np.array(self.masks, dtype=np.uint64)

    def viable(self, diff: np.ndarray, start: int) -> np.ndarray:
        """Indices of the XORs whose chain of segments from start on stays within its budget at each length."""
        at, total = np.arange(len(diff)), np.zeros(len(diff), np.int64)
        for n, most in enumerate(self.budgets):
            total = total + np.bitwise_count(diff[at] & self._masks[(start + n) % len(self.masks)])
            keep = total <= most
            at, total = at[keep], total[keep]
            if not len(at):
                break
        return at

    def linked(self, diff: np.ndarray, group: int) -> np.ndarray:
        """Which of the XORs of a bucket's fingerprints are links: some chain from one of the bucket's equal segments is viable, and the whole distance is small enough."""
        found = np.zeros(len(diff), bool)
        for start in self.groups[group]:
            found[self.viable(diff, start)] = True
        at = np.flatnonzero(found)
        found[at] = np.bitwise_count(diff[at]) <= DISTANCE
        return found


def fingerprint(text: str | bytes) -> bytes:
    """The 64-bit SimHash, as 8 bytes with the highest bit first, of a text's word shingles."""
    parts = (text.encode() if isinstance(text, str) else text).lower().split()  # bytes: A-Z and ASCII white space only
    if not parts:
        return bytes(8)
    joined, digest = b" ".join(parts), xxhash.xxh64_digest
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    stops = ends[SHINGLE - 1 :].tolist() or [len(joined)]
    hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=False)])
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
    return np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(bits)).tobytes()


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        prints = b"".join([fingerprint(t.as_py()) for t in b.column("text")])
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.frombuffer(prints, ">u8").astype(np.uint64).view(np.int64))], names=["doc_id", "bits"])


def simhash(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the 64 ``bits`` (long) of each row's whole text; null counts as empty, and an empty text has no bit set."""
    return docs.select("doc_id", empty_if_null("text").alias("text")).mapInArrow(_fingerprints, "doc_id long, bits long")


def _forest(ring: Ring, bits: np.ndarray, group: int) -> Iterator[tuple[int, int]]:
    """For each connected group of a bucket, edges to one of it. Fingerprints that are already reached are not compared again."""
    left = np.arange(len(bits))
    while len(left) > 1:
        root, reached, left = left[0], [left[0]], left[1:]
        while reached and len(left):
            hit = ring.linked(bits[left] ^ bits[reached.pop()], group)
            new, left = left[hit], left[~hit]
            reached += new.tolist()
            yield from ((x, root) for x in new)


def _links(batches: Iterator[pa.RecordBatch], ring: Ring) -> Iterator[pa.RecordBatch]:
    """Rows (group, key, tile, bits) are sorted by bucket; a bucket has about two tiles of rows at most."""

    def found(group, key, tile, bits) -> pa.RecordBatch:
        ends = np.append(np.flatnonzero((np.diff(group) != 0) | (np.diff(key) != 0) | (np.diff(tile) != 0)) + 1, len(group))
        starts = np.concatenate(([0], ends[:-1]))
        u, v = [], []
        two = starts[ends - starts == 2]
        for g in range(len(ring.groups)):
            at = two[group[two] == g]
            at = at[ring.linked(bits[at] ^ bits[at + 1], g)]
            u += at.tolist()
            v += (at + 1).tolist()
        for a, b in zip(starts[ends - starts > 2].tolist(), ends[ends - starts > 2].tolist(), strict=True):
            for x, y in _forest(ring, bits[a:b], int(group[a])):
                u.append(a + x)
                v.append(a + y)
        ids = bits.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ids[np.array(x, np.int64)]) for x in (u, v)], names=["u", "v"])

    rest: list[np.ndarray] | None = None
    for b in batches:
        now = [b.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
        now[3] = now[3].view(np.uint64)
        if rest is not None:
            now = [np.concatenate(x) for x in zip(rest, now, strict=True)]
        same = (now[0] == now[0][-1]) & (now[1] == now[1][-1]) & (now[2] == now[2][-1])
        last = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
        rest = [x[last:] for x in now]
        if last:
            yield found(*(x[:last] for x in now))
    if rest is not None and len(rest[0]):
        yield found(*rest)


def near_links(nodes: DataFrame, tile: int = TILE, segments: int | None = None) -> DataFrame:
    """Edges ``u``, ``v`` that connect all of nodes' distinct fingerprints (``bits``) at DISTANCE or fewer differing bits. Fingerprints stand for themselves.

    Not every link is returned, but those of a spanning forest of each bucket, so groups of any size cost no more edges than they
    have members. Buckets of one fingerprint are dropped before anything is compared; of a bucket of over ``tile`` fingerprints,
    each is dealt to as many tasks as the bucket has tiles, which compare two tiles each. ``segments`` (DISTANCE + 1 at least) only
    changes how much is compared; by default it grows with the number of fingerprints.
    """
    if segments is None:
        n = nodes.count()
        segments = next(k for most, k in RINGS if n <= most)
    ring = Ring(segments)
    keys = F.array(*(F.struct(F.lit(g).alias("group"), F.col("bits").bitwiseAND(F.lit(signed(sum(ring.masks[i] for i in group)))).alias("key")) for g, group in enumerate(ring.groups)))
    keyed = nodes.select("bits", F.explode(keys).alias("k")).select("k.group", "k.key", "bits")
    sizes = keyed.groupBy("group", "key").agg(F.count("*").alias("n")).where("n > 1")
    tiles = F.ceil(F.col("n") / tile)
    own = F.pmod(F.xxhash64("bits"), tiles)
    other = F.filter(F.sequence(F.lit(0).cast("long"), tiles - 1), lambda u: (tiles == 1) | (u != own))
    dealt = keyed.join(sizes, ["group", "key"]).select("group", "key", F.explode(F.transform(other, lambda u: F.least(u, own) * tiles + F.greatest(u, own))).alias("tile"), "bits")
    return dealt.repartition("group", "key", "tile").sortWithinPartitions("group", "key", "tile").mapInArrow(partial(_links, ring=ring), "u long, v long")


def near_groups(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id``, the smallest doc_id that links reach.

    A-Z are lower-cased; words are ``[^\\x20\\x09-\\x0D]+`` of the whole text; four-word shingles count as often as they occur; a
    text of fewer words is one shingle, one of none (null included) has fingerprint zero and links like any other. Fingerprints
    link at 4 or fewer differing bits, transitively. Rows with a null doc_id get a fingerprint and take part, so they may join others;
    a component's id is null only if no row in it has one. Repeated rows are kept. Other columns are ignored; an empty table gives an
    empty result. Rows of a hot fingerprint, and fingerprints of a large component, are dealt over several tasks in each join.
    """
    prints = cut(simhash(docs)).withColumn("salt", salt("doc_id"))
    nodes = cut(prints.groupBy("bits").agg(F.min("doc_id").alias("id"), salts_of(F.col("salt")).alias("salts")))
    reached = components(near_links(nodes.select("bits")))
    placed = nodes.join(reached, nodes["bits"] == reached["node"], "left").select("bits", "id", "salts", F.coalesce("component", "bits").alias("root"), salt("bits").alias("of_root"))
    roots = per_salt(placed.groupBy("root").agg(F.min("id").alias("component_id"), salts_of(F.col("of_root")).alias("all")), "all", "of_root")
    named = per_salt(placed.join(roots, ["root", "of_root"]).select("bits", "salts", "component_id"))
    return prints.join(named, ["bits", "salt"]).select("doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")


#: Fingerprints of the similarity search: so many bits; a link at 0.8 differs in 15% of them, and in more than WIDE_DISTANCE with a probability of 1%.
WIDE, WIDE_DISTANCE = 256, 52
#: What a link's bits agree in at least; the expected number of keys that a link at 0.8 shares, so that it misses all with a probability of 2%.
AGREE, SHARED = 0.85, 4
#: Segments of the ring, and the most that the first l segments of a viable chain may differ by.
SEGMENTS = 16
BUDGETS = [WIDE_DISTANCE * k // SEGMENTS for k in range(1, SEGMENTS + 1)]


def wide_fingerprint(hashes: np.ndarray) -> bytes:
    """The 256-bit SimHash of a set of 64-bit hashes, each of which is stretched to as many bits."""
    x = hashes[:, None] + (np.arange(1, WIDE // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None]
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    bits = np.unpackbits(x.view(np.uint8).reshape(len(hashes), -1), axis=1)
    return np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)).tobytes()


@cache
def _places(bits: int, keys: int) -> np.ndarray:
    """Which bits each key samples, drawn once for all."""
    draws = [[xxhash.xxh64_intdigest(f"{k} {i}", SEED) for i in range(WIDE)] for k in range(keys)]
    return np.array(draws, np.uint64).reshape(keys, WIDE).argsort(axis=1)[:, :bits]


def sampled(prints: np.ndarray, bits: int, keys: int) -> np.ndarray:
    """For each fingerprint (a row of 32 bytes) so many keys: the values of samples of its bits."""
    unpacked, out = np.unpackbits(prints, axis=1), np.zeros((len(prints), keys), np.int64)
    for i, at in enumerate(_places(bits, keys).T):
        out |= unpacked[:, at].astype(np.int64) << i
    return out


def _keys(batches: Iterator[pa.RecordBatch], bits: int, keys: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            found = sampled(np.frombuffer(b"".join(b.column("signature").to_pylist()), np.uint8).reshape(-1, WIDE // 8), bits, keys)
            band = np.tile(np.arange(keys), b.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column("node").to_numpy(), keys)), pa.array(band), pa.array(found.ravel() | band << bits)], names=["node", "band", "key"])


class WideRing:
    """256-bit SimHash; keys are samples of bits, which grow with the logarithm of the number of nodes, so that buckets of unlike texts stay small."""

    prunes = True

    def __init__(self, nodes: int | None = None):
        self.nodes = nodes

    @property
    def bits(self) -> int:
        return max(12, math.ceil(math.log2(self.nodes + 1)) + 2)

    @property
    def keys(self) -> int:
        return math.ceil(SHARED / AGREE**self.bits)

    def sign(self, hashes: np.ndarray) -> bytes:
        return wide_fingerprint(hashes)

    def keyed(self, nodes: DataFrame) -> DataFrame:
        self.nodes = nodes.count()
        return nodes.select("node", "signature").mapInArrow(partial(_keys, bits=self.bits, keys=self.keys), "node long, band long, key long")

    def read(self, signatures: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        raw = np.frombuffer(b"".join(signatures), np.uint8).reshape(-1, WIDE // 8)
        return raw.view(np.uint16), sampled(raw, self.bits, self.keys)

    def allows(self, one: list[bytes], other: list[bytes]) -> np.ndarray:
        found = np.zeros(len(one), bool)
        words = [np.frombuffer(b"".join(x), np.uint16).reshape(-1, SEGMENTS) for x in (one, other)]
        found[_within(np.bitwise_count(words[0] ^ words[1]))[0]] = True
        return found

    def near(self, prints: tuple[np.ndarray, np.ndarray], at: int, others: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words, values = prints
        left, whole = _within(np.bitwise_count(words[others] ^ words[at]))
        return others[left], -whole, (values[others[left]] == values[at]).argmax(axis=1)


def _within(apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of differences by segment whose sum is WIDE_DISTANCE or less, and the sums. Pigeonring: of these some chain of consecutive segments stays within its budget at each length; only rows with such a chain are summed."""
    viable = np.zeros(len(apart), bool)
    for start in range(SEGMENTS):
        left, total = np.flatnonzero(~viable), 0
        for n, most in enumerate(BUDGETS):
            total = total + apart[left, (start + n) % SEGMENTS].astype(np.int64)
            left, total = left[total <= most], total[total <= most]
            if not len(left):
                break
        viable[left] = True
    left = np.flatnonzero(viable)
    whole = apart[left].sum(axis=1, dtype=np.int64)
    return left[whole <= WIDE_DISTANCE], whole[whole <= WIDE_DISTANCE]


def _with_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        words = [normal(t.as_py() or "") for t in b.column("text")]
        digests = pa.array([xxhash.xxh3_128_digest(w) if w else None for w in words], pa.binary())
        yield pa.RecordBatch.from_arrays([*b.columns, digests], names=[*b.schema.names, "__digest"])


def near_dedup(docs: DataFrame, size: int = SHINGLES, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each group of near copies, repeated rows and texts of equal words included, the first one by doc_id (null last, then by the text's digest).

    Texts are near copies if their sets of ``size``-word shingles have a similarity of ``percent`` hundredths at least, directly or through others. Candidates are found by a 256-bit SimHash: nodes that share
    a sample of bits, pruned by pigeonring and the full distance, and confirmed on full sets; so none is dropped that is not alike, and at 0.8 about 97% of the links are found (a test measures recall).
    Rows are told apart by doc_id and text, so rows of one doc_id and different texts are judged each. Null, empty and blank texts link with nothing and stay. Columns may have any names but those that
    start with two underscores; an empty table gives an empty result.
    """
    _, nodes, labels = labelled(docs, size, percent, WideRing())
    placed = nodes.join(labels, "node", "left").select(F.coalesce("component", "node").alias("root"), F.struct(F.col("id").isNull().alias("none"), "id", "digest").alias("first"))
    stay = placed.groupBy("root").agg(F.min("first").alias("f")).select(F.col("f.digest").alias("__stay"), F.col("f.id").alias("__id"))
    schema = StructType([*docs.schema.fields, StructField("__digest", BinaryType())])
    keyed = docs.mapInArrow(_with_digest, schema)
    key = ["__digest", "__id", "__none"]  # columns, so that rows that repeat meet where the join has put them
    of = lambda name: {"__none": F.col(name).isNull(), "__id": F.coalesce(F.col(name), F.lit(0).cast("long"))}
    kept = keyed.where("__digest IS NOT NULL").withColumns(of("doc_id")).join(stay.withColumns(of("__id")).withColumnRenamed("__stay", "__digest"), key, "left_semi").dropDuplicates(key)
    return kept.drop("__id", "__none").unionByName(keyed.where("__digest IS NULL")).drop("__digest")
