"""Groups of texts that are alike: what is common to fingerprints of any kind. Candidates come from buckets of equal keys; links are confirmed on full sets of shingles."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemine.llm.common import components, cut, empty_if_null, per_salt, salt, salts_of, written

#: Words of a shingle and the least similarity, in hundredths, of a link.
SHINGLE, PERCENT = 5, 80
#: Members of a bucket on each side of one comparison; partners that a member proposes in the first round after the stars.
TILE, PARTNERS = 512, 4
#: Tasks that the members of one star are dealt to.
RAYS = 64
#: Bits of one of Spark's bitmaps, and how many of them tell which doc_ids are likely to be wanted.
MAP_BITS, MAPS = 32768, 256


class Scheme(Protocol):
    """How texts are fingerprinted and compared."""

    #: Whether stars have edges that the fingerprints alone rule out.
    prunes: bool

    def sign(self, hashes: np.ndarray) -> bytes:
        """The fingerprint of a set of shingle hashes, in order."""

    def keyed(self, nodes: DataFrame) -> DataFrame:
        """``node``, ``band`` (a number), ``key``: the buckets of each node (``node``, ``signature``); a key belongs to one band."""

    def read(self, signatures: list[bytes]) -> Any:
        """Fingerprints in the form that ``near`` takes."""

    def allows(self, one: list[bytes], other: list[bytes]) -> np.ndarray:
        """Which pairs of fingerprints are not ruled out."""

    def near(self, prints: Any, at: int, others: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the places in others those that may link with at, how close they are (larger is closer), and the first band that each shares with it."""


def normal(text: str) -> bytes:
    """A text's words, A-Z lower-cased, with a space between."""
    return b" ".join(text.encode().lower().split())  # bytes: A-Z and ASCII white space only


def shingle_hashes(words: bytes, size: int) -> np.ndarray:
    """The distinct hashes, in order, of a text's shingles; a text of fewer words is one shingle."""
    parts = words.split(b" ")
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    stops = ends[size - 1 :].tolist() or [len(words)]
    digest = xxhash.xxh64_digest
    return np.unique(np.frombuffer(b"".join([digest(words[a:b]) for a, b in zip(starts, stops, strict=False)]), ">u8").astype(np.uint64))


def _signed(batches: Iterator[pa.RecordBatch], size: int, scheme: Scheme) -> Iterator[pa.RecordBatch]:
    for b in batches:
        digests, counts, signatures = [], [], []
        for t in b.column("text"):
            words = normal(t.as_py())
            hashes = shingle_hashes(words, size) if words else ()
            digests.append(xxhash.xxh3_128_digest(words))
            counts.append(len(hashes))
            signatures.append(scheme.sign(hashes) if words else None)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(digests, pa.binary()), pa.array(counts, pa.int64()), pa.array(signatures, pa.binary())], names=["doc_id", "digest", "n_shingles", "signature"])


def signatures(docs: DataFrame, size: int, scheme: Scheme) -> DataFrame:
    """``doc_id``, the ``digest`` of the text's words, ``n_shingles`` (distinct ones) and the ``signature``, null where there is no word."""
    return docs.select("doc_id", empty_if_null("text").alias("text")).mapInArrow(partial(_signed, size=size, scheme=scheme), "doc_id long, digest binary, n_shingles long, signature binary")


def buckets_of(nodes: DataFrame, scheme: Scheme) -> DataFrame:
    """``key``, ``band``, ``node``, ``salt``, ``n``: members of the buckets that hold several nodes.

    The join is by a shuffle: Spark sizes the keys by the nodes that they are made from, of which each has many, and would send them all through the driver.
    """
    keyed = scheme.keyed(nodes).withColumn("salt", salt("node"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n"), salts_of(F.col("salt")).alias("salts")).where("n > 1")
    return keyed.join(per_salt(sizes).hint("merge"), ["key", "salt"])


def stars(buckets: DataFrame) -> DataFrame:
    """Distinct edges ``u``, ``v``: each member of a bucket with the bucket's centre, the member that shares most buckets with others. So n members give n - 1 candidates, and a text that many are copies of is their centre."""
    score = buckets.groupBy("node").agg(F.sum(F.col("n") - 1).alias("score"))
    centres = buckets.join(score, "node").groupBy("key").agg(F.max_by("node", F.struct("score", "node")).alias("centre"), salts_of(F.col("salt")).alias("salts"))
    return buckets.join(per_salt(centres).hint("merge"), ["key", "salt"]).where("node <> centre").select(F.col("centre").alias("u"), F.col("node").alias("v")).distinct()


def _maybe(batches: Iterator[pa.RecordBatch], scheme: Scheme) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at = pa.array(np.flatnonzero(scheme.allows(b.column("one").to_pylist(), b.column("other").to_pylist())))
        yield pa.RecordBatch.from_arrays([b.column("u").take(at), b.column("v").take(at)], names=["u", "v"])


def not_ruled_out(edges: DataFrame, nodes: DataFrame, scheme: Scheme) -> DataFrame:
    """Those of edges that the fingerprints allow."""
    of = lambda k, name: nodes.select(F.col("node").alias(k), F.col("signature").alias(name))
    return edges.join(of("u", "one"), "u").join(of("v", "other"), "v").mapInArrow(partial(_maybe, scheme=scheme), "u long, v long")


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        words = [normal(t.as_py()) for t in b.column("text")]
        yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(w) for w in words], pa.binary()), pa.array(words, pa.binary())], names=["digest", "words"])


def likely(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """rows (``doc_id``, ``text``) but for most of those whose doc_id is not in ids (``__id``), so that a join on it moves few texts. The bits of hashes that ids have are set in MAPS maps of MAP_BITS bits, whatever the
    number of ids: 1 MB for all tasks. Where ids are so many that most bits are set, more rows stay; none is lost."""
    hashed = lambda c: F.pmod(F.xxhash64(c), F.lit(MAPS * MAP_BITS))
    place = hashed(F.col("__id"))
    maps = ids.select(F.floor(place / MAP_BITS).alias("__map"), (place % MAP_BITS).alias("__bit")).repartition("__map").groupBy("__map").agg(F.bitmap_construct_agg("__bit").alias("__bits"))
    at = hashed(F.col("doc_id"))
    byte = F.conv(F.hex(F.substring(F.col("__bits"), (at % MAP_BITS / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = rows.join(F.broadcast(maps), F.floor(at / MAP_BITS) == F.col("__map"))
    return found.where(F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(1) == 1).select(*rows.columns)


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node``, ``words`` of the wanted nodes (``node``, ``digest``, ``id``: a doc_id that has the text), from the documents again."""
    ids = wanted.select(F.col("id").alias("__id")).distinct()
    rows = likely(docs.select("doc_id", empty_if_null("text").alias("text")), ids).join(ids, F.col("doc_id").eqNullSafe(F.col("__id")))  # a semi-join would be done before what likely does
    return rows.select("text").mapInArrow(_words, "digest binary, words binary").join(wanted.select("node", "digest"), "digest").select("node", "words").dropDuplicates(["node"])


def _set(words: bytes, size: int) -> set[bytes]:
    parts = words.split(b" ")
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    return {words[a:b] for a, b in zip(starts, ends[size - 1 :].tolist() or [len(words)], strict=False)}


def _linked(a: set, b: set, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(a & b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def _alike(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (u, ray, v, words) come by star; the first of a star, without v, has the words of its centre."""
    centre: set = set()
    for b in batches:
        u, v, words = (b.column(k) for k in ("u", "v", "words"))
        found = []
        for i, other in enumerate(v.to_pylist()):
            if other is None:
                centre = _set(words[i].as_py(), size)
                continue
            if _linked(_set(words[i].as_py(), size), centre, percent):
                found.append(i)
        yield pa.RecordBatch.from_arrays([u.take(pa.array(found, pa.int64())), v.take(pa.array(found, pa.int64()))], names=["u", "v"])


def confirmed(edges: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of edges whose full sets of shingles are alike enough. A centre's words go once to each of the tasks that its members are dealt to."""
    rays = edges.withColumn("ray", F.pmod(F.xxhash64("v"), F.lit(RAYS)).cast("int"))
    members = rays.join(texts.select(F.col("node").alias("v"), "words"), "v").select("u", "ray", "v", "words")
    centres = rays.select("u", "ray").distinct().join(texts.select(F.col("node").alias("u"), "words"), "u").select("u", "ray", F.lit(None).cast("long").alias("v"), "words")
    both = centres.unionByName(members).repartition("u", "ray").sortWithinPartitions("u", "ray", F.asc_nulls_first("v"))
    return both.mapInArrow(partial(_alike, size=size, percent=percent), "u long, v long")


def _tiles(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[dict[str, list | np.ndarray]]:
    """The rows of each (key, i, j), which come together, as columns."""
    rest: dict | None = None
    for b in batches:
        now = {k: b.column(k).to_numpy(zero_copy_only=False) for k in names}
        if rest is not None:
            now = {k: np.concatenate((rest[k], now[k])) for k in names}
        ends = np.flatnonzero((np.diff(now["key"]) != 0) | (np.diff(now["i"]) != 0) | (np.diff(now["j"]) != 0)) + 1
        for a, z in zip([0, *ends[:-1]], ends, strict=False):
            yield {k: x[a:z] for k, x in now.items()}
        rest = {k: x[ends[-1] if len(ends) else 0 :] for k, x in now.items()}
    if rest is not None and len(rest["key"]):
        yield rest


def _proposed(batches: Iterator[pa.RecordBatch], percent: int, partners: int | None, scheme: Scheme) -> Iterator[pa.RecordBatch]:
    """In each tile members of side 0 are compared with all of side 1. A row per member that has a part in a proposal: ``others`` are the partners it proposes."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.bool_())
    for t in _tiles(batches, ("key", "i", "j", "band", "side", "node", "component", "major", "n_shingles", "signature")):
        prints = scheme.read(list(t["signature"]))
        node, component, n = t["node"], t["component"], t["n_shingles"]
        right, proposed, more = np.flatnonzero(t["side"] == 1), {}, set()
        for at in np.flatnonzero(t["side"] == 0).tolist():
            fit = (component[right] != component[at]) & (100 * np.minimum(n[right], n[at]) >= percent * np.maximum(n[right], n[at]))
            if partners is None:  # two members outside the largest component meet on either side
                fit &= (component[right] == t["major"][right]) | (node[right] > node[at])
            hits, close, first = scheme.near(prints, at, right[fit], percent)
            own = first == t["band"][at]  # a pair is proposed in the first band that it shares
            hits, close = hits[own], close[own]
            if partners is not None and len(hits) > partners:
                hits = hits[np.lexsort((node[hits], -close))[:partners]]
                more.add(int(node[at]))
            if len(hits):
                proposed[int(node[at])] = node[hits].tolist()
        used = sorted({*proposed, *(v for vs in proposed.values() for v in vs)})
        where = [np.full(len(used), t[k][0]) for k in ("key", "i", "j")]
        columns = (*where, used, [proposed.get(v, []) for v in used], [v in more for v in used])
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=["key", "i", "j", "node", "others", "more"])


def _checked(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """The proposals of a tile that are links."""
    for t in _tiles(batches, ("key", "i", "j", "node", "others", "words")):
        sets = {v: _set(w, size) for v, w in zip(t["node"].tolist(), t["words"], strict=True)}
        found = [(u, v) for u, vs in zip(t["node"].tolist(), t["others"], strict=True) for v in vs.tolist() if _linked(sets[u], sets[v], percent)]
        yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in found], pa.int64()) for k in (0, 1)], names=["u", "v"])


def proposals(buckets: DataFrame, labels: DataFrame, nodes: DataFrame, percent: int, partners: int | None, scheme: Scheme) -> DataFrame:
    """``key``, ``i``, ``j``, ``node``, ``others``, ``more``: members of a bucket's tile with those that they may link with, which are not in their component yet (labels: ``node``, ``component``).

    Buckets in one component are done. Of buckets with the same members one is looked at. In each, the members outside its largest component are compared with all, by the
    sizes of their sets and by their fingerprints, in tiles of TILE members a side; ``partners`` keeps the likeliest of each, and ``more`` says that there were others.
    """
    several = buckets.where("n > 2")  # the star of a bucket of two is all of it
    own = several.select("key", "band", "node").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    parts = own.groupBy("key", "band", "component").agg(F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sum"))
    live = parts.groupBy("key", "band").agg(F.max_by("component", F.struct("n", "component")).alias("major"), F.sum("n").alias("n"), (F.sum("n") - F.max("n")).alias("minor"), F.sum("sum").alias("sum")).where("minor > 0")
    live = live.groupBy("n", "sum").agg(F.min(F.struct("band", "key", "major", "minor")).alias("b")).select("n", "b.key", "b.major", "b.minor")
    rows, all_tiles, minor_tiles = own.join(live, "key"), F.ceil(F.col("n") / TILE), F.ceil(F.col("minor") / TILE)
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    rest = ("band", "node", "component", "major")
    right = rows.select("key", upto(minor_tiles).alias("i"), F.pmod(F.xxhash64("node"), all_tiles).alias("j"), F.lit(1).alias("side"), *rest)
    left = rows.where("component <> major").select("key", F.pmod(F.xxhash64("node"), minor_tiles).alias("i"), upto(all_tiles).alias("j"), F.lit(0).alias("side"), *rest)
    dealt = left.unionByName(right).join(nodes.select("node", "n_shingles", "signature"), "node")
    schema = "key long, i long, j long, node long, others array<long>, more boolean"
    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(partial(_proposed, percent=percent, partners=partners, scheme=scheme), schema)


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (``node``, ``component``, for nodes that are no root) after the components at both ends of each link are joined."""
    root = lambda k: labels.select(F.col("node").alias(k), F.col("component").alias(f"root_{k}"))
    ends = links.join(root("u"), "u", "left").join(root("v"), "v", "left")
    joined = cut(components(ends.select(F.coalesce("root_u", "u").alias("u"), F.coalesce("root_v", "v").alias("v"))))
    over = joined.select(F.col("node").alias("component"), F.col("component").alias("now"))
    return cut(labels.join(over, "component", "left").select("node", F.coalesce("now", "component").alias("component")).unionByName(joined))


def labelled(docs: DataFrame, size: int, percent: int, scheme: Scheme) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows' ``doc_id``, ``digest``, ``n_shingles``; the nodes, one per text (``node``, ``digest``, the least ``id``, ``salts``); and the ``node``, ``component`` of nodes that are no root.

    Candidates are the stars of the buckets; where a bucket is not one component after that, members outside its largest one propose their likeliest partners, and then all that may be links.
    So pairs of a group that is connected are never listed.
    """
    prints = written(signatures(docs, size, scheme))
    distinct = prints.where("n_shingles > 0").withColumn("salt", salt("doc_id")).groupBy("digest").agg(F.min("doc_id").alias("id"), salts_of(F.col("salt")).alias("salts"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    nodes = cut(distinct.withColumn("node", F.monotonically_increasing_id()))
    buckets = cut(buckets_of(nodes, scheme))
    read = lambda wanted: written(_texts(docs, wanted.distinct().join(nodes.select("node", "digest", "id"), "node")))
    edges = stars(buckets)
    if scheme.prunes:  # few members of the buckets are alike, so only their texts are read
        edges = cut(not_ruled_out(edges, nodes, scheme))
        texts = read(edges.select(F.explode(F.array("u", "v")).alias("node")))
    else:
        texts = read(buckets.select("node"))
        edges = cut(edges)
    labels = components(confirmed(edges, texts, size, percent))
    for partners in (PARTNERS, None):
        found = cut(proposals(buckets, labels, nodes, percent, partners, scheme))
        proposed, more = found.agg(F.count("*"), F.coalesce(F.max("more"), F.lit(False))).first()
        if proposed:
            if scheme.prunes:
                texts = read(found.select("node"))
            tiles = found.join(texts, "node").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
            labels = merged(labels, tiles.mapInArrow(partial(_checked, size=size, percent=percent), "u long, v long"))
        if not more:
            break  # each member has proposed all that it may link with
        buckets = buckets.join(found.where("more").select("key").distinct(), "key", "left_semi")  # in the others each has
    return prints.select("doc_id", "digest", "n_shingles"), nodes.select("node", "digest", "id", "salts"), labels
