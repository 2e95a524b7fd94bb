"""Vector code compression: product codes whose codebooks are fitted by k-means over metric trees made by the anchors hierarchy."""

from __future__ import annotations

import hashlib
import io
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemine.llm.common import per_salt, salt, salts_of, written

#: Components are floor(SCALE * x); vectors are cut in PARTS, each with a codebook of ENTRIES, fitted in ROUNDS.
SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Vectors of one tree, and points of a ball that is not cut further.
BLOCK, LEAF = 2048, 24


class Tree:
    """A metric tree over points (rows of whole numbers). Nodes are numbered from the root, 0; each covers ``low`` to ``high`` of the reordered points and caches their sum and radius; leaves have no ``left``."""

    FIELDS = ("order", "points", "low", "high", "left", "right", "sums", "radius")

    def __init__(self, **arrays: np.ndarray):
        self.__dict__.update(arrays)

    @classmethod
    def over(cls, points: np.ndarray) -> Tree:
        exact = points.astype(np.float64)
        order, low, high, left, right = [], [], [], [], []

        def numbered(ball) -> int:
            """ball: indices of a leaf's points, or two balls."""
            at = len(low)
            low.append(len(order))
            for x in (high, left, right):
                x.append(-1)
            if isinstance(ball, tuple):
                left[at] = numbered(ball[0])
                right[at] = numbered(ball[1])
            else:
                order.extend(ball.tolist())
            high[at] = len(order)
            return at

        numbered(_ball(exact, np.arange(len(points))))
        own = points[order]
        total = np.concatenate((np.zeros((1, points.shape[1]), np.int64), np.cumsum(own, axis=0, dtype=np.int64)))
        low, high = np.array(low), np.array(high)
        sums = total[high] - total[low]
        middles = sums / (high - low)[:, None]
        radius = [math.sqrt(((own[a:z] - m) ** 2).sum(axis=1).max()) for a, z, m in zip(low.tolist(), high.tolist(), middles, strict=True)]
        return cls(order=np.array(order, np.int32), points=own.astype(np.int32), low=low, high=high, left=np.array(left), right=np.array(right), sums=sums, radius=np.array(radius))

    def packed(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{k: getattr(self, k) for k in self.FIELDS})
        return out.getvalue()

    @classmethod
    def unpacked(cls, data: bytes) -> Tree:
        with np.load(io.BytesIO(data)) as arrays:
            return cls(**{k: arrays[k] for k in cls.FIELDS})

    def owned(self, entries: np.ndarray) -> Iterator[tuple[int, int, np.ndarray | int, np.ndarray | None]]:
        """Who owns the points, of which each is in one of the spans yielded: (low, high, entry, sum) of a ball that one entry owns, or (low, high, entries, None) of a leaf.

        A ball inherits the entries that its parent could not rule out. Of these the one nearest to the middle rules out each that is farther away from every point of the ball:
        the difference of the squared distances is linear, so it is least at the ball's rim. What could be a tie is left to the leaves, which compare whole numbers; of equal ones the lowest wins.
        """
        exact = entries.astype(np.float64)
        stack = [(0, np.arange(len(entries)))]
        while stack:
            at, left = stack.pop()
            low, high = int(self.low[at]), int(self.high[at])
            if len(left) > 1:
                far = ((exact[left] - self.sums[at] / (high - low)) ** 2).sum(axis=1)
                near = int(far.argmin())
                apart = np.sqrt(((exact[left] - exact[left[near]]) ** 2).sum(axis=1))
                rim = 2 * self.radius[at] * apart
                left = left[far - far[near] <= rim + 1e-9 * (far + far[near] + rim) + 1e-6]
            if len(left) == 1:
                yield low, high, int(left[0]), self.sums[at]
            elif self.left[at] < 0:
                apart = self.points[low:high, None, :].astype(np.int64) - entries[left]
                yield low, high, left[(apart * apart).sum(axis=2).argmin(axis=1)], None
            else:
                stack += [(int(self.right[at]), left), (int(self.left[at]), left)]


def _ball(points: np.ndarray, own: np.ndarray):
    """Middle-out: about sqrt(n) anchors share the points out, each one's ball is cut further, and balls are merged, those first that make the smallest one, until one is left."""
    if len(own) <= LEAF:
        return own
    pivots, owner = [own[0]], np.zeros(len(own), np.int64)
    far = np.sqrt(((points[own] - points[own[0]]) ** 2).sum(axis=1))
    while len(pivots) < math.ceil(math.sqrt(len(own))):
        widest = int(far.argmax())  # the rim of the ball with the largest radius
        if far[widest] == 0:
            break
        new = own[widest]
        half = np.sqrt(((points[pivots] - points[new]) ** 2).sum(axis=1)) / 2
        maybe = np.flatnonzero(far >= half[owner])  # nearer ones cannot be nearer to the new anchor
        reach = np.sqrt(((points[own[maybe]] - points[new]) ** 2).sum(axis=1))
        stolen = maybe[reach < far[maybe]]
        far[stolen] = reach[reach < far[maybe]]
        owner[stolen] = len(pivots)
        pivots.append(new)
    if len(pivots) == 1:
        return own  # all points are equal
    balls, middles, radii = [], [], []
    for k in range(len(pivots)):
        at = owner == k
        mine = own[at]
        balls.append(_ball(points, mine))
        middles.append(points[mine].mean(axis=0))
        radii.append(math.sqrt(((points[mine] - middles[-1]) ** 2).sum(axis=1).max()))
    sizes, middles, radii = np.bincount(owner, minlength=len(pivots)).astype(float), np.array(middles), np.array(radii)
    apart = np.sqrt(((middles[:, None] - middles[None]) ** 2).sum(axis=2))
    cost = (apart + radii[:, None] + radii[None]) / 2
    np.fill_diagonal(cost, np.inf)
    for _ in range(len(balls) - 1):
        i, j = divmod(int(cost.argmin()), len(balls))
        balls[i] = (balls[i], balls[j])
        middles[i] = (middles[i] * sizes[i] + middles[j] * sizes[j]) / (sizes[i] + sizes[j])
        radii[i], sizes[i] = cost[i, j], sizes[i] + sizes[j]
        cost[j, :] = cost[:, j] = np.inf
        others = np.flatnonzero(np.isfinite(cost[i]))
        cost[i, others] = cost[others, i] = (np.sqrt(((middles[others] - middles[i]) ** 2).sum(axis=1)) + radii[others] + radii[i]) / 2
        last = i
    return balls[last]


def whole(values: np.ndarray, dims: int) -> np.ndarray:
    """floor(SCALE * x) of finite components. Those so large that an error could not be held in a long are brought to the largest that can: sqrt(2**60 / dims)."""
    most = math.isqrt((1 << 60) // max(1, dims))
    with np.errstate(over="ignore"):
        return np.clip(np.floor(values.astype(np.float64) * SCALE), -most, most).astype(np.int64)


def _planted(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    """A row for each block of vectors: its ids and labels, and the tree of each part."""
    width = dims // PARTS
    for b in batches:
        n = b.num_rows
        values = whole(b.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(n, dims), dims)
        rows = []
        for start in range(0, n, BLOCK):
            part = values[start : start + BLOCK]
            trees = [Tree.over(part[:, p * width : (p + 1) * width]).packed() for p in range(PARTS)]
            rows.append((b.column("vec_id")[start : start + BLOCK].to_pylist(), b.column("label")[start : start + BLOCK].to_pylist(), trees))
        kinds = (pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary()))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["vec_ids", "labels", "trees"])


def _summed(batches: Iterator[pa.RecordBatch], books: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """How many points each entry of each part owns among the task's blocks, and their sums."""
    counts, sums = [np.zeros(len(e), np.int64) for e in books], [np.zeros(e.shape, np.int64) for e in books]
    for b in batches:
        for trees in b.column("trees"):
            for p, data in enumerate(trees):
                tree = Tree.unpacked(data.as_py())
                for low, high, entry, total in tree.owned(books[p]):
                    if total is not None:
                        counts[p][entry] += high - low
                        sums[p][entry] += total
                    else:
                        np.add.at(counts[p], entry, 1)
                        np.add.at(sums[p], entry, tree.points[low:high])
    rows = [(p, int(e), int(counts[p][e]), sums[p][e].tolist()) for p in range(len(books)) for e in np.flatnonzero(counts[p])]
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["part", "entry", "n", "sums"])


def _coded(batches: Iterator[pa.RecordBatch], books: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for ids, labels, trees in zip(b.column("vec_ids"), b.column("labels"), b.column("trees"), strict=True):
            codes, errors = np.zeros((len(ids), len(books)), np.uint8), np.zeros(len(ids), np.int64)
            for p, data in enumerate(trees):
                tree = Tree.unpacked(data.as_py())
                for low, high, entry, _ in tree.owned(books[p]):
                    codes[tree.order[low:high], p] = entry
                own = tree.points.astype(np.int64) - books[p][codes[tree.order, p]]
                errors[tree.order] += (own * own).sum(axis=1)
            yield pa.RecordBatch.from_arrays([ids.values, labels.values, pa.array([c.tobytes().hex() for c in codes]), pa.array(errors)], names=["vec_id", "label", "code", "error"])


def codebooks_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for e in books for x in e.ravel().tolist()).encode()).hexdigest()


def kept(vectors: DataFrame) -> DataFrame:
    """``vec_id``, ``label``, ``embedding`` of the rows whose vector is neither null nor holds a null or non-finite component."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding").where(F.col("embedding").isNotNull() & F.forall("embedding", finite))


def fit(trees: DataFrame, books: list[np.ndarray], rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks after so many rounds. A round hands the entries, whose number is fixed, to all tasks, and gets a row per part and entry back."""
    for _ in range(rounds):
        partials = trees.select("trees").mapInArrow(partial(_summed, books=books), "part int, entry int, n long, sums array<long>")
        each = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(books[0].shape[1])]
        books = [e.copy() for e in books]
        for r in partials.groupBy("part", "entry").agg(F.sum("n").alias("n"), *each).collect():  # PARTS * ENTRIES rows at most
            books[r["part"]][r["entry"]] = [int(x) // r["n"] for x in r[3:]]
    return books


def compress(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One row per kept vector: ``vec_id``, ``label``, ``code`` (an entry's index per part, two hex digits each), ``error``, ``label_error``, ``codebooks_sha256``.

    Rows whose ``embedding`` is null or holds null or non-finite components are dropped, and so are those with another number of components than the smallest vec_id's. Each component x becomes floor(SCALE * x); vectors are cut into
    PARTS of equal length, and what is left over is not used. A part's codebook starts as that part of the ENTRIES smallest vec_ids (all, if there are fewer; equal ids in the order of their vectors, null ids last). A round assigns
    every part to the nearest entry, the lowest of equal ones, and replaces each used entry by the floor of its parts' mean. ``error`` adds the squared distances up; ``label_error`` adds
    errors up over equal labels, nulls together. Repeated rows are each counted; other columns are ignored; without kept rows the result is empty.

    Trees are made once, per block of vectors, and written; every round and the last assignment walk them. All sums are whole numbers, so the result does not depend on how vectors are dealt.
    """
    rows = kept(vectors)
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(ENTRIES).collect()
    spark = vectors.sparkSession
    if not first:
        return spark.createDataFrame([], "vec_id long, label long, code string, error long, label_error long, codebooks_sha256 string")
    dims = len(first[0]["embedding"])
    same = rows.where(F.size("embedding") == dims)
    if any(len(r["embedding"]) != dims for r in first):
        first = same.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(ENTRIES).collect()
    used = dims // PARTS * PARTS
    start = whole(np.array([r["embedding"][:used] for r in first], np.float64).reshape(len(first), used), used)
    books = [np.ascontiguousarray(x) for x in np.split(start, PARTS, axis=1)]
    cut = same.withColumn("embedding", F.slice("embedding", 1, used)) if used != dims else same
    trees = written(cut.mapInArrow(partial(_planted, dims=used), "vec_ids array<long>, labels array<long>, trees array<binary>"))
    books = fit(trees, books, rounds)
    coded = trees.mapInArrow(partial(_coded, books=books), "vec_id long, label long, code string, error long").withColumn("salt", salt("vec_id"))
    sums = per_salt(coded.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error"), salts_of(F.col("salt")).alias("salts")), name="__salt")
    found = coded.join(sums, F.col("label").eqNullSafe(F.col("__label")) & (F.col("salt") == F.col("__salt"))).drop("__label", "__salt", "salt")
    return found.withColumn("codebooks_sha256", F.lit(codebooks_digest(books)))
