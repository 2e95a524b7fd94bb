"""Suffix-array dedup: finds and removes the byte strings that occur more than once, by deep-shallow sorting."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tracemine.llm.common import cut, empty_if_null, per_salt, salt, salts_of

#: Length of the repeated strings, and of the runs of starts that share an anchor.
LENGTH, RUN = 200, 128
#: Bytes that a multikey quicksort compares before blind tries take over, and bytes of its characters.
SHALLOW, WORD = 32, 8
#: Bytes of text whose anchors are looked for at a time.
BLOCK = 1 << 21
#: Occurrences of an anchor from which on it is dealt by longer keys, one for each range of starts, and of such a key from which on its starts go one by one.
HOT, RANGES = 20_000, 8
#: Contexts that are sorted together, about: a task's memory, with the contexts of one key, which are HOT at most.
SORTED = 40_000
#: Digests that a task remembers to send two of a kind.
REMEMBERED = 200_000


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column, one after the other, and where each text begins (and the last ends)."""
    wide = column.type == pa.large_string()
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _words(data: np.ndarray) -> np.ndarray:
    """At each place, the eight bytes that start there as a number; bytes after the end are zero."""
    x = np.concatenate((data, np.zeros(7, np.uint8))).astype(np.uint64)
    x = x[:-1] | x[1:] << np.uint64(8)
    x = x[:-2] | x[2:] << np.uint64(16)
    return x[:-4] | x[4:] << np.uint64(32)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)


def anchors(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors of all strings of the given length within the texts, and a hash of the bytes each is known to be followed by.

    The anchor of a string is the place among its first ``run`` whose next 16 bytes hash lowest (the first such place). It depends on
    the string alone, so equal strings have equal anchors, followed by length - run + 1 equal bytes at least.
    """
    mark = np.zeros(len(data) + 1, np.int8)
    long = np.diff(bounds) >= length
    np.add.at(mark, bounds[:-1][long], 1)
    np.add.at(mark, bounds[1:][long] - length + 1, -1)
    places, hashes, last, opened = [], [], -1, 0
    known = length - run + 1
    for a in range(0, len(data), BLOCK):
        starts = mark[a : min(a + BLOCK, len(data))].cumsum(dtype=np.int64) + opened > 0
        opened += int(mark[a : a + BLOCK].sum(dtype=np.int64))
        if not starts.any():
            continue
        w = _words(data[a : a + BLOCK + length + 8])
        order = _mixed(w) ^ np.append(_mixed(w[8:] + np.uint64(1)), np.zeros(min(8, len(w)), np.uint64))
        low = (order >> np.uint64(32) << np.uint64(32)) | np.arange(len(w), dtype=np.uint64)
        step = 1
        while step < run:  # minimum over the next 2, 4, ... places
            low[:-step] = np.minimum(low[:-step], low[step:])
            step *= 2
        at = (low[: len(starts)][starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        at = at[np.concatenate(([True], np.diff(at) != 0))]
        at = at[at + a > last]
        if not len(at):
            continue
        last = int(at[-1]) + a
        h = np.zeros(len(at), np.uint64)
        for off in [*range(0, known - WORD, WORD), known - WORD]:
            h = _mixed(h ^ w[at + off])
        places.append(at + a)
        hashes.append(h)
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(places), np.concatenate(hashes)


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, bounds = text_bytes(b.column("text"))
        at, h = anchors(data, bounds)
        of = np.searchsorted(bounds, at, side="right") - 1
        ids = b.column("id").to_numpy(zero_copy_only=False)[of] if len(at) else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array((at - bounds[of]).astype(np.int32), pa.int32()), pa.array(h.view(np.int64))], names=["id", "at", "h"])


def _starts(before: int, after: int, low: int, high: int) -> tuple[int, int]:
    """The starts (bytes before the anchor, [first, last)) of those in [low, high) whose strings lie within a context."""
    return max(low, LENGTH - after), min(high, before + 1)


def _ranges(raw: bytes, at: int, begin: int, end: int) -> Iterator[tuple[int, int, bytes]]:
    """The ranges of starts of an anchor of a text [begin, end): first and end, in bytes before the anchor, and a digest of the bytes that all strings with such starts share."""
    size = RUN // RANGES
    for d in range(0, RUN, size):
        if at - d >= begin and at + LENGTH - d - size + 1 <= end:
            yield d, d + size, hashlib.blake2b(raw[at - d : at + LENGTH - d - size + 1], digest_size=8).digest()


def _range_keys(batches: Iterator[pa.RecordBatch], hot: int) -> Iterator[pa.RecordBatch]:
    """The key of each range of starts of the anchors that occur more than hot times."""
    for b in batches:
        ids, lists = b.column("id").to_numpy(zero_copy_only=False).tolist(), b.column("found")
        data, bounds = text_bytes(b.column("text"))
        raw = data.tobytes()
        out = [
            (ids[i], x["at"], low, int.from_bytes(key, "big", signed=True))
            for i, found in enumerate(lists) for x in found.as_py() or () if x["n"] > hot
            for low, _, key in _ranges(raw, int(bounds[i]) + x["at"], int(bounds[i]), int(bounds[i + 1]))
        ]
        yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*out, strict=True) if out else [()] * 4, (pa.int64(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["id", "at", "low", "key"])


def _contexts(batches: Iterator[pa.RecordBatch], hot: int) -> Iterator[pa.RecordBatch]:
    """For each anchor that occurs again, its text from RUN - 1 bytes before it to LENGTH bytes after.

    Anchors that occur more than hot times are sent once for each range of starts, under a key of all bytes that strings with such starts share,
    with the bytes that these strings cover. Ranges whose key occurs more than hot times too (``over``) are sent as digests of their strings, one
    for each start (before is -2). Of equal contexts, and of equal strings of single starts, two are sent; further ones repeat them, so their
    starts are decided, and they go without the text (before is -1).
    """
    seen: dict[bytes, int] = {}

    def copies(digest: bytes) -> int:
        if len(seen) > REMEMBERED:
            seen.clear()
        n = seen[digest] = seen.get(digest, 0) + 1
        return n

    for b in batches:
        ids, lists, overs = b.column("id").to_numpy(zero_copy_only=False).tolist(), b.column("found"), b.column("over")
        data, bounds = text_bytes(b.column("text"))
        raw = data.tobytes()
        out: list[tuple] = []
        for i, found in enumerate(lists):
            begin, end = int(bounds[i]), int(bounds[i + 1])
            over = {(x["at"], x["low"]) for x in overs[i].as_py() or ()}
            for x in found.as_py() or ():
                at, h, n = begin + x["at"], x["h"], x["n"]
                a, z = max(begin, at - RUN + 1), min(end, at + LENGTH)
                if n <= hot:
                    out.append((h, ids[i], x["at"], at - a, raw[a:z], 0, RUN))
                    continue
                decided = x["at"] * 31 + ids[i]
                if copies(hashlib.blake2b(raw[a:z], digest_size=16, salt=(at - a).to_bytes(2, "big")).digest()) > 2:
                    low, high = _starts(at - a, z - at, 0, RUN)
                    if low < high:
                        out.append((decided, ids[i], x["at"], -1, None, low, high))
                    continue
                for low, high, key in _ranges(raw, at, begin, end):
                    a, z = max(begin, at - high + 1), min(end, at + LENGTH - low)
                    if (x["at"], low) not in over:
                        out.append((int.from_bytes(key, "big", signed=True), ids[i], x["at"], at - a, raw[a:z], low, high))
                        continue
                    for d in range(*_starts(at - a, z - at, low, high)):
                        string = hashlib.blake2b(raw[at - d : at - d + LENGTH], digest_size=16, salt=d.to_bytes(2, "big"), person=b"start").digest()
                        if copies(string) <= 2:
                            out.append((int.from_bytes(string[:8], "big", signed=True), ids[i], x["at"], -2, string, d, d + 1))
                        elif out and out[-1][1:4] == (ids[i], x["at"], -1) and out[-1][6] == d:
                            out[-1] = (*out[-1][:6], d + 1)
                        else:
                            out.append((decided, ids[i], x["at"], -1, None, d, d + 1))
            if len(out) > 20_000:
                yield _context_batch(out)
                out = []
        yield _context_batch(out)


_CONTEXT = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("at", pa.int32()), ("before", pa.int32()), ("bytes", pa.binary()), ("low", pa.int32()), ("high", pa.int32())])


def _context_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*rows, strict=True) if rows else [()] * len(_CONTEXT), _CONTEXT, strict=True)], schema=_CONTEXT)


def common_prefix(x: bytes, y: bytes) -> int:
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    diff = int.from_bytes(x[:n], "big") ^ int.from_bytes(y[:n], "big")
    return n - (diff.bit_length() + 7) // 8


def blind_trie(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """The order of strings and, beside each, how long a prefix it shares with the one before.

    A node holds a depth and children by the byte there (-1: the string ends); bytes between depths are skipped, so a string finds a
    leaf by a few of its bytes, is compared with that leaf once, and is put where the two part.
    """
    root: list | None = None  # a leaf is [None, indices], an inner node [depth, children]
    for i, s in enumerate(strings):
        if root is None:
            root = [None, [i]]
            continue
        node = root
        while node[0] is not None:
            kids = node[1]
            c = s[node[0]] if node[0] < len(s) else -1
            node = kids[c] if c in kids else next(iter(kids.values()))
        other = strings[node[1][0]]
        same = common_prefix(s, other)
        if same == len(s) == len(other):
            node[1].append(i)
            continue
        parent, node, edge = None, root, None
        while node[0] is not None and node[0] < same:
            parent, edge = node, s[node[0]]
            node = node[1][edge]
        c = s[same] if same < len(s) else -1
        if node[0] == same:
            node[1][c] = [None, [i]]
            continue
        split = [same, {(other[same] if same < len(other) else -1): node, c: [None, [i]]}]
        if parent is None:
            root = split
        else:
            parent[1][edge] = split
    order, shared = [], []
    stack = [(root, 0)] if root is not None else []
    while stack:
        node, above = stack.pop()
        if node[0] is None:
            whole = len(strings[node[1][0]])
            order += node[1]
            shared += [above] + [whole] * (len(node[1]) - 1)
        else:
            kids = sorted(node[1].items(), reverse=True)
            stack += [(kid, node[0]) for _, kid in kids[:-1]] + [(kids[-1][1], above)]
    return order, shared


def deep_shallow(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The order of strings, and beside each the length of the prefix it shares with the one before (0 for the first).

    Multikey quicksort with characters of WORD bytes runs over all groups at once and goes down one character at a time into those
    that are still equal, to SHALLOW bytes; groups that share more are put in order by blind tries.
    """
    n = len(strings)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    head = np.frombuffer(b"".join([s[:SHALLOW].ljust(SHALLOW, b"\0") for s in strings]), np.uint8).reshape(n, SHALLOW)
    chars = head.view(">u8").astype(np.uint64)
    lengths = np.fromiter(map(len, strings), np.int64, n)
    order, group = np.argsort(chars[:, 0], kind="stable"), np.zeros(n, np.int64)
    for depth in range(SHALLOW // WORD):
        if depth:
            again = np.flatnonzero((np.bincount(group, minlength=1)[group]) > 1)  # positions in order whose group has several strings
            part = order[again]
            order[again] = part[np.lexsort((chars[part, depth], group[again]))]
        key = chars[order, depth]
        group = np.cumsum(np.concatenate(([0], (np.diff(group) != 0) | (key[1:] != key[:-1]))))
    shared = np.zeros(n, np.int64)
    if n > 1:
        differs = head[order[1:]] != head[order[:-1]]
        first = np.where(differs.any(axis=1), differs.argmax(axis=1), SHALLOW)
        shared[1:] = np.minimum(first, np.minimum(lengths[order[1:]], lengths[order[:-1]]))
    ends = np.append(np.flatnonzero(np.diff(group)) + 1, n)
    starts = np.concatenate(([0], ends[:-1]))
    for a, z in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True):
        own, lcp = blind_trie([strings[i] for i in order[a:z]])
        order[a:z] = order[a:z][own]
        shared[a + 1 : z] = lcp[1:]
        if a:
            shared[a] = common_prefix(strings[order[a - 1]], strings[order[a]])
        if z < n:
            shared[z] = common_prefix(strings[order[z - 1]], strings[order[z]])
    return order, shared


def repeats(befores: list[bytes], afters: list[bytes], low: np.ndarray, high: np.ndarray, length: int = LENGTH, run: int = RUN) -> np.ndarray:
    """For each anchor and each number of bytes before it, whether the string of the given length that starts there occurs again.

    afters holds the bytes from the anchors on, befores those before them, backwards. In the order of afters, anchors that share a
    prefix of length - d bytes are next to each other, as are those that share d bytes before in the order of befores; two strings
    that start d bytes before their anchors are equal if the anchors meet in both orders.
    """
    n = len(afters)
    found = np.zeros((n, run), bool)
    by_after, shared_after = deep_shallow(afters)
    by_before, shared_before = deep_shallow(befores)
    n_after, n_before = np.fromiter(map(len, afters), np.int64, n), np.fromiter(map(len, befores), np.int64, n)
    after, before = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for d in range(run):
        after[by_after] = np.cumsum(shared_after < length - d)
        own = np.flatnonzero((n_after >= length - d) & (n_before >= d) & (low <= d) & (d < high) & (np.bincount(after)[after] > 1))
        if not len(own):
            continue
        before[by_before] = np.cumsum(shared_before < d)
        key = after[own] * np.int64(n + 2) + before[own]
        order = np.argsort(key, kind="stable")
        same = np.diff(key[order]) == 0
        found[own[order], d] = np.concatenate((same, [False])) | np.concatenate(([False], same))
    return found


def _repeat_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorts a partition's contexts, which come by key, in bounded parts that do not split a key; see _stretches.

    Of equal contexts of a key two are sorted; the starts of further ones are decided by these, so a key of any number of copies needs little memory.
    Digests of single starts only wait for a second one.
    """

    def decided(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
        ids, at, low, high = (np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else [np.zeros(0, np.int64)] * 4
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array((at - high + 1).astype(np.int32)), pa.array((at - low + LENGTH).astype(np.int32))], names=["id", "a", "z"])

    held: list[tuple] = []
    known: list[tuple[int, int, int, int]] = []
    seen: dict[tuple, int] = {}
    single: dict[bytes, tuple | None] = {}
    last = None
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            key, i, at, before, text, low, high = row
            if before == -1:
                known.append((i, at, low, high))
                continue
            if key != last:
                if len(held) >= SORTED:
                    yield _stretches(_context_batch(held))
                    held = []
                last, seen, single = key, {}, {}
            if before == -2:
                if text not in single:
                    single[text] = (i, at, low, high)
                    continue
                if single[text] is not None:
                    known.append(single[text])
                    single[text] = None
                known.append((i, at, low, high))
                continue
            same = (text, before, low, high)
            copies = seen[same] = seen.get(same, 0) + 1
            if copies <= 2:
                held.append(row)
            else:
                first, end = _starts(before, len(text) - before, low, high)
                if first < end:
                    known.append((i, at, first, end))
        yield decided(known)
        known = []
    if held:
        yield _stretches(_context_batch(held))


def _stretches(t: pa.RecordBatch) -> pa.RecordBatch:
    """The repeated stretches of contexts: from the first start to LENGTH bytes after the last of a run of starts."""
    before, texts = t.column("before").to_pylist(), t.column("bytes").to_pylist()
    low, high = t.column("low").to_numpy(), t.column("high").to_numpy()
    found = repeats([x[:k][::-1] for x, k in zip(texts, before, strict=True)], [x[k:] for x, k in zip(texts, before, strict=True)], low, high)
    edge = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    i, first = np.nonzero(edge == 1)
    _, last = np.nonzero(edge == -1)
    at = t.column("at").to_numpy()[i].astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(t.column("id").to_numpy()[i]), pa.array((at - last + 1).astype(np.int32)), pa.array((at - first + LENGTH).astype(np.int32))], names=["id", "a", "z"])


def merged(spans: np.ndarray) -> np.ndarray:
    """Sorted [a, z) rows with those that touch or overlap joined."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate(([True], spans[1:, 0] > reach[:-1]))
    return np.stack((spans[new, 0], reach[np.append(np.flatnonzero(new)[1:] - 1, len(spans) - 1)]), axis=1)


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, bounds = text_bytes(b.column("text"))
        raw, bounds = data.tobytes(), bounds.tolist()
        rows: list[tuple] = []
        for i, found in enumerate(b.column("spans")):
            found, text = found.as_py(), raw[bounds[i] : bounds[i + 1]]
            cuts = merged(np.array([(x["a"], x["z"]) for x in found], np.int64)).tolist() if found else []
            edges = [0, *(x for c in cuts for x in c), len(text)]
            kept = b"".join([text[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True)])
            rows.append((sum(z - a for a, z in cuts), len(cuts), hashlib.sha256(kept).hexdigest(), [{"a": a, "z": z} for a, z in cuts]))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("a", pa.int32()), ("z", pa.int32())])))
        columns = [pa.array(list(x), k) for x, k in zip(zip(*rows, strict=True) if rows else [()] * 4, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("sha"), b.column("salts"), *columns], names=["sha", "salts", "n_removed", "n_spans", "kept_sha256", "spans"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``, and ``spans`` (array of ``a``, ``z``: the removed bytes).

    A byte of a text (UTF-8; null counts as empty) is removed if some 200-byte string that covers it also starts anywhere else in the table,
    its own text included. Repeated rows are separate documents. Spans are maximal. Texts under 200 bytes lose nothing. Other columns
    are ignored; an empty table gives an empty result.

    Copies of a whole text are represented by one of them. In each text, anchors stand for runs of starts (see anchors). Anchors whose
    following bytes occur once are dropped by a count over all texts; the others' contexts meet by key, where deep-shallow sorting decides.
    Anchors that occur more than HOT times are dealt by longer keys, one for each range of starts. A key that occurs more than HOT times too is
    not sorted at all: the digests (128 bits) of its strings meet, after each task has sent two of a kind, so no task holds more than HOT contexts of a key.
    """
    rows, result = _judged(docs)
    hashed = rows.select("doc_id", "sha", "salt", F.octet_length("text").cast("long").alias("n_bytes"))
    return hashed.join(per_salt(result), ["sha", "salt"]).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")


def _judged(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows with their texts' digests (``sha``) and salts; for each distinct text what it loses, and the salts that its rows have."""
    no_id = F.lit(-(1 << 63))
    rows = docs.select("doc_id", F.coalesce("doc_id", no_id).alias("of"), empty_if_null("text").alias("text")).withColumns({"sha": F.sha2("text", 256), "salt": salt("doc_id")})
    hashed = rows.select("of", "sha", "salt", F.octet_length("text").cast("long").alias("n_bytes"))
    groups = hashed.groupBy("sha").agg(F.count("*").alias("copies"), F.min("of").alias("of"), F.max("n_bytes").alias("n_bytes"), salts_of(F.col("salt")).alias("salts"))
    texts = cut(groups.withColumn("id", F.monotonically_increasing_id()))

    places = rows.select("of", "sha", "text").join(texts.where(f"n_bytes >= {LENGTH}").select("of", "sha", "id"), ["of", "sha"]).select("id", "text").mapInArrow(_anchor_rows, "id long, at int, h long")
    salted = places.withColumn("salt", salt("id"))
    often = per_salt(salted.groupBy("h").agg(F.count("*").alias("n"), salts_of(F.col("salt")).alias("salts")).where("n > 1"))
    found = salted.join(often, ["h", "salt"]).groupBy("id").agg(F.collect_list(F.struct("at", "h", "n")).alias("found"))
    hot = texts.select("of", "sha", "id").join(found.where(F.exists("found", lambda x: x["n"] > HOT)), "id")
    keys = rows.select("of", "sha", "text").join(hot, ["of", "sha"]).select("id", "text", "found").mapInArrow(partial(_range_keys, hot=HOT), "id long, at int, low int, key long")
    often = keys.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("key")  # a HOTth of the keys at most
    over = keys.join(F.broadcast(often), "key").groupBy("id").agg(F.collect_list(F.struct("at", "low")).alias("over"))
    found = texts.select("of", "sha", "id").join(found, "id").join(over, "id", "left")
    contexts = rows.select("of", "sha", "text").join(found, ["of", "sha"]).select("id", "text", "found", "over").mapInArrow(partial(_contexts, hot=HOT), "key long, id long, at int, before int, bytes binary, low int, high int")
    spans = contexts.repartition("key").sortWithinPartitions("key").mapInArrow(_repeat_rows, "id long, a int, z int")

    once = texts.where(f"copies = 1 OR n_bytes < {LENGTH}").select("of", "sha", "salts", "id").join(spans.groupBy("id").agg(F.collect_list(F.struct("a", "z")).alias("spans")), "id", "left")
    judged = rows.select("of", "sha", "text").join(once, ["of", "sha"]).select("sha", "salts", "text", "spans").mapInArrow(_removed, "sha string, salts int, n_removed long, n_spans long, kept_sha256 string, spans array<struct<a:int,z:int>>")
    whole = F.array(F.struct(F.lit(0).alias("a"), F.col("n_bytes").cast("int").alias("z")))
    gone = texts.where(f"copies > 1 AND n_bytes >= {LENGTH}").select("sha", "salts", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit(""), 256).alias("kept_sha256"), whole.alias("spans"))
    return rows, judged.dropDuplicates(["sha"]).unionByName(gone)


def without_repeats(docs: DataFrame) -> DataFrame:
    """The rows of docs with all their columns; ``text`` has lost the bytes that repeated_spans removes, and ``n_removed`` says how many.

    Spans may begin or end inside a character; what is left of such a character is dropped too. A null text stays null. Rows find what
    their text loses by its digest, so rows that repeat a doc_id lose what their own texts do.
    """
    _, result = _judged(docs)
    spans = per_salt(result.where("n_removed > 0").select(F.col("sha").alias("__of"), "salts", F.col("spans").alias("__spans"), F.col("n_removed").alias("__removed")), "salts", "__of_salt")
    keyed = docs.withColumns({"__sha": F.sha2(empty_if_null("text"), 256), "__salt": salt("doc_id")})
    joined = keyed.join(spans, (F.col("__sha") == F.col("__of")) & (F.col("__salt") == F.col("__of_salt")), "left")
    return joined.withColumns({"text": _cut_out("text", "__spans"), "n_removed": F.coalesce("__removed", F.lit(0))}).drop("__sha", "__salt", "__of", "__of_salt", "__spans", "__removed")


@F.pandas_udf(StringType())
def _cut_out(texts: pd.Series, spans: pd.Series) -> pd.Series:
    def kept(text, cuts):
        if text is None or cuts is None:
            return text
        raw, edges = text.encode(), [0, *(x for c in cuts for x in (c["a"], c["z"]))]
        return b"".join([raw[a:z] for a, z in zip(edges[::2], [*edges[1::2], len(raw)], strict=True)]).decode(errors="ignore")

    return pd.Series([kept(t, c) for t, c in zip(texts, spans, strict=True)])
