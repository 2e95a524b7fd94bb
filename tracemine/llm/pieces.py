"""SentencePiece encoding and decoding: a relational lattice of pieces, and Viterbi folded by a higher-order function."""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemine.llm.common import empty_if_null

#: The vocabulary file.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters of the documents that share one table of encoded words.
CHUNK_CHARS = 5_000_000
#: Rows that are looked at together.
ROWS = 500
#: Bytes of text per bucket of units, and the least number of buckets per shuffle partition.
BUCKET_BYTES, BUCKETS = 32 << 20, 4
#: Characters of a unit up to which it goes through the relational lattice; longer ones are folded one by one where they occur, with the same result.
LONGEST_UNIT = 60
SPACE = "▁"
#: What a character without a piece costs more than the worst piece, for each byte it falls back to; steps that costs are rounded to.
FALLBACK, STEP = 10.0, 1e-3
#: Scores below this are of pieces that are never chosen.
UNUSED = -1e8
#: A word's parts, which pieces do not join: letters, digits, and other characters.
PART = re.compile(f"{SPACE}?[^\\W\\d_]+|{SPACE}?\\d+|{SPACE}?(?:(?!{SPACE})[\\W_])+|{SPACE}")
#: Bits of a packed way, from the lowest: id of its last piece, where that starts (a unit of the lattice has at most 63 places), cost. An edge has its end above its own cost.
#: The highest id stands for a character's bytes.
ID, PLACE, COST = 18, 6, 28
BYTES, WAY = (1 << ID) - 1, 1 << ID + PLACE


def piece_table(spark: SparkSession, model: str = MODEL) -> DataFrame:
    """``piece``, ``id``, ``score`` of the model's ordinary pieces. The file's vocabulary has a fixed size, so the table may be broadcast."""
    rows = [(p, i, float(s)) for i, (p, s, kind) in enumerate(vocabulary(model)) if kind == "piece"]
    kinds = (pa.string(), pa.int32(), pa.float64())
    return spark.createDataFrame(pa.table([pa.array(list(x), k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["piece", "id", "score"]))


def vocabulary(model: str = MODEL) -> list[tuple[str, float, str]]:
    """Of each id: its piece (two hex digits for a byte), its score, and its kind (piece, byte or control)."""
    from sentencepiece import SentencePieceProcessor

    p = SentencePieceProcessor(model_file=model)
    name = lambda i: p.id_to_piece(i)[3:5] if p.is_byte(i) else p.id_to_piece(i)
    kind = lambda i: "byte" if p.is_byte(i) else "control" if p.is_control(i) or p.is_unknown(i) else "piece"
    return [(name(i), p.get_score(i), kind(i)) for i in range(p.get_piece_size())]


def words_of(text: str) -> list[str]:
    """A text's words: a space mark and what follows up to the next one, or a line end, or what follows that. Joined, they are the text, with space marks for spaces and one before it."""
    if not text:
        return []
    return (SPACE + text).replace(SPACE, " ").replace(" ", " " + SPACE).replace("\n", " \n ").split(" ")


def units(word: str) -> list[str]:
    """The parts of a word that are encoded by themselves."""
    return [word] if word == "\n" else PART.findall(word)


def encode_words(words: DataFrame, pieces: DataFrame, byte_ids: dict[int, int], keys: tuple[str, ...] = ("word",)) -> DataFrame:
    """``keys`` and ``ids`` for distinct rows of keys, of which one is ``word``: the way through each word's lattice that costs least.

    Substrings up to the longest piece's length are exploded and equi-joined to the pieces, which cost their negative scores; a character
    that is no piece becomes its UTF-8 bytes. Edges are grouped by word, and a fold over them by end keeps the best way to each place.
    Of equal ways the one whose last piece is longest wins. A way (cost, start, id of its last piece) is packed into a long, so the order of
    longs is the order wanted; an edge is the way that it adds, with its end above. Words have LONGEST_UNIT characters at most, which bounds
    each group. If words is partitioned by some of its keys, nothing is shuffled.
    """
    longest, worst = pieces.agg(F.max(F.length("piece")), F.min(F.when(F.col("score") > UNUSED, F.col("score")))).first()
    table = pieces.where(F.col("score") > UNUSED).select("piece", (F.round(-F.col("score") / STEP).cast("long") * WAY + F.col("id")).alias("cost_id"))
    places = words.select(*keys, F.length("word").alias("size"), F.explode(F.sequence(F.lit(1), F.length("word"))).alias("at"))
    subs = places.select(*keys, "at", F.substring("word", F.col("at"), F.lit(longest)).alias("rest"), F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.col("size") - F.col("at") + 1))).alias("n"))
    found = subs.select(*keys, "at", "n", F.left("rest", F.col("n")).alias("piece")).join(F.broadcast(table), "piece", "left").where("cost_id IS NOT NULL OR n = 1")
    none = (F.octet_length("piece") * int((FALLBACK - worst) / STEP)).cast("long") * WAY + BYTES
    edge = (F.col("at") + F.col("n") - 1).cast("long") * (WAY << COST) + (F.col("at") - 1) * (1 << ID) + F.coalesce("cost_id", none)
    grouped = found.groupBy(*keys).agg(F.sort_array(F.collect_list(edge)).alias("edges"))
    start_of = lambda x: F.shiftright(x, ID).bitwiseAND(F.lit((1 << PLACE) - 1)).cast("int")

    def step(s, e):
        """s: the place in work and the best way to it so far, and the best ways to those before; edges come by end, and each place has one."""
        end, start = F.shiftright(e, ID + PLACE + COST).cast("int"), start_of(e)
        before = F.when(start == s["end"], s["best"]).otherwise(F.get(s["done"], start))
        way = before.bitwiseAND(F.lit(-WAY)) + e.bitwiseAND(F.lit((WAY << COST) - 1))
        same = end == s["end"]
        return F.struct(
            end.alias("end"), F.when(same, F.least(s["best"], way)).otherwise(way).alias("best"), F.when(same, s["done"]).otherwise(F.concat(s["done"], F.array(s["best"]))).alias("done")
        )

    begin = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("best"), F.array().cast("array<bigint>").alias("done"))
    ways = grouped.select(*keys, F.aggregate("edges", begin, step, lambda s: F.concat(s["done"], F.array(s["best"]))).alias("ways"))

    def back(s, i):
        way = F.get(F.col("ways"), i)
        piece = F.when(way.bitwiseAND(F.lit(BYTES)) == BYTES, -start_of(way) - 1).otherwise(way.bitwiseAND(F.lit(BYTES)).cast("int"))
        return F.when(s["at"] == i, F.struct(start_of(way).alias("at"), F.concat(F.array(piece), s["path"]).alias("path"))).otherwise(s)

    last = F.size("ways") - 1
    path = F.aggregate(F.sequence(last, F.lit(1), F.lit(-1)), F.struct(last.alias("at"), F.array().cast("array<int>").alias("path")), back, lambda s: s["path"])
    fallback = F.split(F.lit(",".join(str(byte_ids[i]) for i in range(256))), ",").cast("array<int>")  # one constant
    raw = lambda p: F.transform(F.regexp_extract_all(F.hex(F.encode(F.substring("word", -p, F.lit(1)), "UTF-8")), F.lit("(..)"), F.lit(1)), lambda h: F.get(fallback, F.conv(h, 16, 10).cast("int")))
    spelled = F.flatten(F.transform("path", lambda p: F.when(p >= 0, F.array(p)).otherwise(raw(p))))
    return ways.select(*keys, path.alias("path")).select(*keys, F.when(F.exists("path", lambda p: p < 0), spelled).otherwise(F.col("path")).alias("ids"))


class Pieces:
    """The same lattice for one long unit: a fold over its places, which keeps the best way to each. Time and memory grow with the unit's length."""

    def __init__(self, model: str):
        vocab = vocabulary(model)
        used = [(p, round(-s / STEP), i) for i, (p, s, kind) in enumerate(vocab) if kind == "piece" and s > UNUSED]
        self.table = {p: (cost, i) for p, cost, i in used}
        self.longest = max(len(p) for p in self.table)
        self.fallback = int((FALLBACK + max(-s for _, s, kind in vocab if kind == "piece" and s > UNUSED)) / STEP)
        self.byte_ids = {int(p, 16): i for i, (p, _, kind) in enumerate(vocab) if kind == "byte"}

    def encode(self, unit: str) -> list[int]:
        costs, starts, ids = [0], [0], [-1]
        for end in range(1, len(unit) + 1):
            best = None
            for start in range(max(0, end - self.longest), end):  # of equal ways the longest last piece comes first
                found = self.table.get(unit[start:end])
                if found is None and end - start == 1:
                    found = (self.fallback * len(unit[start:end].encode()), -1)
                if found is not None and (best is None or costs[start] + found[0] < best[0]):
                    best = (costs[start] + found[0], start, found[1])
            costs.append(best[0])
            starts.append(best[1])
            ids.append(best[2])
        out: list[int] = []
        end = len(unit)
        while end:
            start = starts[end]
            out += [ids[end]] if ids[end] >= 0 else [self.byte_ids[b] for b in reversed(unit[start:end].encode())]
            end = start
        return out[::-1]


def _pressed(x: np.ndarray) -> bytes:
    """An array of whole numbers from 0 to 2**32 - 1, its lowest, second, ... bytes apart, as these are alike among themselves."""
    return zstandard.compress(x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpressed(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype(np.int64)


_NUMBERS = ("docs", "words", "units_of", "unit_at")
_CHUNK = "chunk string, ids binary, units binary, " + ", ".join(f"{k} binary" for k in _NUMBERS)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's documents in chunks of about CHUNK_CHARS, each named by its contents.

    ids: the doc_ids, as an Arrow stream; docs: how many words each document has; words: the number of each word, by place; units_of: how many units each
    word has; unit_at: the number of each of its units. units are the distinct ones, sorted.
    """
    index: dict[str, int] = {}
    ids: list[pa.Array] = []
    sizes: list[int] = []
    places: list[np.ndarray] = []
    chars = 0

    def chunk() -> pa.RecordBatch:
        number: dict[str, int] = {}
        units_of, unit_at = array("i"), array("i")
        for w in index:
            own = units(w)
            units_of.append(len(own))
            unit_at.extend([number.setdefault(u, len(number)) for u in own])
        n_words = len(index)
        index.clear()
        distinct = sorted(number)
        sorted_at = np.empty(len(distinct), np.int32)
        sorted_at[np.fromiter(map(number.__getitem__, distinct), np.int64, len(distinct))] = np.arange(len(distinct), dtype=np.int32)
        number.clear()
        at = np.concatenate(places)
        by_use = np.argsort(-np.bincount(at, minlength=n_words), kind="stable")  # common words get small numbers, which take less room
        rank = np.empty(n_words, np.int32)
        rank[by_use] = np.arange(n_words, dtype=np.int32)
        each = np.frombuffer(units_of, np.int32).astype(np.int64)
        of_unit = _gathered(np.cumsum(each) - each, each, sorted_at[np.frombuffer(unit_at, np.int32)] if unit_at else np.zeros(0, np.int32), by_use)
        numbers = (np.array(sizes), rank[at], each[by_use], of_unit)
        sink = pa.BufferOutputStream()
        table = pa.table({"doc_id": pa.chunked_array(ids, pa.int64())})
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        parts_of = [zstandard.compress(sink.getvalue().to_pybytes(), 1), zstandard.compress(" ".join(distinct).encode(), 3), *map(_pressed, numbers)]
        name = hashlib.blake2b(b"".join(parts_of), digest_size=16).hexdigest()
        return pa.RecordBatch.from_arrays([pa.array([name]), *(pa.array([x], pa.binary()) for x in parts_of)], names=["chunk", "ids", "units", *_NUMBERS])

    for whole in batches:
        for b in (whole.slice(i, ROWS) for i in range(0, len(whole), ROWS)):
            lo = 0
            for i, text in enumerate(b.column("text").to_pylist()):
                words = words_of(text)
                sizes.append(len(words))
                places.append(np.fromiter([index.setdefault(w, len(index)) for w in words], np.int32, len(words)))
                chars += len(text)
                if chars >= CHUNK_CHARS:
                    ids.append(b.column("doc_id").slice(lo, i + 1 - lo))
                    yield chunk()
                    pa.default_memory_pool().release_unused()
                    ids, sizes, places, chars, lo = [], [], [], 0, i + 1
            if lo < len(b):
                ids.append(b.column("doc_id").slice(lo))
    if sizes:
        yield chunk()


def _names(raw: bytes) -> list[str]:
    """The distinct units of a chunk; none has a space."""
    text = zstandard.decompress(raw).decode()
    return text.split(" ") if text else []


def _asking(buckets: int):
    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each chunk and bucket the chunk's units in it, but for those that are encoded in place, in lines after the chunk's name."""
        for b in batches:
            for chunk, raw in zip(b.column("chunk").to_pylist(), b.column("units"), strict=True):
                names = _names(raw.as_py())
                order, of = _dealt(names, buckets)
                ends = np.append(np.flatnonzero(np.diff(of)) + 1, len(of)) if len(of) else np.zeros(0, np.int64)
                starts = np.concatenate(([0], ends[:-1])) if len(of) else ends
                lines = ["\n".join((chunk, *(names[i] for i in order[a:z]))) for a, z in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(of[starts].astype(np.int32), pa.int32()), pa.array(lines, pa.string())], names=["bucket", "lines"])

    return asked


def _dealt(names: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of a chunk's units are asked for, by bucket and then in order, and the bucket of each."""
    of = np.fromiter((zlib.crc32(u.encode()) % buckets if _is_asked(u) else buckets for u in names), np.int64, len(names))
    order = np.argsort(of, kind="stable")[: int((of < buckets).sum())]
    return order, of[order]


def _is_asked(unit: str) -> bool:
    return len(unit) <= LONGEST_UNIT and "\n" not in unit


def _answered(asked: pa.Table, known: pa.Table) -> pa.Table:
    """For each chunk that asks for units of a bucket, how many ids each has, and the ids, in the same order."""
    index = {w: i for i, w in enumerate(known["word"].to_pylist())}
    starts, sizes, flat = _lists(known["ids"])
    rows = []
    for bucket, lines in zip(asked["bucket"].to_pylist(), asked["lines"].to_pylist(), strict=True):
        chunk, *words = lines.split("\n")
        at = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
        rows.append((chunk, bucket, zstandard.compress(sizes[at].astype(np.uint8).tobytes(), 3), zstandard.compress(_gathered(starts, sizes, flat, at).astype(np.uint16).tobytes(), 3)))
    kinds = (pa.string(), pa.int32(), pa.binary(), pa.binary())
    return pa.table([pa.array(list(x), k) for x, k in zip(zip(*rows, strict=True) if rows else [()] * 4, kinds, strict=True)], names=["of", "bucket", "sizes", "ids"])


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lists = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    return np.cumsum(sizes) - sizes, sizes, lists.flatten().to_numpy()


def _gathered(starts: np.ndarray, sizes: np.ndarray, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The lists at these indices, one after the other."""
    n = sizes[at]
    ends = np.cumsum(n)
    return flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts[at] - ends + n, n)]


def _assembler(model: str, buckets: int, newline: int, spelled=None):
    def assemble(chunks: pa.Table, answers: pa.Table) -> pa.Table:
        """Ids of each document of a chunk, put together from its units'. Units that were not asked for are encoded here. With spelled (a broadcast), also what the ids decode to."""
        schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), *([] if spelled is None else [("text", pa.string())])])
        if not len(chunks):
            return schema.empty_table()
        chunk = {k: chunks[k][0].as_py() for k in ("ids", "units", *_NUMBERS)}  # chunks of the same name hold the same rows
        names = _names(chunk["units"])
        asked, _ = _dealt(names, buckets)
        rows = sorted(zip(answers["bucket"].to_pylist(), answers["sizes"].to_pylist(), answers["ids"].to_pylist(), strict=True))
        asked_sizes = np.concatenate([np.frombuffer(zstandard.decompress(n), np.uint8) for _, n, _ in rows] or [np.zeros(0, np.uint8)]).astype(np.int64)
        flat = [np.frombuffer(zstandard.decompress(x), np.uint16) for _, _, x in rows]
        sizes, starts, total = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64), int(asked_sizes.sum())
        sizes[asked], starts[asked] = asked_sizes, np.cumsum(asked_sizes) - asked_sizes
        here = np.ones(len(names), bool)
        here[asked] = False
        own = None
        for i in np.flatnonzero(here).tolist():
            if names[i] != "\n" and own is None:
                own = Pieces(model)
            ids = [newline] if names[i] == "\n" else own.encode(names[i])
            starts[i], sizes[i], total = total, len(ids), total + len(ids)
            flat.append(np.array(ids, np.uint16))
        del names
        docs, words, units_of, unit_at = (_unpressed(chunk[k]) for k in _NUMBERS)
        values = np.concatenate(flat).astype(np.int32) if flat else np.zeros(0, np.int32)
        # ids by word, then by document
        by_word = _gathered(starts, sizes, values, unit_at)
        edges = np.concatenate(([0], np.cumsum(sizes[unit_at])))[np.concatenate(([0], np.cumsum(units_of)))]
        word_sizes = np.diff(edges)
        ends = np.concatenate(([0], np.cumsum(docs)))
        parts = [_gathered(edges[:-1], word_sizes, by_word, words[a:z]) for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        lengths = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        doc_ids = pa.ipc.open_stream(zstandard.decompress(chunk["ids"])).read_all()["doc_id"].combine_chunks()
        lists = pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(np.concatenate(parts), pa.int32()))
        del parts, by_word, docs, words, units_of, unit_at
        columns = [doc_ids, lists] if spelled is None else [doc_ids, lists, _texts(lists, spelled.value)]
        pa.default_memory_pool().release_unused()
        return pa.concat_tables([pa.table(columns, schema=schema)] * len(chunks))

    return assemble


def encode(docs: DataFrame, model: str = MODEL, decoded: bool = False) -> DataFrame:
    """One row per document: ``doc_id``, ``ids``, the pieces of its whole text; if decoded, also ``text``, which the task that has put the ids together gets back from them, as decode does.

    Text is marked as SentencePiece does: spaces become space marks, with one before the text. Pieces do not cross from one word to the
    next, nor between letters, digits and other characters (see units). Null and empty texts have no ids. Rows that repeat are kept; other
    columns are ignored. An empty table gives an empty result. The model may have 65,535 pieces at most.

    A task sorts its documents and packs them into chunks, so that doing it again gives the same ones in whatever order rows arrive. A chunk's
    distinct units go to buckets, whose number grows with the text. There all units of the table go through the lattice once each,
    and their ids go back to the chunks, where documents are put together. No group is larger than a chunk or a bucket. Units of over
    LONGEST_UNIT characters (runs without spaces, such as urls or scripts that use none) take the same least-cost way, by a fold in the task
    that puts their document together.
    """
    spark = docs.sparkSession
    byte_ids = {int(p, 16): i for i, (p, _, kind) in enumerate(vocabulary(model)) if kind == "byte"}
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select("doc_id", empty_if_null("text").alias("text"))
    buckets = max(BUCKETS * partitions, (texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BUCKET_BYTES)
    # both uses of the chunks read this one exchange
    chunks = texts.sortWithinPartitions("doc_id", F.xxhash64("text")).mapInArrow(_chunks, _CHUNK).repartition(partitions, "chunk")
    asked = chunks.mapInArrow(_asking(buckets), "bucket int, lines string").repartition(buckets, "bucket")
    distinct = asked.select("bucket", F.posexplode(F.split("lines", "\n")).alias("line", "word")).where("line > 0").select("bucket", "word").distinct()
    known = encode_words(distinct, piece_table(spark, model), byte_ids, ("bucket", "word")).withColumnRenamed("bucket", "of")
    answers = asked.groupBy("bucket").cogroup(known.groupBy("of")).applyInArrow(_answered, "of string, bucket int, sizes binary, ids binary")
    assemble = _assembler(model, buckets, byte_ids[10], spark.sparkContext.broadcast(_spelled(model)) if decoded else None)
    return chunks.groupBy("chunk").cogroup(answers.groupBy("of")).applyInArrow(assemble, "doc_id long, ids array<int>" + (", text string" if decoded else ""))


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """Adds ``text`` to rows with ``ids``: the pieces' bytes one after the other, read as UTF-8 (broken characters become U+FFFD), with spaces for space marks and without the first.

    Control ids and ids outside the vocabulary add nothing; null ids give null. Other columns stay as they are.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(_spelled(model))

    @F.arrow_udf("string")
    def text_of(column: pa.Array) -> pa.Array:
        return _texts(column, shared.value)

    return encoded.withColumn("text", text_of("ids"))


def _spelled(model: str) -> list[bytes]:
    """The bytes of each id, and none for the place after the last."""
    return [bytes.fromhex(p) if kind == "byte" else p.encode() if kind == "piece" else b"" for p, _, kind in vocabulary(model)] + [b""]


def _texts(column: pa.Array, spelled: list[bytes]) -> pa.Array:
    """What lists of ids decode to."""
    table, sizes = np.frombuffer(b"".join(spelled), np.uint8), np.fromiter(map(len, spelled), np.int64)
    starts, last = np.cumsum(sizes) - sizes, len(sizes) - 1
    out: list[str | None] = []
    for part in (column.slice(i, ROWS // 5) for i in range(0, len(column), ROWS // 5)):
        lists = pa.chunked_array([part.fill_null([])]).combine_chunks() if part.null_count else part
        ids = lists.flatten().to_numpy(zero_copy_only=False)
        at = np.where((ids < 0) | (ids > last), last, ids)
        raw = _gathered(starts, sizes, table, at).tobytes()
        ends = np.concatenate(([0], np.cumsum(sizes[at])))[np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))))].tolist()
        for known, a, z in zip(part.is_valid().to_pylist(), ends, ends[1:], strict=False):
            text = raw[a:z].decode("utf-8", "replace").replace(SPACE, " ")
            out.append((text[1:] if text.startswith(" ") else text) if known else None)
    pa.default_memory_pool().release_unused()
    return pa.array(out, pa.string())
