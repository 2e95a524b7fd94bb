"""Cross-tokenizer alignment: where the tokens of a byte-level BPE (A) and of a SentencePiece model (B) end together."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemine.llm.common import cut, empty_if_null, written

#: The vocabulary files.
BYTE_BPE, PIECES = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Characters of the documents that share one table of units; characters of the units that a task remembers.
CHUNK_CHARS, REMEMBERED = 3_000_000, 4_000_000
#: Where a text may be cut for both tokenizers: a space between characters that are none. A's words start with such a space, and so do B's pieces.
BETWEEN = re.compile(r"(?<=\S) (?=\S)")
#: The characters by which byte-level vocabularies write the bytes; others than these ranges follow from 256 on, in order.
PLAIN = (*range(33, 127), *range(161, 173), *range(174, 256))
_PART = "chunk long, kind int, place int, a int, b int, n long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, units binary, pairs binary"
_FOUND = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups")


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    rest = [b for b in range(256) if b not in PLAIN]
    return {chr(b): b for b in PLAIN} | {chr(256 + i): b for i, b in enumerate(rest)}


def refined(ends: np.ndarray, vague: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Where each of consecutive tokens ends, in bytes. ``ends`` of spans are coarse cuts; that of a vague token, which shares a character with its neighbours, is the end before it and the ``sizes`` of its decoded bytes."""
    so_far = np.cumsum(sizes)
    last = np.maximum.accumulate(np.where(vague, -1, np.arange(len(ends))))  # the token, this one or before, whose span is its own
    return so_far + np.where(last >= 0, ends[last] - so_far[last], 0)


def grouped(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, ...]:
    """How many tokens of each side there are up to each common end, how many links each has, and the links: the places of all pairs of tokens that end together (several, if a token has no bytes)."""
    common = np.intersect1d(ends_a, ends_b)
    (first_a, upto_a), (first_b, upto_b) = ([np.searchsorted(e, common, side) for side in ("left", "right")] for e in (ends_a, ends_b))
    of_b = upto_b - first_b
    n = (upto_a - first_a) * of_b
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return upto_a, upto_b, n, np.repeat(first_a, n) + at // np.repeat(of_b, n), np.repeat(first_b, n) + at % np.repeat(of_b, n)


def byte_ends(ends: list[int], vague: list[bool], tokens: list[bytes]) -> list[int]:
    """``refined`` for the tokens of one text."""
    return refined(np.array(ends, np.int64), np.array(vague, bool), np.array([len(t) for t in tokens], np.int64)).tolist()


def groups_of(ends_a: list[int], ends_b: list[int]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """``grouped`` for the tokens of one text: how many of each side there are up to each common end, and the pairs."""
    upto_a, upto_b, _, x, y = grouped(np.array(ends_a, np.int64), np.array(ends_b, np.int64))
    return list(zip(upto_a.tolist(), upto_b.tolist(), strict=True)), list(zip(x.tolist(), y.tolist(), strict=True))


def _pick(values: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The values of the runs at ``at``, where run i has sizes[i] of them."""
    starts, n = np.cumsum(sizes) - sizes, sizes[at]
    return values[np.repeat(starts[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())]


class Tokenizers:
    """Both tokenizers and what they have encoded. Units, which both encode by themselves, are encoded together, and once while REMEMBERED characters of them are kept.

    Of each unit kept: in ``sizes`` whether its tokens' bytes are its own, and the numbers of its tokens, groups and links; in ``said`` its groups as text; in ``links`` the linked ids, of all units in one row.
    """

    def __init__(self, bpe: str = BYTE_BPE, model: str = PIECES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks share the cores
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(bpe), SentencePieceProcessor(model_file=model)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        of, size = byte_of(), self.b.get_piece_size()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for t, i in vocabulary.items():
            self.bytes_a[i] = bytes(of[c] for c in t) if all(c in of for c in t) else t.encode()
        self.is_byte = np.array([self.b.is_byte(i) for i in range(size)])
        names = [self.b.id_to_piece(i) for i in range(size)]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if raw else p.replace("▁", " ").encode() for p, raw in zip(names, self.is_byte, strict=True)]
        self.sizes_a, self.sizes_b = (np.array([len(t) for t in x], np.int64) for x in (self.bytes_a, self.bytes_b))
        #: Each id with what follows it: within a side of a group or at its end; for B also at a unit's end.
        self.written = np.array([f"{i}{c}" for n, ends in ((len(self.bytes_a), ",|"), (size, ",;\n")) for i in range(n) for c in ends], object)
        self.joins = any(re.search("[^▁]▁", p) for p in names)  # then spaces inside pieces do not cut
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.said: list[str] = []
        self.sizes, self.links, self.chars = np.zeros((0, 5), np.int64), np.zeros(0, np.int64), 0

    def cut(self, text: str) -> list[str]:
        """The units of a text, without the space before each."""
        return [] if not text else [text] if self.joins else BETWEEN.split(text)

    def encode(self, units: list[str]) -> tuple[np.ndarray, list[str], np.ndarray]:
        """The ``sizes``, ``said`` and ``links`` of distinct units."""
        if self.chars > REMEMBERED:
            self._forget()
        new = [u for u in units if u not in self.known]
        if new:
            sizes, said, links = self._new(new)
            self.known.update(zip(new, range(len(self.said), len(self.said) + len(new)), strict=True))
            self.said += said
            self.sizes, self.links = np.concatenate((self.sizes, sizes)), np.concatenate((self.links, links))
            self.chars += sum(map(len, new))
        at = np.array([self.known[u] for u in units], np.int64)
        return self.sizes[at], [self.said[i] for i in at.tolist()], _pick(self.links, self.sizes[:, 4], at)

    def _new(self, units: list[str]) -> tuple[np.ndarray, list[str], np.ndarray]:
        found = self.a.encode_batch([" " + u for u in units], add_special_tokens=False)
        ids = [e.ids for e in found]
        n_a = np.array([len(x) for x in ids], np.int64)
        ids_a = np.fromiter(chain.from_iterable(ids), np.int64, n_a.sum())
        # A's offsets count characters, of which tokens may share one; B's count the text's bytes, and pieces of single bytes have none of their own
        spans_a = np.fromiter(chain.from_iterable(chain.from_iterable(e.offsets for e in found)), np.int64, 2 * len(ids_a)).reshape(-1, 2)
        pieces = [s.pieces for s in self.b.encode(units, return_type="proto", num_threads=1)]
        n_b = np.array([len(x) for x in pieces], np.int64)
        ids_b, spans_b = np.array([(p.id, p.end) for x in pieces for p in x], np.int64).reshape(-1, 2).T

        text = "".join([" " + u for u in units])
        chars = np.array([len(u) + 1 for u in units], np.int64)
        ok = self._whole(text, chars, n_a, ids_a, n_b, ids_b)
        sizes = np.stack((ok, n_a, n_b, np.zeros_like(n_a), np.zeros_like(n_a)), axis=1)
        if not ok.all():
            own_a, own_b, text = np.repeat(ok, n_a), np.repeat(ok, n_b), "".join([" " + u for u, good in zip(units, ok.tolist(), strict=True) if good])
            ids_a, spans_a, ids_b, spans_b, n_a, n_b, chars = ids_a[own_a], spans_a[own_a], ids_b[own_b], spans_b[own_b], n_a[ok], n_b[ok], chars[ok]

        start, firsts = _starts(text), np.cumsum(chars) - chars
        unit_a, unit_b = np.repeat(np.arange(len(chars)), n_a), np.repeat(np.arange(len(chars)), n_b)
        spans_a = spans_a + firsts[unit_a][:, None]
        vague = np.append(spans_a[1:, 0] < spans_a[:-1, 1], False)[: len(spans_a)]
        # a place between units, so that no token of one ends where a token of the next starts
        ends_a = refined(start[spans_a[:, 1]], vague, self.sizes_a[ids_a]) + unit_a
        ends_b = refined(start[firsts[unit_b]] + 1 + spans_b, self.is_byte[ids_b], self.sizes_b[ids_b]) + unit_b
        upto_a, upto_b, n, x, y = grouped(ends_a, ends_b)
        unit = unit_a[upto_a - 1]
        sizes[ok, 3] = np.bincount(unit, minlength=len(chars))
        sizes[ok, 4] = np.bincount(unit_a[x], minlength=len(chars))

        group_a, group_b = (np.repeat(np.arange(len(unit)), np.diff(upto, prepend=0)) for upto in (upto_a, upto_b))  # common ends include those of units, so each token has a group
        last_a, last_b = np.zeros((2, max(len(ids_a), len(ids_b))), np.int64)
        last_a[upto_a - 1] = last_b[upto_b - 1] = 1
        last_b[np.cumsum(n_b) - 1] = 2
        codes = np.zeros(len(ids_a) + len(ids_b), np.int64)
        codes[np.arange(len(ids_a)) + np.append(0, upto_b)[group_a]] = 2 * ids_a + last_a[: len(ids_a)]
        codes[np.arange(len(ids_b)) + upto_a[group_b]] = 2 * len(self.bytes_a) + 3 * ids_b + last_b[: len(ids_b)]
        lines = iter("".join(self.written[codes].tolist()).split("\n"))
        return sizes, [next(lines) if good else "" for good in ok.tolist()], ids_a[x] << 32 | ids_b[y]

    def _whole(self, text: str, chars: np.ndarray, n_a: np.ndarray, ids_a: np.ndarray, n_b: np.ndarray, ids_b: np.ndarray) -> np.ndarray:
        """Which of the units that text is made of are the joined bytes of their tokens, on both sides."""
        whole, ends = text.encode(), _starts(text)[np.cumsum(chars)]
        ok = np.ones(len(chars), bool)
        for n, ids, tokens, sizes in ((n_a, ids_a, self.bytes_a, self.sizes_a), (n_b, ids_b, self.bytes_b, self.sizes_b)):
            joined, stops = b"".join([tokens[i] for i in ids.tolist()]), np.append(0, np.cumsum(sizes[ids]))[np.cumsum(n)]
            if joined != whole or (stops != ends).any():
                places = zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), np.append(0, stops[:-1]).tolist(), stops.tolist(), strict=True)
                ok &= np.array([whole[a:b] == joined[s:t] for a, b, s, t in places], bool)
        return ok


def _starts(text: str) -> np.ndarray:
    """Where each character of a text starts in its bytes, and where the last one ends."""
    raw = np.frombuffer(text.encode(), np.uint8)
    return np.append(np.flatnonzero(raw & 0xC0 != 0x80), len(raw))


def _encoded(batches: Iterator[pa.RecordBatch], bpe: str, model: str, spans: bool) -> Iterator[pa.RecordBatch]:
    """Rows of each chunk: its pairs with their counts (kind 0), its units' pairs (1), and its documents with their units (2)."""
    both, schema = Tokenizers(bpe, model), pa.schema([(c.split()[0], {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]]) for c in _PART.split(", ")])
    chunk = TaskContext.get().partitionId() << 32

    def rows(ids: list, texts: list[str]) -> Iterator[pa.RecordBatch]:
        place: dict[str, int] = {}
        each = [np.array([place.setdefault(u, len(place)) for u in both.cut(t)], np.int32) for t in texts]
        sizes, groups, links = both.encode(list(place))
        docs, used = [], []
        for i, own in zip(ids, each, strict=True):
            if len(own) and sizes[own, 0].all():
                used.append(own)
                said = ";".join([groups[k] for k in own.tolist()])
                docs.append((i, *sizes[own, 1:].sum(axis=0).tolist(), hashlib.sha256(said.encode()).hexdigest(), said if spans else None, own.tobytes()))
            else:
                docs.append((i, 0, 0, 0, 0, "", "" if spans else None, b""))
        pairs, places = np.unique(links, return_inverse=True)
        counts = np.zeros(len(pairs), np.int64)
        times = np.bincount(np.concatenate(used), minlength=len(place)) if used else np.zeros(len(place), np.int64)
        np.add.at(counts, places, np.repeat(times, sizes[:, 4]))

        def batch(size: int, kind: int, columns: dict) -> pa.RecordBatch:
            fixed = {"chunk": pa.array(np.full(size, chunk)), "kind": pa.array(np.full(size, kind, np.int32))} | columns
            return pa.RecordBatch.from_arrays([fixed[f.name].cast(f.type) if f.name in fixed else pa.nulls(size, f.type) for f in schema], schema=schema)

        yield batch(len(pairs), 0, {"place": pa.array(np.arange(len(pairs))), "a": pa.array(pairs >> 32), "b": pa.array(pairs & 0xFFFFFFFF), "n": pa.array(counts)})
        yield batch(1, 1, {"units": pa.array([sizes[:, 4].astype(np.int32).tobytes()]), "pairs": pa.array([places.astype(np.int32).tobytes()])})
        names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "units")
        yield batch(len(docs), 2, {k: pa.array([d[j] for d in docs], schema.field(k).type) for j, k in enumerate(names)})

    for b in batches:
        ids, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
        begin = size = 0
        for end, t in enumerate(texts, 1):
            size += len(t)
            if size >= CHUNK_CHARS or end == len(texts):
                yield from rows(ids[begin:end], texts[begin:end])
                begin, size, chunk = end, 0, chunk + 1


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a chunk come by kind: pairs with their counts over all documents, the units' pairs, the documents."""
    known: list[tuple[np.ndarray, ...]] = []
    totals = best = np.zeros(0, np.int64)
    for b in batches:
        kind = b.column("kind").to_numpy()
        docs = []
        runs = [0, *(np.flatnonzero(kind[1:] != kind[:-1]) + 1).tolist(), len(kind)]
        for s, e in zip(runs[:-1], runs[1:], strict=True):
            part = b.slice(s, e - s)
            if kind[s] == 0:
                known.append(tuple(part.column(k).to_numpy(zero_copy_only=False) for k in ("place", "total", "best")))
                continue
            for i in range(part.num_rows):
                if kind[s] == 1:
                    place, total, top = (np.concatenate(x) for x in zip(*known, strict=True)) if known else [np.zeros(0, np.int64)] * 3
                    known = []
                    by_place = np.zeros((2, len(place)), np.int64)
                    by_place[:, place] = total, top
                    sizes, pairs = (np.frombuffer(part.column(k)[i].as_py(), np.int32) for k in ("units", "pairs"))
                    ends = np.cumsum(sizes)
                    summed = np.concatenate((np.zeros((2, 1), np.int64), np.cumsum(by_place[:, pairs], axis=1)), axis=1)
                    totals, best = summed[:, ends] - summed[:, ends - sizes]
                    continue
                own = np.frombuffer(part.column("units")[i].as_py(), np.int32)
                row = [part.column(k)[i].as_py() for k in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
                docs.append((*row, int(best[own].sum()), int(totals[own].sum()), part.column("groups_sha256")[i].as_py(), part.column("groups")[i].as_py()))
        kinds = [*[pa.int64()] * 7, pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([d[j] for d in docs], t) for j, t in enumerate(kinds)], names=list(_FOUND))


def align(docs: DataFrame, bpe: str = BYTE_BPE, model: str = PIECES, spans: bool = False) -> DataFrame:
    """One row per document: ``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256`` and, with spans, ``groups`` itself.

    A encodes a space and the text, B the text, before which it puts a space itself; strings of special tokens are plain text. Offsets at which tokens of both end cut
    them into groups (``a1,a2|b1;a3|b2``); tokens that end together are linked. A pair of ids counts as often as it is linked in all documents; a link is one of ``n_best``
    if no pair of its B id counts more; ``count_sum`` adds the counts up. Null and empty texts, and those whose tokens' bytes are not the space and the text, have no
    tokens: zeros and '', and add to no count. Repeated rows are each counted; rows without a doc_id are kept; other columns are ignored; an empty table gives an empty result.

    Both tokenizers start anew at a single space, so each distinct unit of a chunk of documents is encoded once. A chunk sends its distinct pairs, not its links, to be counted, and gets their counts
    back; the rows of one pair are as many as there are chunks. Vocabularies are files that every executor has.
    """
    rows = docs.select("doc_id", empty_if_null("text").alias("text"))
    parts = written(rows.mapInArrow(partial(_encoded, bpe=bpe, model=model, spans=spans), _PART))
    pairs = parts.where("kind = 0").select("chunk", "place", "a", "b", "n")
    totals = cut(pairs.groupBy("a", "b").agg(F.sum("n").alias("total")))
    tops = totals.groupBy("b").agg(F.max("total").alias("top"))
    counted = totals.join(tops, "b").select("a", "b", "total", (F.col("total") == F.col("top")).cast("long").alias("best"))
    back = pairs.join(counted, ["a", "b"]).select("chunk", F.lit(0).alias("kind"), "place", "total", "best")
    rest = parts.where("kind > 0").drop("place", "a", "b", "n")
    together = back.unionByName(rest, allowMissingColumns=True).repartition("chunk").sortWithinPartitions("chunk", "kind")
    kinds = {"groups_sha256": "string", "groups": "string"}
    found = together.mapInArrow(_scored, ", ".join(f"{c} {kinds.get(c, 'long')}" for c in _FOUND))
    return found if spans else found.drop("groups")
