"""Language identification: script ranges narrow the candidates, then Viterbi over per-word scores labels spans of mixed-language text."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemine.llm.common import empty_if_null, held_out

#: Documents that the model is fitted on, about (a hash of doc_id picks them); hashed n-grams that it counts per language.
TRAIN_DOCS, SLOTS = 20_000, 1 << 16
#: What a change of language between two words costs, in units of log probability; how many languages a model may hold.
SWITCH, MOST_LANGS = 8.0, 256
#: A language is a candidate for a word in some script if this share of its letters is in that script.
SCRIPT_SHARE = 0.01
#: Characters that are scored at a time.
BLOCK = 1 << 20

#: First code points of the ranges, and the script of each; other letters are "other".
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0900, "devanagari"), (0x0980, "bengali"),
    (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"),
    (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1300, "other"),
    (0x1780, "khmer"), (0x1800, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "han"), (0xA000, "other"), (0xAC00, "hangul"),
    (0xD800, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "other"),
)
_FIRST, _NAMES = np.array([x for x, _ in SCRIPTS]), sorted({x for _, x in SCRIPTS})
_SCRIPT = np.array([_NAMES.index(x) for _, x in SCRIPTS])


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point: its lower-case form (one code point), whether it is a letter, and whether it is a mark."""
    kinds = np.frombuffer("".join(unicodedata.category(chr(i))[0] for i in range(0x110000)).encode(), np.uint8)
    letter, lower = kinds == ord("L"), np.arange(0x110000, dtype=np.uint32)
    for i in np.flatnonzero(letter).tolist():
        c = chr(i).lower()
        if len(c) == 1:
            lower[i] = ord(c)
    return lower, letter, kinds == ord("M")


@dataclass
class Model:
    langs: list[str]
    #: Log probability of an n-gram by slot and language.
    grams: np.ndarray
    #: Whether a language is a candidate, by script and language.
    allowed: np.ndarray


def word_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased letters of all words, each word after a zero; where the words begin (at that zero); the text of each word.

    A word begins with a letter and goes on with letters and marks; marks without a letter before them are no words.
    """
    lower, letter, mark = _tables()
    joined = "\0".join(texts) + "\0"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    place, first = np.arange(len(codes)), letter[codes]
    either = first | mark[codes]
    ok = either & (np.maximum.accumulate(np.where(first, place, -1)) > np.maximum.accumulate(np.where(either, -1, place)))
    text = np.repeat(np.arange(len(texts)), np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    keep = ok.copy()
    keep[1:] |= ok[1:] | ok[:-1]  # the place after a word holds the next word's zero
    keep[:-1] |= ok[1:] & ~ok[:-1]
    begins = ok & ~np.concatenate(([False], ok[:-1]))
    at = np.flatnonzero(begins)
    size = np.flatnonzero(ok & ~np.concatenate((ok[1:], [False]))) - at + 1
    starts = np.cumsum(size + 1) - size - 1
    out = np.zeros(int((size + 1).sum()), np.uint32)
    inside = np.ones(len(out), bool)
    inside[starts] = False
    out[inside] = lower[codes[ok]]
    return out, starts, text[at]


def grams(codes: np.ndarray) -> list[np.ndarray]:
    """Slots of the one-, two- and three-letter n-grams that end at each place; a word's zero is its first letter's neighbour."""
    c = codes.astype(np.uint64)
    one = np.concatenate((np.zeros(2, np.uint64), c))
    two, three = one[1:-1] * np.uint64(1 << 21) + c, (one[:-2] * np.uint64(1 << 21) + one[1:-1]) * np.uint64(1 << 21) + c
    two = np.where(c == 0, np.uint64(0), two)
    three = np.where((c == 0) | (one[1:-1] == 0), two, three)  # never reaches into the word before
    return [((x * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(n)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48)).astype(np.int64) % SLOTS for n, x in enumerate((c, two, three))]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a partition's counts: language, kind (0: n-gram slot, 1: script), index, count."""
    sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for b in batches:
        langs, texts = b.column("lang").to_pylist(), b.column("text").to_pylist()
        for lang in set(langs):
            slots, scripts = sums.setdefault(lang, (np.zeros(SLOTS, np.int64), np.zeros(len(_NAMES), np.int64)))
            codes, _, _ = word_codes([t for t, x in zip(texts, langs, strict=True) if x == lang])
            for g in grams(codes):
                slots += np.bincount(g[codes > 0], minlength=SLOTS)
            scripts += np.bincount(_SCRIPT[np.searchsorted(_FIRST, codes[codes > 0], side="right") - 1], minlength=len(_NAMES))
    for lang, parts in sums.items():
        for kind, x in enumerate(parts):
            at = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(np.full(len(at), kind)), pa.array(at), pa.array(x[at])], names=["lang", "kind", "slot", "n"])


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """Counts n-grams and scripts by language over about ``train_docs`` documents with a language, chosen by a hash of doc_id.

    Each partition sends its sums, which are added up by key; the driver gets at most (SLOTS + scripts) numbers for each of at most
    MOST_LANGS languages (more are an error, as such a column is no language code).
    """
    known = docs.where("lang IS NOT NULL").select("doc_id", "lang", "text").where(~held_out())
    n = known.count()
    if n > train_docs:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(train_docs / n * (1 << 30)))
    sums = known.select("lang", empty_if_null("text").alias("text")).mapInArrow(_counts, "lang string, kind long, slot long, n long").groupBy("lang", "kind", "slot").agg(F.sum("n").alias("n"))
    rows = sums.limit(MOST_LANGS * (SLOTS + len(_NAMES)) + 1).toArrow()
    langs = sorted(rows["lang"].unique().to_pylist(), key=lambda x: x.encode())
    if len(langs) > MOST_LANGS:
        raise ValueError(f"the column lang has over {MOST_LANGS} values")
    counts, scripts = np.zeros((SLOTS, len(langs))), np.zeros((len(_NAMES), len(langs)))
    which, kind, slot, n = np.array([langs.index(x) for x in rows["lang"].to_pylist()], np.int64), *(rows[k].to_numpy() for k in ("kind", "slot", "n"))
    counts[slot[kind == 0], which[kind == 0]] = n[kind == 0]
    scripts[slot[kind == 1], which[kind == 1]] = n[kind == 1]
    share = (counts + 0.1) / (counts.sum(axis=0) + 0.1 * SLOTS)
    allowed = scripts >= SCRIPT_SHARE * np.maximum(1, scripts.sum(axis=0))
    return Model(langs, np.log(share).astype(np.float32), allowed)


def word_scores(texts: list[str], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores by word and language, letters of each word, text of each word. A language that is no candidate for a word's script, while another is, scores far below."""
    codes, starts, text = word_codes(texts)
    if not len(starts):
        return np.zeros((0, len(model.langs)), np.float32), np.zeros(0, np.int64), text
    total = np.zeros((len(codes), len(model.langs)), np.float32)
    for g in grams(codes):
        total += model.grams[g]
    total[codes == 0] = 0
    scores = np.add.reduceat(total, starts, axis=0)
    script = _SCRIPT[np.searchsorted(_FIRST, codes[starts + 1], side="right") - 1]
    ok = model.allowed[script]
    scores -= np.where(ok | ~ok.any(axis=1, keepdims=True), 0, 1000).astype(np.float32)
    return scores, np.diff(np.append(starts, len(codes))) - 1, text


def viterbi(scores: np.ndarray, counts: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best language of each word, for texts of so many words each, whose words follow each other. All texts go on by one word at a time; ties keep the language, then take the first."""
    n = len(counts)
    order = np.argsort(-counts, kind="stable")
    first = (np.cumsum(counts) - counts)[order]
    longest, active = int(counts.max(initial=0)), n - np.searchsorted(np.sort(counts), np.arange(int(counts.max(initial=0))), side="right")
    best = np.zeros((n, scores.shape[1]), np.float32)
    came = np.zeros(scores.shape, np.int16)  # language of the word before, on the best way to this word's language
    own = np.arange(scores.shape[1], dtype=np.int16)
    for t in range(longest):
        k = active[t]
        at = first[:k] + t
        if t:
            top = best[:k].argmax(axis=1)
            other = best[np.arange(k), top] - switch
            change = other[:, None] > best[:k]
            came[at] = np.where(change, top[:, None], own)
            best[:k] = np.maximum(best[:k], other[:, None])
        best[:k] += scores[at]
    labels = np.zeros(len(scores), np.int16)
    now = best.argmax(axis=1).astype(np.int16)
    for t in range(longest - 1, -1, -1):
        k = active[t]
        at = first[:k] + t
        labels[at] = now[:k]
        now[:k] = came[at, now[:k]]
    return labels


def labelled(texts: list[str], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language, letters and text of each word."""
    parts, lo, size = [], 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= BLOCK or i == len(texts) - 1:
            scores, letters, text = word_scores(texts[lo : i + 1], model)
            parts.append((scores, letters, text + lo))
            lo, size = i + 1, 0
    if not parts:
        return np.zeros(0, np.int16), np.zeros(0, np.int64), np.zeros(0, np.int64)
    scores, letters, text = (np.concatenate(x) for x in zip(*parts, strict=True))
    return viterbi(scores, np.bincount(text, minlength=len(texts))), letters, text


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: ``doc_id``, ``lang_pred``, ``score``, ``n_words``, and ``spans``: array of (``lang``, ``words``), runs of words in one language.

    A text's language is the one that labels most of its letters (ties: first by code point); score is its share of them. A null text,
    one without a letter, or a model without languages gives ``und``, score 0 and no span. The whole text is read. Rows that repeat are labelled alike and each kept, also without a doc_id; other columns are
    ignored, whatever their names; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            n, k = len(b), len(model.langs)
            labels, letters, text = labelled(b.column("text").to_pylist(), model) if k else labelled([""], Model(["und"], np.zeros((SLOTS, 1), np.float32), np.ones((len(_NAMES), 1), bool)))
            total = np.bincount(text * max(k, 1) + labels, weights=letters, minlength=n * max(k, 1))[: n * max(k, 1)].reshape(n, -1)
            whole, best = total.sum(axis=1), total.argmax(axis=1)
            score = total.max(axis=1) / np.maximum(whole, 1)
            names = pa.array([*model.langs, "und"], pa.string())
            edge = np.flatnonzero(np.concatenate(([True], (np.diff(text) != 0) | (np.diff(labels) != 0)))) if len(text) else np.zeros(0, np.int64)
            runs = pa.StructArray.from_arrays([names.take(pa.array(labels[edge].astype(np.int64))), pa.array(np.diff(np.append(edge, len(text))))], names=["lang", "words"])
            offsets = np.concatenate(([0], np.cumsum(np.bincount(text[edge], minlength=n)[:n]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), names.take(pa.array(np.where(whole > 0, best, k))), pa.array(score), pa.array(np.bincount(text, minlength=n)[:n]), pa.ListArray.from_arrays(pa.array(offsets), runs)],
                names=["doc_id", "lang_pred", "score", "n_words", "spans"],
            )

    return docs.select("doc_id", empty_if_null("text").alias("text")).mapInArrow(rows, "doc_id long, lang_pred string, score double, n_words long, spans array<struct<lang:string,words:long>>")
