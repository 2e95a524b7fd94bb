"""MinHash near-dedup, token alignment and vector codes against brute force."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.test_operators import SCHEMA, SF, awkward, empty, rows_of  # noqa: F401
from tracemine.llm import alignment, minhash, neargroups, queries, simhash, vectorcodes
from tracemine.llm.common import table

# MinHash


def split(t):
    """A text's words, lower-cased."""
    low = t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return [x for x in low.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if x]


def roots_by_hand(texts, size, percent):
    """Every pair of different texts is compared. The set of each text, and what finds the root of its group."""
    sets = {}
    for t in texts:
        w = split(t)
        sets[t] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    texts = [t for t in sets if sets[t]]
    root = {t: t for t in texts}

    def top(t):
        while root[t] != t:
            t = root[t]
        return t

    for i, a in enumerate(texts):
        for b in texts[:i]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[top(a)] = top(b)
    return sets, top


def groups_by_hand(rows, size, percent):
    """Rows that share a text are one node."""
    sets, top = roots_by_hand([t for _, t in rows], size, percent)
    ids = defaultdict(list)
    for i, t in rows:
        if sets[t] and i is not None:
            ids[top(t)].append(i)
    out = []
    for i, t in rows:
        least = (min(ids[top(t)]) if ids[top(t)] else None) if sets[t] else i
        out.append((i, len(sets[t]), least, i == least))
    return Counter(out)


def near_rows(seed):
    """A base with variants that are near it but not near each other, a chain of drifting texts, short texts, and unrelated ones."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base = [word() for _ in range(60)]
    texts = [" ".join(base)]
    for _ in range(60):
        own = list(base)
        own[rng.randrange(60)] = word()
        texts.append(" ".join(own))
    chain = [word() for _ in range(80)]
    for i in range(25):
        chain = [*chain[:-1], word()] if i % 2 else [word(), *chain[1:]]
        chain = chain[1:] + [word()]
        texts.append(" ".join(chain))
    texts += [" ".join(base[:n]) for n in range(1, 12)] + [" ".join(word() for _ in range(rng.randint(1, 60))) for _ in range(60)]
    texts += [texts[3].upper(), "  ".join(texts[4].split()), texts[5], texts[5]]
    rng.shuffle(texts)
    return [(i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("size", "percent", "tile"), [(4, 80, 4096), (5, 80, 7), (4, 85, 16)])
def test_near_groups_equal_all_pairs(spark, monkeypatch, size, percent, tile):
    """Small tiles deal one bucket to many tasks."""
    monkeypatch.setattr(neargroups, "TILE", tile)
    rows = near_rows(size)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_groups(docs, size, percent).collect())
    assert found == groups_by_hand(rows, size, percent)
    assert max(Counter(k[2] for k in found).values()) > 50


def test_near_groups_of_awkward_rows(awkward, empty):  # noqa: F811
    found = Counter((r["doc_id"], r["n_shingles"], r["component_id"], bool(r["kept"])) for r in minhash.near_groups(awkward, 4).collect())
    assert found == groups_by_hand(rows_of(awkward), 4, 80)
    assert minhash.near_groups(empty).count() == 0


def test_densified_bins_agree_as_often_as_sets_are_alike():
    """Also for sets of a few hashes, whose bins are mostly empty."""
    rng = np.random.default_rng(3)
    for n, shared in ((5, 4), (40, 32), (2000, 1600)):
        shares = []
        for _ in range(30):
            x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
            shares.append((minhash.signature(x) == minhash.signature(np.sort(rng.permutation(x)[:shared]))).mean())
        assert abs(np.mean(shares) - shared / n) < 0.04
    assert (minhash.signature(np.array([5], np.uint64)) == 5).all()


# near-dedup by a wide SimHash


def kept_by_hand(rows, size=5, percent=80):
    """Of each group the row with the smallest doc_id, null last, then the smallest digest of words; blank texts all stay."""
    sets, top = roots_by_hand([t for _, t in rows], size, percent)
    first, out = {}, Counter()
    for i, t in rows:
        if not sets[t]:
            out[i, t] += 1
            continue
        words = " ".join(split(t))
        key = (i is None, i or 0, xxhash.xxh3_128_digest(words.encode()))
        if top(t) not in first or key < first[top(t)][1]:
            first[top(t)] = ((i, words), key)
    return out, Counter(v[0] for v in first.values())


def check_kept(found, rows, **how):
    """Rows of equal words and doc_id may stand for each other."""
    blank, first = kept_by_hand(rows, **how)
    assert Counter((i, t) for i, t in found if not split(t)) == blank
    assert Counter((i, " ".join(split(t))) for i, t in found if split(t)) == first


def test_near_dedup_keeps_one_of_each_group(spark, awkward, empty):  # noqa: F811
    """Rows of one doc_id and different texts are judged each; of repeated rows one stays; rows without a doc_id give way to others."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (2, a + " end"), (2, b), (3, c), (3, c), (None, c), (None, "x y"), (4, " "), (5, ""), (6, b.upper())]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash"))
    found = simhash.near_dedup(docs)
    assert found.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["text"][:3]) for r in found.collect()) == sorted([("1", "a0 "), ("2", "b0 "), ("3", "c0 "), ("None", "x y"), ("4", " "), ("5", "")])
    check_kept(rows_of(simhash.near_dedup(awkward)), rows_of(awkward))
    assert simhash.near_dedup(empty).count() == 0 and simhash.near_dedup(empty).columns == empty.columns


def test_near_dedup_finds_planted_copies_and_leaves_others(spark):
    """Copies at a similarity of 0.8 to 0.95 go, nine in ten at least; texts that are at 0.4 to 0.78 to another stay, as do all others."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(3, 8)))
    copies, rows = set(), []
    for i in range(260):
        base = [word() for _ in range(rng.randint(60, 400))]
        rows.append((len(rows), " ".join(base)))
        shingles = {tuple(base[k : k + 5]) for k in range(len(base) - 4)}
        other, want = list(base), rng.uniform(0.8, 0.95) if i % 2 else rng.uniform(0.4, 0.78)
        while True:
            tried = list(other)
            tried[rng.randrange(len(tried))] = word()
            own = {tuple(tried[k : k + 5]) for k in range(len(tried) - 4)}
            if len(own & shingles) / len(own | shingles) < want:
                break
            other = tried
        if i % 2:
            copies.add(len(rows))
        elif len({tuple(tried[k : k + 5]) for k in range(len(tried) - 4)} & shingles) / len(own | shingles) < 0.8:
            other = tried
        rows.append((len(rows), " ".join(other)))
    left = {i for i, _ in rows_of(simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)))}
    gone = {i for i, _ in rows} - left
    assert gone <= copies and len(gone) >= 0.97 * len(copies)


def test_near_dedup_of_documents(spark):
    rows = rows_of(table(spark, SF, "documents"))
    check_kept(rows_of(simhash.near_dedup(table(spark, SF, "documents"))), rows)


def test_pigeonring_is_a_filter_only():
    """What is within the distance has a viable chain; what is not is never returned."""
    rng = np.random.default_rng(2)
    base = rng.integers(0, 256, 32, dtype=np.uint8)
    prints = [base.tobytes()]
    for i in range(400):
        x = np.unpackbits(base)
        x[rng.permutation(256)[: rng.integers(20, 80)]] ^= 1
        if i % 4 == 0:  # all differences side by side
            x = np.unpackbits(base)
            x[: rng.integers(20, 80)] ^= 1
        prints.append(np.packbits(x).tobytes())
    ring = simhash.WideRing(1000)
    found, close, _ = ring.near(ring.read(prints), 0, np.arange(1, 401), 80)
    apart = [sum((a ^ b).bit_count() for a, b in zip(p, prints[0], strict=True)) for p in prints[1:]]
    assert {int(i): -int(c) for i, c in zip(found, close, strict=True)} == {i: d for i, d in enumerate(apart, 1) if d <= simhash.WIDE_DISTANCE}


# alignment


def aligned_by_hand(rows):
    """Whole texts are encoded, and every pair of tokens is looked at by its ends."""
    a, b = Tokenizer.from_file(alignment.BYTE_BPE), sentencepiece.SentencePieceProcessor(model_file=alignment.PIECES)
    a.encode_special_tokens = True
    to_byte = alignment.byte_of()
    entry = {i: bytes(to_byte[c] for c in t) for t, i in a.get_vocab(with_added_tokens=False).items()}
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    docs, counts = [], Counter()
    for i, t in rows:
        whole = (" " + t).encode()
        ids_a, ids_b = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        tokens_a, tokens_b = [entry[x] for x in ids_a], [piece(x) for x in ids_b]
        if not t or b"".join(tokens_a) != whole or b"".join(tokens_b) != whole:
            docs.append((i, [], [], [], ""))
            continue
        ends_a, ends_b = (np.cumsum([len(x) for x in tokens]).tolist() for tokens in (tokens_a, tokens_b))
        said, links, p, q = [], [], 0, 0
        for e in sorted(set(ends_a) & set(ends_b)):
            x, y = ends_a.index(e) + 1, ends_b.index(e) + 1
            said.append(",".join(map(str, ids_a[p:x])) + "|" + ",".join(map(str, ids_b[q:y])))
            links.append((ids_a[x - 1], ids_b[y - 1]))
            p, q = x, y
        counts.update(links)
        docs.append((i, ids_a, ids_b, links, ";".join(said)))
    top = Counter()
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    each = lambda links: (sum(counts[k] == top[k[1]] for k in links), sum(counts[k] for k in links))
    return Counter((i, len(x), len(y), said.count(";") + bool(said), len(k), *each(k), hashlib.sha256(said.encode()).hexdigest() if said else "", said) for i, x, y, k, said in docs)


ODD = ["a é漢字 \U0001f600x  b\n\nc", "mark ▁d inside", "<|endoftext|> and </s> <0x41> are text", " leading and trailing  ", "\t\ttabs\tand   runs", "é ﬁ ½ ​ nbsp", "don't we'll I'm 12345 67,8.9", "\x00\x01 control", "x" * 300, "🇩🇪👩‍👩‍👧 flags", " em 　space"]


@pytest.mark.parametrize("chunk", [3_000_000, 200])
def test_alignment_equals_whole_texts(spark, awkward, empty, monkeypatch, chunk):  # noqa: F811
    """Units, chunks and cuts by spans give what whole texts and decoded bytes give."""
    monkeypatch.setattr(alignment, "CHUNK_CHARS", chunk)
    docs = awkward.select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(ODD, 100)), "doc_id long, text string")).repartition(3)
    found = Counter(map(tuple, alignment.align(docs, spans=True).collect()))
    assert found == aligned_by_hand(rows_of(docs)) and sum(k[4] > 0 for k in found) > 30
    assert alignment.align(empty).count() == 0


def test_alignment_of_documents(spark):
    docs = table(spark, SF, "documents")
    found = Counter(map(tuple, alignment.align(docs, spans=True).collect()))
    assert found == aligned_by_hand(rows_of(docs))


def test_vague_spans_are_refined():
    """Three tokens share a character of three bytes; two byte tokens have no span of their own."""
    assert alignment.byte_ends([1, 4, 4, 4], [False, True, True, False], [b"a", b"\xe6", b"\xbc", b"\xa2"]) == [1, 2, 3, 4]
    assert alignment.groups_of([1, 3, 4], [1, 2, 4]) == ([(1, 1), (3, 3)], [(0, 0), (2, 2)])
    assert alignment.groups_of([1, 1], [1]) == ([(2, 1)], [(0, 0), (1, 0)])


# vector codes


def codes_by_hand(rows, rounds=4, entries=256, parts=4):
    rows = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(rows[0][1]) // parts
    ints = [[math.floor(1024 * x) for x in r[1]] for r in rows]
    part = lambda v, p: v[p * width : (p + 1) * width]
    away = lambda x, y: sum((i - j) ** 2 for i, j in zip(x, y, strict=True))
    books = [[part(v, p) for v in ints[:entries]] for p in range(parts)]
    nearest = lambda v, p: min(range(len(books[p])), key=lambda e: (away(part(v, p), books[p][e]), e))
    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for v in ints:
                own[nearest(v, p)].append(part(v, p))
            for e, xs in own.items():
                books[p][e] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    codes = [[nearest(v, p) for p in range(parts)] for v in ints]
    errors = [sum(away(part(v, p), books[p][c[p]]) for p in range(parts)) for v, c in zip(ints, codes, strict=True)]
    by_label = Counter()
    for r, e in zip(rows, errors, strict=True):
        by_label[r[2]] += e
    return Counter((r[0], "".join(f"{x:02x}" for x in c), e, by_label[r[2]], digest) for r, c, e in zip(rows, codes, errors, strict=True))


VECTORS = "vec_id long, embedding array<float>, label int"


def test_vector_codes_equal_brute_force(spark, monkeypatch):
    """Ties, equal vectors, repeated and missing ids, a hot label, bad components, and several blocks a task."""
    monkeypatch.setattr(vectorcodes, "BLOCK", 90)
    rng = random.Random(4)
    middles = [[rng.gauss(0, 0.2) for _ in range(8)] for _ in range(12)]
    rows = [(i, [float(np.float32(x + rng.gauss(0, 0.05))) for x in rng.choice(middles)], rng.choice([0, 0, 0, 1, None])) for i in range(420)]
    rows += [(500 + i, [rng.choice([-1, 0, 1]) / 1024 for _ in range(8)], 2) for i in range(200)] + [(7, [0.5] * 8, 1), (7, [0.5] * 8, 1), (None, [0.25] * 8, None)]
    bad = [(900, None, 1), (901, [None, *[0.0] * 7], 1), (902, [float("nan")] * 8, 1), (903, [math.inf] * 8, None)]
    df = spark.createDataFrame(rows + bad, VECTORS).repartition(4).withColumns({c: F.lit("clash") for c in ("code", "error", "salt", "trees", "n")})
    found = Counter(tuple(r) for r in vectorcodes.compress(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())
    assert found == codes_by_hand(rows)


def test_vector_codes_of_few_odd_and_no_rows(spark):
    few = [(3, [0.1, -0.2, 0.3, 0.4, 9.0], 1), (1, [0.0, 0.5, 0.3, -0.4, 9.0], None)]
    found = vectorcodes.compress(spark.createDataFrame([*few, (4, [1.0], 1), (5, [], 1)], VECTORS)).collect()
    assert {(r["vec_id"], r["code"], r["error"]) for r in found} == {(1, "00000000", 0), (3, "01010001", 0)}
    far = vectorcodes.compress(spark.createDataFrame([(i, [3e38 * (-1) ** i, 1.0, 1.0, 1.0], 1) for i in range(300)], VECTORS)).collect()
    assert len(far) == 300 and {r["error"] for r in far} == {0}
    for none in (spark.createDataFrame([], VECTORS), spark.createDataFrame([(1, None, 1)], VECTORS)):
        assert vectorcodes.compress(none).count() == 0


def test_balls_hold_their_points():
    """Each node covers its children's points; sums and radii are those of the points; every point is owned by its nearest entry."""
    rng = np.random.default_rng(1)
    points = rng.integers(-300, 300, (700, 6))
    tree = vectorcodes.Tree.unpacked(vectorcodes.Tree.over(points).packed())
    assert sorted(tree.order.tolist()) == list(range(700)) and (points[tree.order] == tree.points).all()
    for i in range(len(tree.low)):
        own = tree.points[tree.low[i] : tree.high[i]]
        assert (own.sum(axis=0) == tree.sums[i]).all() and np.sqrt(((own - own.mean(axis=0)) ** 2).sum(axis=1)).max() <= tree.radius[i] + 1e-6
        if tree.left[i] >= 0:
            assert (tree.low[i], tree.high[tree.left[i]], tree.high[i]) == (tree.low[tree.left[i]], tree.low[tree.right[i]], tree.high[tree.right[i]])
    entries = points[:5].copy()
    entries[1:] += 2000 * np.arange(1, 5)[:, None]
    got, whole = np.full(700, -1), 0
    for low, high, entry, total in tree.owned(entries):
        got[tree.order[low:high]] = entry
        whole += (high - low) * (total is not None)
    assert (got == ((points[:, None] - entries[None]) ** 2).sum(axis=2).argmin(axis=1)).all() and whole > 350


@pytest.mark.parametrize("name", ["op11_vector_codes", "op13_minhash_near_dedup"])
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel, df = db.sql(queries.ORACLE_SQL[name]), queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert Counter(tuple(r[c] for c in columns) for r in df.collect()) == Counter(tuple(r[i] for i in at) for r in rel.fetchall())
