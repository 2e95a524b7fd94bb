"""The text operators against brute force on small fixtures and on the smallest tables."""

import functools
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from tracemine.llm import exact, imatch, langid, mixing, pieces, quality, simhash, suffix, toxicity, urlfilter
from tracemine.llm.common import components, table

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators make themselves; documents may have them too.
CLASHING = ("digest", "sha", "bits", "h", "id", "node", "component", "u", "v", "n", "key", "word", "ids", "kept", "of", "th", "term", "size", "target", "groups", "p", "score", "fold", "x", "y", "held_out", "salt", "chunk", "bucket", "source_size", "spans", "found")


def words_of(text):
    return text.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ")


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, and extra columns whose names clash."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 7))) for _ in range(60)] + ["É*", "ß", "日本", "x\ty"]
    long = " ".join(rng.choice(vocabulary) for _ in range(6000))
    passage = " ".join(rng.choice(vocabulary) for _ in range(70))
    texts = [None, "", " ", "\n", "a", "a", "One", "one", long, long, long + " end", long[:300] + passage + "!" + long[900:1300], passage, "z" * 900, "zz" * 700, "日本語 " * 90, "no space " + "q" * 500]
    texts += [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 90))) for _ in range(30)]
    texts += [f"{passage} {i} " + " ".join(rng.choice(vocabulary) for _ in range(30)) for i in range(6)]
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["s0", "s0", "s1", "é", None]), None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, "a", None, None, 1), (None, None, None, None, None), (7, "another text with id seven", "en", "s1", 4)]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in CLASHING})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


# exact dedup


def exact_by_hand(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    out = []
    for i, t in rows:
        known = [x for x in groups[t] if x is not None]
        keep = max(known) if known else None
        out.append((i, keep, len(groups[t]), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("digest", [None, lambda t: F.substring(F.sha2(t, 256), 1, 1), lambda t: F.lit("same")])
def test_exact_groups(awkward, digest):
    """Weak digests make different texts collide, so that full texts must be compared."""
    found = exact.exact_groups(awkward, **({"digest": digest} if digest else {}))
    assert Counter(map(tuple, found.collect())) == exact_by_hand(rows_of(awkward))


def test_exact_dedup(awkward, empty):
    kept = rows_of(exact.exact_dedup(awkward))
    assert len({t for _, t in kept}) == len(kept) == len({t for _, t in rows_of(awkward)})
    assert exact.exact_dedup(empty).columns == empty.columns and exact.exact_dedup(empty).count() == exact.exact_groups(empty).count() == 0


# SimHash


def print_by_hand(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    parts = [w for w in words_of(low) if w]
    shingles = [" ".join(parts[i : i + 4]) for i in range(len(parts) - 3)] or ([" ".join(parts)] if parts else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if sum(h >> k & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def near_by_hand(rows):
    prints = [print_by_hand(t) for _, t in rows]
    parent = {p: p for p in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    own = sorted(parent)
    for i, a in enumerate(own):
        for b in own[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                parent[root(a)] = root(b)
    least = defaultdict(list)
    for (i, _), p in zip(rows, prints, strict=True):
        if i is not None:
            least[root(p)].append(i)
    return Counter((i, f"{p:016x}", min(least[root(p)], default=None)) for (i, _), p in zip(rows, prints, strict=True))


def test_near_groups(awkward, empty, spark):
    assert Counter(map(tuple, simhash.near_groups(awkward).collect())) == near_by_hand(rows_of(awkward))
    assert simhash.near_groups(empty).count() == 0
    docs = table(spark, SF, "documents")
    assert Counter(map(tuple, simhash.near_groups(docs).collect())) == near_by_hand(rows_of(docs))


@pytest.mark.parametrize(("tile", "segments"), [(3, 6), (4096, 6), (4096, 7), (50, 8)])
def test_links_connect_all_near_fingerprints(spark, tile, segments):
    """Random balls of fingerprints: the links' components are those of all pairs, whether buckets are cut into tiles or not, and for each ring."""
    rng = random.Random(tile)
    prints = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(15):
            x = centre
            for _ in range(rng.randint(0, 5)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    prints = sorted(prints, key=lambda p: p - (1 << 64) if p >> 63 else p)
    index = {p - (1 << 64) if p >> 63 else p: i for i, p in enumerate(prints)}
    nodes = spark.createDataFrame([(p,) for p in index], "bits long")
    found = {index[r["node"]]: index[r["component"]] for r in components(simhash.near_links(nodes, tile, segments)).collect()}
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    assert {i: found.get(i, i) for i in range(len(prints))} == {i: root(i) for i in range(len(prints))}


def test_rows_without_ids_link_others(spark):
    """A row without an id whose fingerprint is near two others' joins these, and gets their component."""
    rng, near = random.Random(4), None
    while near is None:
        words = [rng.choice(["aa", "bb", "cc", "dd", "ee", "ff", "gg"]) for _ in range(200)]
        texts = [" ".join([*words[:i], "x" + str(k), *words[i + 1 :]]) for k, i in enumerate(rng.sample(range(200), 12))]
        prints = [print_by_hand(t) for t in texts]
        far = lambda i, j: (prints[i] ^ prints[j]).bit_count()
        near = next(((i, j, k) for i in range(12) for j in range(12) for k in range(12) if 0 < far(i, j) <= 4 and 0 < far(j, k) <= 4 and far(i, k) > 4), None)
    rows = [(5, texts[near[0]]), (None, texts[near[1]]), (3, texts[near[2]]), (None, "some other text that is far from all others here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = Counter(map(tuple, simhash.near_groups(docs).collect()))
    assert found == near_by_hand(rows) and sum(c == 3 for _, _, c in found) == 3


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, x) for x in range(8, 60)] + [(200, 200), (59, 61)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {i: 100 for i in range(101, 161)} | {x: 7 for x in (*range(8, 60), 61)}


# suffix arrays


def removed_by_hand(rows):
    texts = [t.encode() for _, t in rows]
    seen = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    out = []
    for (doc, _), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = True
        runs = int(gone[:1].sum()) + int((np.diff(gone.astype(int)) == 1).sum())
        out.append((doc, len(t), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("hot", [2, 2000])
def test_repeated_spans(awkward, empty, spark, monkeypatch, hot):
    monkeypatch.setattr(suffix, "HOT", hot)
    for docs in (awkward, table(spark, SF, "documents")):
        assert Counter(map(tuple, suffix.repeated_spans(docs).drop("spans").collect())) == removed_by_hand(rows_of(docs))
    assert suffix.repeated_spans(empty).count() == 0

    rows = awkward.unionByName(spark.createDataFrame([(1, "one " * 100, None, None, 400), (1, "x" + "".join(map(str, range(500)))[:399], None, None, 400)], SCHEMA), allowMissingColumns=True)
    lost = suffix.without_repeats(rows)
    kept = Counter((r["doc_id"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in lost.where("text IS NOT NULL").collect() if r["text"].isascii())
    expected = Counter()
    for (i, _, _, _, sha), k in removed_by_hand(rows_of(rows.where("text IS NOT NULL"))).items():
        expected[i, sha] += k
    assert kept and not kept - expected and lost.columns == [*rows.columns, "n_removed"] and lost.count() == rows.count()


def test_a_common_passage_in_different_texts_is_not_sorted_in_one_task(spark, monkeypatch):
    """300 texts share 230 bytes in the midst of others, so no two contexts are equal; no more than a key's and a part's bound may be sorted together."""
    from pyspark import cloudpickle

    rng = random.Random(8)
    any_text = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    passage = any_text(230)
    docs = spark.createDataFrame([(i, any_text(150) + passage + any_text(220)) for i in range(300)], "doc_id long, text string")
    whole = suffix._stretches

    def bounded(t):
        if len(t) > 60:
            raise MemoryError(f"{len(t)} contexts at once")
        return whole(t)

    for name, value in (("HOT", 20), ("SORTED", 40), ("_stretches", bounded)):
        monkeypatch.setattr(suffix, name, value)
    cloudpickle.register_pickle_by_value(suffix)
    try:
        found = suffix.repeated_spans(docs).drop("spans").collect()
    finally:
        cloudpickle.unregister_pickle_by_value(suffix)
    assert Counter(map(tuple, found)) == removed_by_hand(rows_of(docs))
    assert all(r["n_removed"] >= 230 for r in found)


def test_deep_shallow_sorts():
    rng = random.Random(1)
    for _ in range(60):
        strings = [bytes(rng.choice(b"ab") for _ in range(rng.choice([0, 1, 5, 40, 90]))) for _ in range(rng.randint(1, 60))]
        strings += [x[: rng.randint(0, len(x))] + b"b" for x in strings] + strings[:3]
        order, shared = suffix.deep_shallow(strings)
        ordered = [strings[i] for i in order]
        assert ordered == sorted(strings)
        assert list(shared[1:]) == [suffix.common_prefix(a, b) for a, b in zip(ordered, ordered[1:], strict=False)]


def test_anchors_of_equal_strings_are_equal(monkeypatch):
    rng = np.random.default_rng(3)
    data = rng.integers(97, 101, 5000).astype(np.uint8)
    data[3000:3600] = data[1000:1600]
    bounds = np.array([0, 2500, 2500, 5000])
    at, h = suffix.anchors(data, bounds)
    whole = dict(zip(at.tolist(), h.tolist(), strict=True))
    monkeypatch.setattr(suffix, "BLOCK", 700)
    again, h2 = suffix.anchors(data, bounds)
    assert dict(zip(again.tolist(), h2.tolist(), strict=True)) == whole
    inside = {a for a in whole if 1128 <= a <= 1400}
    assert inside and all(whole.get(a + 2000) == whole[a] for a in inside)


# mixing


def targets_by_hand(sizes, weights=(1, 2, 3), limit=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, out = set(), {}
    while True:
        rest = sum(sizes.values()) - sum(limit * sizes[s] for s in full)
        total = sum(weight[s] for s in names if s not in full)
        out = {s: float(limit * sizes[s]) if s in full else rest * weight[s] / total for s in names}
        over = {s for s in names if s not in full and out[s] > limit * sizes[s]}
        if not over:
            return out
        full |= over


def test_targets_with_ties(spark):
    """Small sizes, so that sources often tie in size, in size over weight, or are full together."""
    from fractions import Fraction

    rng = random.Random(11)
    for _ in range(8):
        sizes = {s: rng.choice((0, 5, 10, 20, 30, 30, 60, 90, rng.randint(1, 40))) for s in rng.sample(["a", "b", "c", "d", "e", "f", "\u00e9", "\uffff", "\U00010000", None], rng.randint(1, 10))}
        rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        found = {r["source"]: r["target"] for r in mixing.targets(rows).collect()}
        expected = targets_by_hand({s: Fraction(n) for s, n in sizes.items()})
        assert found == pytest.approx({s: float(t) for s, t in expected.items()})
    assert {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame([("a", 30), ("b", 60), ("c", 5)], "source string, source_size long")).collect()} == pytest.approx({"a": 30.0, "b": 60.0, "c": 5.0} | targets_by_hand({"a": 30, "b": 60, "c": 5}))


def test_mix(awkward, empty, spark):
    for docs in (awkward, table(spark, SF, "documents")):
        found = mixing.mix(docs, fan=4).collect()
        sizes = defaultdict(int)
        n = {}
        for r in docs.select("source", "text").collect():
            sizes[r["source"]] += (k := len([w for w in words_of(r["text"] or "") if w]))
            n[r["source"]] = max(k, n.get(r["source"], 0))
        target = targets_by_hand(sizes)
        taken = defaultdict(int)
        for r in found:
            assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
            assert 0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"]
            taken[r["source"]] += r["taken"]
        assert len(found) == docs.count()
        for s, t in target.items():
            assert abs(taken[s] - t) <= n[s]
        assert Counter(map(tuple, mixing.mix(docs.repartition(3), fan=4).collect())) == Counter(map(tuple, found))
        times = Counter()
        for r in mixing.mix(docs).collect():
            times[r["doc_id"], r["th"]] += r["copies"]
        taken = Counter((r["doc_id"], r["th"]) for r in mixing.mixed(docs).select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th")).collect())
        assert taken == +times and mixing.mixed(docs).columns == docs.columns
    assert mixing.mix(empty).count() == mixing.mixed(empty).count() == 0


def test_repeats_of_one_row_are_numbered_in_blocks(spark, monkeypatch):
    """Rows without ids or with the same one, and with equal texts, are documents of their own, however many there are."""
    monkeypatch.setattr(mixing, "REPEATS", 7)
    docs = spark.createDataFrame([(None, "a b c", "x")] * 60 + [(3, "a b", "x")] * 50 + [(4, "d e", "y")] * 40, "doc_id long, text string, source string")
    for r in mixing.mix(docs, fan=4).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.count("*").alias("n"), F.max("copies").alias("most")).collect():
        assert abs(r["taken"] - r["target"]) <= 3 and r["most"] <= 3 and r["n"] == {"x": 110, "y": 40}[r["source"]]


def test_mix_is_unbiased(spark):
    """Over many sizes, documents are taken about as often as their source's share says."""
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(1 + id % 37 as int))").alias("text"), F.expr("if(id % 4 = 0, 'a', 'b')").alias("source"))
    for r in mixing.mix(docs).groupBy("source").agg(F.avg("copies").alias("copies"), F.first(F.expr("target / source_size")).alias("share")).collect():
        assert r["copies"] == pytest.approx(r["share"], abs=0.03)


# I-Match


def imatch_by_hand(rows):
    """Fingerprints and likenesses of rows in order, each with the next one."""
    of = lambda t: {x for x in regex.split(r"[^\p{L}\p{N}]+", t.lower()) if x}
    df = Counter(x for _, t in rows for x in of(t))
    band = {x for x, k in df.items() if max(2, imatch.RAREST * len(rows)) <= k <= max(2, imatch.COMMONEST * len(rows))}
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()

    def hashes(text):
        kept = sorted(of(text) & band)
        inside = [[x for x in kept if int(md5(x)[4 * d : 4 * d + 4], 16) < 1 << 16 - k] for d, k in imatch.LEXICONS]
        return [md5(" ".join(x))[:4] if x else "----" for x in inside] + [md5(" ".join(kept) if kept else "text " + text)[:16]]

    def near(a, b):
        some = [x == y for x, y in zip(a, b, strict=True) if (x, y) != ("----", "----")][: imatch.COMPARED]
        return sum(some) / len(some)

    own = [hashes(t) for _, t in rows]
    for k, (i, t) in enumerate(rows):
        n = (k + 1) % len(rows)
        m = len(t) // 4
        text = t[: len(t) - m] + rows[n][1][:m]
        edited = hashes(text)
        yield i, len(t), hashlib.sha256(text.encode()).hexdigest(), "".join(own[k]), "".join(edited), near(own[k], edited), near(own[k], own[n])


def test_imatch(awkward, empty, spark):
    docs = table(spark, SF, "documents")
    found = imatch.imatch(docs).collect()
    assert Counter(map(tuple, found)) == Counter(imatch_by_hand(sorted(rows_of(docs))))
    near = np.mean([[r["near_edited"], r["near_next"]] for r in found], axis=0)
    assert near[0] > 0.3 and near[1] < 0.05
    assert imatch.imatch(awkward).count() == awkward.count() and imatch.imatch(empty).count() == 0
    # null ids come first, ids that repeat by a hash of the text; rows that repeat both are one document in the order
    signed = lambda t: np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).astype(np.int64)
    once = sorted(set(rows_of(awkward.where("text IS NULL OR text <> 'a'"))), key=lambda r: (r[0] is not None, r[0] or 0, signed(r[1])))
    same = awkward.where("text IS NULL OR text <> 'a'").dropDuplicates(["doc_id", "text"])
    assert Counter(map(tuple, imatch.imatch(same).collect())) == Counter(imatch_by_hand(once))


def test_imatch_is_what_duckdb_says(spark):
    import duckdb

    from tracemine.llm import queries

    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    found = queries.op8_imatch(spark, SF).toPandas()
    rows = db.sql(queries.ORACLE_SQL["op8_imatch"]).df()[list(found.columns)]
    assert sorted(map(tuple, found.to_numpy())) == sorted(map(tuple, rows.to_numpy()))


def test_texts_without_terms_of_the_band_agree_only_if_equal(spark):
    texts = ["common a1"] * 3 + ["common"] * 40 + ["?", "!", "!", "", "x1y2", "x1y3"]
    found = imatch.imatch(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    prints = {texts[r["doc_id"]]: r["fingerprint"] for r in found if r["doc_id"] > 2}
    assert len(set(prints.values())) == len(prints)
    assert {r["doc_id"]: r["near_next"] for r in found if r["doc_id"] in (43, 44, 46)} == {43: 0.0, 44: 1.0, 46: 0.0}


# pieces


def best_by_hand(word, table, longest):
    """Cost and ids of the cheapest way through a word; of equal ones that with the longest last piece."""
    worst = max(c for c, _ in table.values())
    ways = [(0, 0, None)]
    for end in range(1, len(word) + 1):
        options = []
        for start in range(max(0, end - longest), end):
            piece = word[start:end]
            if piece in table:
                options.append((ways[start][0] + table[piece][0], start, [table[piece][1]]))
            elif end - start == 1:
                raw = piece.encode()
                options.append((ways[start][0] + (worst + 10) * len(raw), start, [b + 3 for b in raw]))
        ways.append(min(options, key=lambda o: o[:2]))
    out, end = [], len(word)
    while end:
        _, end, ids = ways[end]
        out = ids + out
    return out


@functools.cache
def pieces_by_hand():
    return {p: (-s, i) for i, (p, s, kind) in enumerate(pieces.vocabulary()) if kind == "piece" and s > -1e8}


def ids_by_hand(text):
    return tuple(x for w in pieces.words_of(text) for u in ([w] if w == "\n" else pieces.PART.findall(w)) for x in ([13] if u == "\n" else best_by_hand(u, pieces_by_hand(), 16)))


def test_encode_and_decode(awkward, empty, spark, monkeypatch):
    docs = awkward.unionByName(table(spark, SF, "documents").limit(40), allowMissingColumns=True)
    texts = rows_of(docs)
    expected = Counter((i, ids_by_hand(t)) for i, t in texts)
    encoded = pieces.encode(docs)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in encoded.collect()) == expected
    assert Counter((r["doc_id"], r["text"]) for r in pieces.decode(encoded).collect()) == Counter(texts)
    both = pieces.encode(docs, decoded=True)
    assert Counter((r["doc_id"], tuple(r["ids"]), r["text"]) for r in both.collect()) == Counter((r["doc_id"], tuple(r["ids"]), r["text"]) for r in pieces.decode(encoded).collect())
    assert pieces.encode(empty).count() == 0 and pieces.decode(pieces.encode(empty)).columns == ["doc_id", "ids", "text"]


def test_long_units_are_encoded_whole(spark):
    """Units of 59 to 5,000 characters, which the lattice hands to the fold from 61 on, take the best way through all of them."""
    rng = random.Random(6)
    texts = ["international" * k for k in (4, 5, 6, 80)] + ["z" * n for n in (59, 60, 61, 2000)] + ["=" * 61, "1234567890" * 7, "\u65e5\u672c\u8a9e\u306e\u6587\u7ae0" * 60, "\u00e9\U0001f600" * 40]
    texts += ["".join(rng.choice("etaoinshrdlu") for _ in range(n)) for n in (58, 59, 60, 61, 62, 300, 5000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    encoded = pieces.encode(docs)
    assert {r["doc_id"]: tuple(r["ids"]) for r in encoded.collect()} == {i: ids_by_hand(t) for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["text"] for r in pieces.decode(encoded).collect()} == dict(enumerate(texts))


def test_rows_in_another_order_each_time(spark, monkeypatch):
    """Each evaluation of the input gives its rows in another order, as a shuffle on a cluster may."""
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(pieces)
    monkeypatch.setattr(pieces, "CHUNK_CHARS", 300)
    monkeypatch.setattr(pieces, "BUCKET_BYTES", 50)
    texts = [f"word{i} other{i % 7} third" for i in range(200)]

    def shuffled(batches):
        import random as any_order

        for b in batches:
            yield b.take(any_order.sample(range(len(b)), len(b)))

    try:
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2).mapInArrow(shuffled, "doc_id long, text string")
        found = {r["doc_id"]: r["text"] for r in pieces.decode(pieces.encode(docs)).collect()}
    finally:
        cloudpickle.unregister_pickle_by_value(pieces)
    assert found == dict(enumerate(texts))


def test_words_make_up_the_text():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice("ab  \n\t,.\u00e9\u65e59\u2581") for _ in range(rng.choice([0, 1, 9, 200])))
        assert "".join(pieces.words_of(text)) == (pieces.SPACE + text.replace(" ", pieces.SPACE) if text else "")
        assert all("".join(pieces.units(w)) == w for w in pieces.words_of(text))


def test_decode_odd_ids(spark):
    found = pieces.decode(spark.createDataFrame([(1, None), (2, []), (3, [1, 99999, 3 + 0xC3]), (4, [3 + 0xC3, 3 + 0xA9])], "doc_id long, ids array<int>")).collect()
    assert {r["doc_id"]: r["text"] for r in found} == {1: None, 2: "", 3: "\ufffd", 4: "é"}


# learned operators: held-out accuracy


def test_language(awkward, empty, spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    model = langid.fit(docs)
    found = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("crc32(string(doc_id)) % 4 = 2").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert found > 0.97
    odd = {(r["doc_id"], r["lang_pred"]) for r in langid.identify(awkward, model).collect()}
    assert {(0, "und"), (1, "und"), (2, "und"), (3, "und"), (None, "und")} <= odd
    assert langid.identify(empty, langid.fit(empty)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(awkward, langid.fit(empty)).collect()} == {"und"}


def test_letters_of_all_planes_and_no_others_make_words():
    """Adlam, Deseret, Gothic, mathematical and rare Han letters are words; emoji with selectors or tags, and lone marks, are none; marks continue words."""
    words = ["\U0001e922\U0001e923", "\U00010428\U00010429", "\U00010330\U00010331", "\U0001d400\U0001d401", "\U00020000"]
    none = ["\u2764\ufe0f \U0001f600\ufe0f", "\U0001f3f4\U000e0067\U000e0062\U000e007f", "\u0301", "\U000f0000", "\U0001f600"]
    codes, starts, text = langid.word_codes(words + none + ["\u0301E\u0301a b"])
    assert text.tolist() == [0, 1, 2, 3, 4, 10, 10]
    assert codes[starts[5] :].tolist() == [0, ord("e"), 0x301, ord("a"), 0, ord("b")]
    assert langid.word_codes(["\U00010400"])[0].tolist() == [0, 0x10428]


def test_language_spans(spark):
    """A passage in another language inside a text is a span of its own."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    model = langid.fit(docs)
    pure = {r["lang"]: r["text"] for r in docs.where("lang IN ('en', 'fr') AND n_chars BETWEEN 1500 AND 2500 AND doc_id % 3 = 1").collect()}
    mixed = pure["en"][:900] + " " + pure["fr"][:700] + " " + pure["en"][900:1500]
    spans = langid.identify(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), model).first()["spans"]
    long = [s["lang"] for s in spans if s["words"] >= 40]
    assert [x for i, x in enumerate(long) if i == 0 or x != long[i - 1]] == ["en", "fr", "en"]


def test_viterbi_is_the_best_labelling():
    import itertools

    rng = np.random.default_rng(4)
    counts = np.array([5, 0, 3, 1])
    scores = rng.normal(0, 3, (int(counts.sum()), 3)).astype(np.float32)
    labels, at = langid.viterbi(scores, counts, 2.0), 0

    def value(s, path):
        return sum(s[i, k] for i, k in enumerate(path)) - 2.0 * sum(a != b for a, b in zip(path, path[1:], strict=False))

    for n in counts:
        s = scores[at : at + n]
        best = max((value(s, p) for p in itertools.product(range(3), repeat=int(n))), default=0)
        assert value(s, labels[at : at + n].tolist()) == pytest.approx(best, abs=1e-4)
        at += n


def test_quality(awkward, empty, spark):
    docs, labels = (table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    judged = quality.quality(docs, model).join(labels, "doc_id").where("crc32(string(doc_id)) % 4 = 2")
    assert judged.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] > 0.95
    odd = quality.quality(awkward, model).collect()
    assert len(odd) == awkward.count() and all(0 <= r["score"] <= 1 for r in odd)
    assert set(quality.accepted(docs, model).columns) == set(docs.columns)
    assert quality.quality(empty, quality.fit(empty, labels)).count() == 0
    assert {r["score"] for r in quality.quality(awkward, quality.fit(empty, labels)).collect()} == {0.5}


def test_isotonic():
    assert quality.isotonic(np.array([1.0, 0.0, 0.5, 0.4, 2.0]), np.ones(5)).tolist() == pytest.approx([0.475] * 4 + [2.0])


def test_toxicity(awkward, empty, spark):
    docs, labels = (table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    texts = toxicity.training_texts(docs, labels)
    counts = toxicity.feature_counts(texts)
    model = toxicity.fit(toxicity.graded(texts, counts), counts)
    judged = toxicity.toxicity(docs, model).join(labels, "doc_id").where("crc32(string(doc_id)) % 4 = 2")
    assert judged.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int"))).first()[0] > 0.9
    assert list(np.diff(model.thresholds) > 0) == [True] * (len(model.thresholds) - 1)
    assert toxicity.toxicity(awkward, model).count() == awkward.count()
    none = toxicity.training_texts(empty, labels)
    assert toxicity.toxicity(empty, toxicity.fit(toxicity.graded(none, toxicity.feature_counts(none)))).count() == 0


# URL filters


def judged_by_hand(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, path = rest[:cut], rest[cut:].split("?")[0].split("#")[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_rules(spark):
    pages = table(spark, SF, "pages").select("page_id", "url", "html")
    odd = ["http://EXAMPLE.com/en/", "http://www.example.com/en/x", "http://a.www.example.com/en/#x", "x://notexample.com/en/", "http://a.net", "a.net/es/", None, "", "http://com", "http://com/?q", "://", "http:///p", "http://x.NET/fr/é?://a/b", "h://x.net/\nes/", "http://u@b.com:80/x"]
    pages = pages.unionByName(spark.createDataFrame([(10_000 + i, u, None) for i, u in enumerate(odd)], "page_id long, url string, html string"))
    found = {r["page_id"]: r for r in urlfilter.filter_urls(pages.withColumn("host", F.lit("clash"))).collect()}
    for r in pages.collect():
        host, path, rule, verdict = judged_by_hand(r["url"])
        own = found[r["page_id"]]
        assert (own["host"], own["path"], own["rule"]) == (host, path, rule)
        assert own["verdict"] in ("allow", "block") and (verdict is None or own["verdict"] == verdict)
    assert urlfilter.filter_urls(pages.limit(0)).count() == 0


def test_distrust_reaches_hosts_that_link_to_blocked_ones(spark):
    pages = [(1, "http://bad.net/es/1", ""), (2, "http://farm.org/x", '<a href="http://bad.net/es/1">'), (3, "http://farmer.org/x", "<a href='https://farm.org/'>"), (4, "http://good.com/x", '<a href="//fine.org/a">'), (5, "http://fine.org/a", '<a href="/local">'), (6, "http://lone.org/", None)]
    found = {r["host"]: r for r in urlfilter.filter_urls(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert [found[h]["verdict"] for h in ("bad.net", "farm.org", "farmer.org", "good.com", "fine.org", "lone.org")] == ["block", "block", "block", "allow", "allow", "allow"]
    assert found["farm.org"]["distrust"] > found["farmer.org"]["distrust"] > 0 and found["fine.org"]["trust"] > 0


def test_scores_converge_on_chains_and_cycles(spark):
    """Hosts 1 to 14 links from a blocked one, and hosts in a cycle, get the scores of the solved linear system."""
    damping = urlfilter.DAMPING
    hosts = ["bad.net", *(f"h{i}.org" for i in range(1, 18)), "a.sub.edu", "sub.edu"]
    links = [(f"h{i}.org", f"h{i - 1}.org" if i > 1 else "bad.net") for i in range(1, 18)] + [("sub.edu", "bad.net")]
    pages = [(0, "http://bad.net/es/1", "")] + [(i, f"http://{a}/x", f'<a href="http://{b}/">') for i, (a, b) in enumerate(links, 1)] + [(99, "http://a.sub.edu/x", "")]
    weights = np.zeros((len(hosts), len(hosts)))  # of reversed links, from and to
    for a, b in [*links, ("sub.edu", "a.sub.edu"), ("a.sub.edu", "sub.edu")]:
        weights[hosts.index(b), hosts.index(a)] += 1
    shares = weights / np.maximum(weights.sum(axis=1, keepdims=True), 1)
    solved = np.linalg.solve(np.eye(len(hosts)) - damping * shares.T, np.eye(len(hosts))[0])
    found = {r["host"]: r for r in urlfilter.filter_urls(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert [found[h]["distrust"] for h in hosts] == pytest.approx(solved.tolist(), abs=1e-6)
    assert {h for h in hosts if found[h]["verdict"] == "block"} == {h for h, x in zip(hosts, solved, strict=True) if x > urlfilter.THRESHOLD}
    assert min(solved[hosts.index(h)] for h in hosts if found[h]["verdict"] == "block") < 0.85**10
