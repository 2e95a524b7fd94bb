"""The text operators as queries over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemine.llm import alignment, exact, imatch, langid, minhash, mixing, pieces, quality, simhash, suffix, toxicity, urlfilter, vectorcodes
from tracemine.llm.common import held_out, table


def _held_out():
    """Rows without a doc_id are not held out."""
    return F.coalesce(held_out(), F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.fit(docs))
    return found.select("doc_id", _held_out().alias("held_out"), "lang_pred", "score", "n_words", F.size("spans").alias("n_spans"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(table(spark, sf_dir, "pages"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeated_spans(table(spark, sf_dir, "documents")).drop("spans")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    texts = toxicity.training_texts(docs, table(spark, sf_dir, "labels"))
    counts = toxicity.feature_counts(texts)
    model = toxicity.fit(toxicity.graded(texts, counts), counts)
    return toxicity.toxicity(docs, model).withColumn("held_out", _held_out())


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes every document, decodes the pieces again, and gives both lengths, the ids and the decoded text's digest."""
    decoded = pieces.encode(table(spark, sf_dir, "documents"), decoded=True)
    return decoded.select("doc_id", F.size("ids").alias("n_ids"), "ids", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("decoded_sha256"))


def op8_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.imatch(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source", "copies")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.quality(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", _held_out().alias("held_out"), "score", "predicted")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.compress(table(spark, sf_dir, "embeddings")).drop("label")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


def op13_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(table(spark, sf_dir, "documents"), size=4)


def queries() -> dict:
    named = (op1_language_id, op2_simhash_near_dedup, op3_url_filters, op4_suffix_array_dedup, op5_toxicity, op6_exact_dedup, op7_sentencepiece, op8_imatch, op9_mixing, op10_quality, op11_vector_codes, op12_token_alignment, op13_minhash_near_dedup)
    return {f.__name__: f for f in named}


_LEXICONS = ", ".join(f"({i}, {4 * d + 1}, '{(1 << 16 - k) - 1:04x}')" for i, (d, k) in enumerate(imatch.LEXICONS))
_IMATCH = f"""
    WITH ordered AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id NULLS FIRST, text) AS k, count(*) OVER () AS n FROM documents),
    nexts AS (SELECT a.*, b.text AS nxt, b.k AS next_k, length(a.text) // 4 AS m FROM ordered a JOIN ordered b ON b.k = a.k % a.n + 1),
    versions AS (SELECT k, 0 AS v, text FROM nexts UNION ALL SELECT k, 1 AS v, substr(text, 1, length(text) - m) || substr(nxt, 1, m) AS text FROM nexts),
    each AS (SELECT DISTINCT k, v, term FROM (SELECT k, v, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS term FROM versions) x WHERE term <> ''),
    band AS (SELECT term FROM each WHERE v = 0 GROUP BY term HAVING count(*) >= greatest(2.0, (SELECT count(*) FROM documents) * CAST('{imatch.RAREST!r}' AS DOUBLE)) AND count(*) <= greatest(2.0, (SELECT count(*) FROM documents) * CAST('{imatch.COMMONEST!r}' AS DOUBLE))),
    known AS (SELECT e.k, e.v, e.term, md5(e.term) AS h FROM each e JOIN band b ON e.term = b.term),
    lexicons AS (SELECT * FROM (VALUES {_LEXICONS}) l(i, place, most)),
    kept AS (SELECT k, v, i, substr(md5(string_agg(term, ' ' ORDER BY term)), 1, {imatch.DIGITS}) AS hash FROM known JOIN lexicons ON substr(h, place, 4) <= most GROUP BY k, v, i),
    whole AS (SELECT x.k, x.v, {len(imatch.LEXICONS)} AS i, substr(CASE WHEN min(t.term) IS NULL THEN md5('text ' || min(x.text)) ELSE md5(string_agg(t.term, ' ' ORDER BY t.term)) END, 1, {imatch.WHOLE}) AS hash
              FROM versions x LEFT JOIN known t ON x.k = t.k AND x.v = t.v GROUP BY x.k, x.v),
    found AS (SELECT * FROM kept UNION ALL SELECT * FROM whole),
    prints AS (SELECT x.k, x.v, string_agg(coalesce(f.hash, '{imatch.NONE}'), '' ORDER BY i.i) AS p FROM versions x CROSS JOIN (SELECT i FROM lexicons UNION ALL SELECT {len(imatch.LEXICONS)}) i LEFT JOIN found f ON f.k = x.k AND f.v = x.v AND f.i = i.i GROUP BY x.k, x.v),
    pairs AS (SELECT k, k AS other, 1 AS ov, 'near_edited' AS what FROM nexts UNION ALL SELECT k, next_k AS other, 0 AS ov, 'near_next' AS what FROM nexts),
    sides AS (SELECT p.k, p.what, f.i, f.hash, 0 AS side FROM pairs p JOIN found f ON f.k = p.k AND f.v = 0 UNION ALL SELECT p.k, p.what, f.i, f.hash, 1 AS side FROM pairs p JOIN found f ON f.k = p.other AND f.v = p.ov),
    compared AS (SELECT k, what, i, CASE WHEN count(*) = 2 AND min(hash) = max(hash) THEN 1 ELSE 0 END AS same, row_number() OVER (PARTITION BY k, what ORDER BY i) AS place FROM sides GROUP BY k, what, i),
    near AS (SELECT k, what, CAST(sum(same) AS DOUBLE) / count(*) AS likeness FROM compared WHERE place <= {imatch.COMPARED} GROUP BY k, what)
    SELECT n.doc_id, CAST(length(n.text) AS BIGINT) AS n_chars, sha256(e.text) AS edited_sha256, a.p AS fingerprint, b.p AS edited_fingerprint, x.likeness AS near_edited, y.likeness AS near_next
    FROM nexts n JOIN versions e ON e.k = n.k AND e.v = 1 JOIN prints a ON a.k = n.k AND a.v = 0 JOIN prints b ON b.k = n.k AND b.v = 1 JOIN near x ON x.k = n.k AND x.what = 'near_edited' JOIN near y ON y.k = n.k AND y.what = 'near_next'
"""

_NEAREST = "arg_min(c.e, struct_pack(d := list_inner_product(x.x, x.x) - 2 * list_inner_product(x.x, c.x) + list_inner_product(c.x, c.x), e := c.e))"


def _codes_sql() -> str:
    """Rounds of exact k-means: vectors of whole numbers are lists of doubles, whose inner products are exact at this size."""
    k, n = vectorcodes.PARTS, vectorcodes.ENTRIES
    sql = f"""WITH kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor({vectorcodes.SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
              WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
        parts AS MATERIALIZED (SELECT vec_id, t.p, v[t.p * (len(v) // {k}) + 1 : (t.p + 1) * (len(v) // {k})] AS x FROM kept, range({k}) t(p)),
        c0 AS MATERIALIZED (SELECT p, e, x FROM (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM parts) y WHERE e < {n})"""
    for i in range(vectorcodes.ROUNDS):
        sql += f""", a{i} AS MATERIALIZED (SELECT x.p, {_NEAREST} AS e, any_value(x.x) AS x FROM parts x JOIN c{i} c ON x.p = c.p GROUP BY x.p, x.vec_id),
        m{i} AS MATERIALIZED (SELECT p, e, list(floor(s / n) ORDER BY i) AS x FROM (SELECT p, e, i, sum(val) AS s, count(*) AS n FROM (SELECT p, e, unnest(x) AS val, unnest(range(len(x))) AS i FROM a{i}) u GROUP BY p, e, i) w GROUP BY p, e),
        c{i + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN m{i} m ON c.p = m.p AND c.e = m.e)"""
    last = vectorcodes.ROUNDS
    return sql + f""", coded AS MATERIALIZED (SELECT x.vec_id, x.p, {_NEAREST} AS e, any_value(x.x) AS x FROM parts x JOIN c{last} c ON x.p = c.p GROUP BY x.vec_id, x.p),
        each AS (SELECT a.vec_id, string_agg(printf('%02x', a.e), '' ORDER BY a.p) AS code, CAST(sum(list_inner_product(a.x, a.x) - 2 * list_inner_product(a.x, c.x) + list_inner_product(c.x, c.x)) AS BIGINT) AS error
                 FROM coded a JOIN c{last} c ON a.p = c.p AND a.e = c.e GROUP BY a.vec_id),
        book AS (SELECT sha256(string_agg(CAST(CAST(val AS BIGINT) AS STRING), ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM (SELECT p, e, unnest(x) AS val, unnest(range(len(x))) AS i FROM c{last}) b)
        SELECT k.vec_id, each.code, each.error, CAST(sum(each.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, book.codebooks_sha256 FROM kept k JOIN each ON each.vec_id = k.vec_id, book"""


_NEAR = """
    WITH RECURSIVE split AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
    sets AS MATERIALIZED (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) END)) AS s FROM split),
    firsts AS MATERIALIZED (SELECT doc_id, len(s) AS n, s, CASE WHEN len(s) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY md5(array_to_string(s, '|'))) END AS rep FROM sets),
    each AS MATERIALIZED (SELECT doc_id, n, unnest(s) AS g FROM firsts WHERE doc_id = rep),
    links AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS m, any_value(y.n) AS n, count(*) AS c FROM each x JOIN each y ON x.g = y.g AND x.doc_id < y.doc_id AND 5 * x.n >= 4 * y.n AND 5 * y.n >= 4 * x.n GROUP BY x.doc_id, y.doc_id) p WHERE 100 * c >= 80 * (m + n - c)),
    ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach AS (SELECT a AS doc_id, b AS other FROM ways UNION SELECT r.doc_id, w.b FROM reach r JOIN ways w ON r.other = w.a),
    least AS (SELECT doc_id, min(other) AS other FROM reach GROUP BY doc_id)
    SELECT f.doc_id, CAST(f.n AS BIGINT) AS n_shingles, least(f.rep, coalesce(l.other, f.rep)) AS component_id, f.doc_id = least(f.rep, coalesce(l.other, f.rep)) AS kept FROM firsts f LEFT JOIN least l ON f.rep = l.doc_id
"""

ORACLE_SQL = {
    "op11_vector_codes": _codes_sql(),
    "op13_minhash_near_dedup": _NEAR,
    "op8_imatch": _IMATCH,
    "op6_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
}
