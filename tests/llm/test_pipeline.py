"""The pipeline against a run of its stages by hand."""

from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_near_align_codes import kept_by_hand, split
from tests.llm.test_operators import SCHEMA, SF, awkward, empty, ids_by_hand, rows_of, words_of  # noqa: F401
from tracemine.llm import mixing, quality
from tracemine.llm.common import DOCUMENT_COLUMNS, table


def rows_by_hand(spark, docs, labels):
    """Rows (doc_id, text, source) after the four filtering stages, the mix taken from its operator on what the others leave by hand, and the copies that it takes."""
    model = quality.fit(docs, labels)
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    rows = [r for r in rows if round(float(model.scores(np.array([quality.statistics(r[1] or "")]))[0]), 9) >= 0.7]
    largest = {}
    for i, t, _ in rows:
        largest[t or ""] = max(largest.get(t or "", -1), -1 if i is None else i)
    once = {}
    for r in rows:
        if (-1 if r[0] is None else r[0]) == largest[r[1] or ""]:
            once.setdefault(r[1] or "", r)
    rows = list(once.values())
    blank, first = kept_by_hand([(i, t or "") for i, t, _ in rows])
    rows = [r for r in rows if (r[0], r[1] or "") in blank or (r[0], " ".join(split(r[1] or ""))) in first]
    left = spark.createDataFrame(rows, "doc_id long, text string, source string")
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(left).collect()}
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len([w for w in words_of(t or "") if w])
    return rows, copies, sizes


def test_pipeline(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows, copies, _ = rows_by_hand(spark, docs, labels)
    expected = Counter()
    for i, t, _ in rows:
        if copies[i]:
            expected[i, ids_by_hand(t or "")] += copies[i]
    found = corpus_pipeline.run(spark, SF)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in found.collect()) == expected and len(expected) > 50


def test_each_stage_on_awkward_and_empty_tables(spark, awkward, empty, tmp_path):  # noqa: F811
    docs = awkward.unionByName(table(spark, "/root/testdata/sf0.01", "documents").where("doc_id < 150"), allowMissingColumns=True)
    for name, t in (("documents", docs), ("labels", table(spark, "/root/testdata/sf0.01", "labels"))):
        t.write.parquet(f"{tmp_path}/{name}.parquet")
    for start in (spark.read.parquet(f"{tmp_path}/documents.parquet"), empty):
        now = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, now, str(tmp_path))
            assert tuple(after.columns) == DOCUMENT_COLUMNS
            known = Counter(map(tuple, now.select("doc_id", "text").collect()))
            kept = Counter(map(tuple, after.select("doc_id", "text").collect()))
            assert set(kept) <= set(known) and (name == "mixing" or not kept - known)
            now = after
        last = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path))
        assert last.columns == ["doc_id", "ids"] and last.count() == now.count()


def test_the_mix_meets_its_targets(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text", "source")
    for r in mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("most")).collect():
        assert r["taken"] == pytest.approx(r["target"], abs=r["most"])
