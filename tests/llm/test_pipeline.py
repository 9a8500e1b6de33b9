"""The pipeline's stages on the smallest tables, each against what its operator says of its input."""

from __future__ import annotations

import os
from collections import Counter

import pytest

import corpus_pipeline as p
from tessera.llm import decontaminate, jaccard, pii

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    names = [n for n, _ in p.STAGES]
    assert len(names) == 5
    for k, (name, stage) in enumerate(p.STAGES):
        out = stage(spark, docs, SF)
        if k < 4:
            assert out.columns == docs.columns == list(p.COLUMNS)
        out.write.parquet(f"{tmp_path}/{k}")
        done = spark.read.parquet(f"{tmp_path}/{k}")
        if k == 4:
            assert done.select("doc_id").distinct().count() == docs.count()
            break
        now = {r.doc_id: r.text for r in done.collect()}
        if name == "n-gram Jaccard join":
            assert now.keys() == {r.class_id for r in jaccard.join(docs).collect()}
        if name == "benchmark decontamination":
            assert before.keys() - now.keys() == {r.doc_id for r in decontaminate.find(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
        if name == "PII":
            assert now.keys() == before.keys() and not any(pii.entities(t) for t in now.values() if t)
            assert all(t == before[i] for i, t in now.items() if not pii.entities(before[i]))
        else:
            assert all(t == before[i] for i, t in now.items())
        docs, before = done, now


ODD = "doc_id long, text string, lang string, source string, n_chars long, h long, node string, label string, kind int, term string, _keep boolean, length long, __tessera_site__ string"


def odd(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None, 1, "n", "l", 2, "t", True, 3, "s") for i, t in rows], ODD)


@pytest.mark.parametrize("k", range(5))
def test_stages_on_odd_tables(spark, k):
    name, stage = p.STAGES[k]
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    same = "one and the same text of some words that stands here again and again"
    rows = [(None, None), (None, ""), (1, " \n"), (1, same), (1, same), (2, same), (None, same), (3, "Mail a.b@c.example.com, now."), (3, f"so {item} it is"), (4, "y" * 100_000), (4, "plain words of no import")]
    got = stage(spark, odd(spark, rows), SF)
    if k == 4:
        assert Counter(r.doc_id for r in got.where("start = 0").collect()) == Counter(i for i, _ in rows)
        assert stage(spark, odd(spark, []), SF).count() == 0
        return
    assert got.columns == list(p.COLUMNS)
    found = Counter((r.doc_id, r.text) for r in got.collect())
    if name == "n-gram Jaccard join":
        assert found == Counter([x for x in rows if x[1] != same]) + Counter([(1, same)])
    if name == "benchmark decontamination":
        assert found == Counter([x for x in rows if item not in (x[1] or "")])
    if name == "PII":
        assert found == Counter([x for x in rows if "@" not in (x[1] or "")]) + Counter([(3, "Mail [EMAIL], now.")])
    if name == "quality classifier":
        assert not found - Counter(rows)
    assert stage(spark, odd(spark, []), SF).count() == 0


def test_run_is_registered(spark):
    import __spark_entry__ as e

    assert e.queries()["pipeline"] is p.run
    assert set(p.ORACLE_SQL or []) == set()
