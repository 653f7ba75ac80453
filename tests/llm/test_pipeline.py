"""The pipeline, stage by stage, against what each stage promises."""

import re
from pathlib import Path

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def test_stages_in_order(spark):
    import corpus_pipeline as cp
    from quillgraph.llm.common import documents
    from quillgraph.llm.decontaminate import find_overlaps
    from quillgraph.llm.pii import redact
    from quillgraph.llm.quality import score_quality
    from test_corpus import plain_components

    assert [n for n, _ in cp.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "mixing"]
    docs = documents(spark, SF)
    good = cp.quality(spark, docs, SF).cache()
    judged = {r["doc_id"]: r["keep"] for r in score_quality(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert good.columns == docs.columns and {r["doc_id"] for r in good.collect()} == {i for i, k in judged.items() if k}
    rows = sorted(good.collect(), key=lambda r: r["doc_id"])
    unique = cp.near_duplicates(spark, good, SF).cache()
    firsts = {rows[i]["doc_id"] for i, _, c in plain_components([r["text"] for r in rows]) if i == c}
    assert unique.columns == docs.columns and {r["doc_id"] for r in unique.collect()} == firsts
    clean = cp.decontamination(spark, unique, SF).cache()
    leaked = {r["doc_id"] for r in find_overlaps(unique, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == firsts - leaked
    safe = cp.personal_data(spark, clean, SF)
    assert {(r["doc_id"], r["text"]) for r in safe.collect()} == {(r["doc_id"], redact(r["text"])) for r in clean.collect()}
    got = cp.run(spark, SF)
    rows = got.collect()
    assert {r["doc_id"] for r in rows} == firsts - leaked and got.columns == [*docs.columns, "size", "source_size", "target", "taken"]
    assert all(len([w for w in re.split("[\x20\x09-\x0d]+", r["text"]) if w]) == r["taken"] for r in rows) and sum(r["taken"] for r in rows) > 0


def test_a_named_run_resumes(spark, monkeypatch):
    import uuid

    import corpus_pipeline as cp

    ran, name = [], f"run-{uuid.uuid4().hex}"

    def stage(k):
        def go(spark, docs, sf_dir):
            ran.append(k)
            if k == "b" and ran.count("b") == 1:
                raise RuntimeError("the driver is lost")
            return docs.where("doc_id % 2 = 0") if k == "a" else docs

        return k, go

    monkeypatch.setattr(cp, "STAGES", [stage(k) for k in "abc"])
    with pytest.raises(RuntimeError):
        cp.run(spark, SF, resume=name)
    n = cp.run(spark, SF, resume=name).count()
    assert ran == ["a", "b", "b", "c"] and n > 0
    assert cp.run(spark, SF).count() == n and ran[-3:] == ["a", "b", "c"]


def test_registry_is_complete():
    from quillgraph.llm import registry

    assert sorted(int(q[2:].split("_")[0]) for q in registry.QUERIES) == list(range(1, 11))


def test_queries_equal_sql(spark):
    import duckdb

    from quillgraph.llm import registry

    con = duckdb.connect()
    for t in ("pages", "documents"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    for name, sql in registry.ORACLES.items():
        want = con.sql(sql)
        got = registry.QUERIES[name](spark, SF).select(*want.columns)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want.fetchall(), key=repr)
