"""The text queries with SQL agree with it on the smallest tables; those without give sound rows."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")
from quillpanel.llm import queries  # noqa: E402

from .. import oracle  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.SF), reason="no tables")


@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_agrees(spark, name):
    oracle.check(spark, oracle.tables(duckdb), queries.QUERIES[name], queries.ORACLE[name])


def test_every_document_lies_in_a_container(spark):
    out = queries.p8_containers(spark, oracle.SF).cache()
    docs = {r[0] for r in spark.read.parquet(f"{oracle.SF}/documents.parquet").select("doc_id").collect()}
    assert {r["doc_id"] for r in out.collect()} == docs
    assert queries.packing.fill(out).first()["fullest"] <= 2048


def test_subjects_are_known(spark):
    known = {r[0] for r in spark.read.parquet(f"{oracle.SF}/subjects.parquet").select("subject").collect()}
    assert {r["subject"] for r in queries.p10_found(spark, oracle.SF).collect()} <= known
