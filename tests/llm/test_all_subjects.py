"""No subject is dropped, however many there are."""

from quillpanel.llm import queries


def test_every_subject_is_read(spark, tmp_path):
    spark.range(1001).selectExpr("'s' || id AS subject").write.parquet(str(tmp_path / "subjects.parquet"))
    assert len(queries._names(spark, str(tmp_path))) == 1001
