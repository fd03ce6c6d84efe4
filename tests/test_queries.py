"""Each query against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest

from lectern.plans import queries as core


def rows(frame) -> list[tuple]:
    columns = sorted(frame.columns)
    plain = frame[columns].astype(object)
    plain = plain.where(frame[columns].notna(), None)
    text = lambda v: "" if v is None else repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple((v is None, text(v)) for v in r) for r in plain.values.tolist())


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_same_as_sql(spark, data, duck, name):
    ours = core.queries()[name](spark, data).toPandas()
    theirs = duck.sql(core.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_entry(spark, data):
    import __spark_entry__ as entry

    assert "hard_sentences" in entry.queries()
    assert set(core.oracle_sql()) <= set(entry.queries())


def test_partitions_do_not_matter(spark, data):
    from lectern.plans import pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet").where("lang = 'en'").select("doc_id", "text")
    one, many = (pipeline.hard_sentences(docs.repartition(n), ["doc_id"]).toPandas() for n in (1, 8))
    assert rows(one) == rows(many)
