"""Queries against their SQL on small tables that have what the generated ones seldom have."""

from datetime import datetime, timedelta

import duckdb
import pytest
from compare import check
from pyspark.sql import functions as F

from orrery.operators import documents
from orrery.plans import registry

START = datetime(2024, 1, 1)


def twin(spark, folder, name, **tables):
    """The query on these tables equals its SQL on them."""
    con = duckdb.connect()
    for t, df in tables.items():
        df.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    check(registry.QUERIES[name](spark, str(folder)), con, registry.ORACLES[name])


def events(spark):
    """Alerts of one asset less than a second from a limit of an hour or a day, and two of one second in the other order."""
    at = [0.6, 3600.4, 3600.7, 7200.6, 7201.1, 10800.65, 86400.2, 86400.5, 90000.4, 93600.5, 93601.4, 172800.3, 172801.6]
    rows = [(n, START + timedelta(seconds=t), 20, "signup", [30.0, 80.0][n % 2], '{"k": 3}') for n, t in enumerate(at)]
    rows += [(100, START + timedelta(seconds=200000.9), 20, "signup", 30.0, '{"k": 3}'), (101, START + timedelta(seconds=200000.1), 20, "signup", 80.0, '{"k": 3}'), (102, START + timedelta(seconds=200000.95), 20, "signup", 30.0, '{"k": 3}')]
    return spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")


@pytest.mark.parametrize("name", ["alert_dedupe_ttl", "alert_dedupe_metrics", "alert_dedupe_runs", "alert_flap_changes", "alert_flapping"])
def test_parts_of_a_second(spark, tmp_path, name):
    twin(spark, tmp_path, name, events=events(spark))


def labelled(spark):
    """One-word texts under several languages, one of them null, texts of one language, and no text."""
    rows = [(1, "que", "es"), (2, "que", "fr"), (3, "in 2024", "fr"), (4, "in 2024", "en"), (5, "in 2024", "de"), (6, "One two. Three 5%.", "en"), (7, "One two. Three 5%.", "en"), (8, "", "en"), (9, "solo", None), (10, None, "en"), (11, "nichts", "de"), (12, "plain", "en")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"source": F.lit("s"), "n_chars": F.length("text")})


@pytest.mark.parametrize("name", ["entity_coverage", "chunk_metrics", "sentence_spans"])
def test_texts_of_several_languages(spark, tmp_path, name):
    docs = labelled(spark)
    twin(spark, tmp_path, name, documents=docs.filter("text IS NOT NULL") if name == "sentence_spans" else docs)


def test_chunks_of_texts_of_several_languages(spark, tmp_path):
    """All but the language of texts that have several: the SQL takes any."""
    con, found = duckdb.connect(), None
    labelled(spark).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = registry.QUERIES["doc_chunks"](spark, str(tmp_path))
    check(found.drop("lang"), con, f"SELECT * EXCLUDE (lang) FROM ({registry.ORACLES['doc_chunks']})")
    assert {r.text: r.lang for r in found.collect()} == {"que que": "es", "in 2024 in 2024 in 2024": "de", "One two. Three 5%.": "en", "solo": None, "nichts": "de", "plain": "en"}


def test_documents_go_by_slices():
    """A task makes Python objects of few rows and bytes at a time."""
    import pyarrow as pa

    short = pa.RecordBatch.from_arrays([pa.array(["x"] * 1000)], names=["text"])
    long = pa.RecordBatch.from_arrays([pa.array(["y" * (1 << 20)] * 10)], names=["text"])
    assert [b.num_rows for b in documents.slices(short)] == [256, 256, 256, 232]
    assert max(b.num_rows for b in documents.slices(long)) <= 4 and sum(b.num_rows for b in documents.slices(long)) == 10
    assert list(documents.slices(short.slice(0, 0))) == []


def test_chunks_take_sentences_one_by_one(spark):
    """What a task gets is a row for each sentence, not a document's array."""
    pages = spark.createDataFrame([("a", 1, "en", "One two. Three four. " * 30)], "doc_sha256 string, page int, lang string, text string")
    plan = documents.chunk(pages, 4, 8)._jdf.queryExecution().optimizedPlan().toString()
    task = plan.index("MapInPandas")
    assert "Generate explode" in plan[task:] and "array<" not in plan[task : plan.index("Generate explode")]
    assert documents.chunk(pages, 4, 8).count() == 15
