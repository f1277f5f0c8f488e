import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from umbra.functions import checks
from umbra.operators import evaluate
from umbra.operators.spans import entity
from umbra.schema import ENTITIES
from umbra.sources import documents, stores
from umbra.streaming.stream import redact_stream


def test_generator_is_repeatable_and_valid(spark):
    a, b = documents.generate(spark, 40, 1).collect(), documents.generate(spark, 40, 1).collect()
    assert a == b
    df = spark.createDataFrame([(r.text[e.start : e.end], e.type) for r in a for e in r.entities], "w string, t string")
    assert df.where((F.col("t") == "SVN") & ~checks.svnr_ok(F.col("w"))).count() == 0
    assert df.where((F.col("t") == "IBAN") & ~checks.iban_ok(F.col("w"))).count() == 0


def test_samples(spark, tmp_path):
    path = tmp_path / "s.json"
    path.write_text(json.dumps([{"id": "a", "text": "Hallo", "entities": [{"start": 0, "end": 5, "type": "PER"}]}, {"id": "b", "text": "x", "entities": [{"start": 0, "end": 9, "type": "PER"}]}]))
    rows = {r.id: r.problem for r in documents.read_samples(spark, str(path), strict=False).collect()}
    assert rows == {"a": None, "b": "an entity lies outside the text"}
    with pytest.raises(Exception, match="bad sample"):
        documents.read_samples(spark, str(path)).collect()


def test_greedy_matching_and_scores(spark):
    e = lambda g, a, b: entity(F.lit("w"), g, 0.9, F.lit(a), F.lit(b), "x")
    t = lambda g, a, b: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(g).alias("type"))
    df = spark.range(1).select(F.array(e("PER", 0, 10), e("PER", 1, 10), e("LOC", 20, 25)).cast(ENTITIES).alias("predicted"), F.array(t("PER", 1, 10), t("ORG", 20, 25)).alias("truth"))
    rows = {r.category: (r.tp, r.fp, r.fn) for r in evaluate.evaluate(df).collect()}
    assert rows == {"PER": (1, 1, 0), "LOC": (0, 1, 0), "ORG": (0, 0, 1), None: (1, 2, 1)}


def test_gate(spark):
    base = spark.createDataFrame([("SVN", 1.0, 1.0), (None, 0.9, 0.9)], "category string, recall double, f1 double")
    worse = spark.createDataFrame([("SVN", 0.5, 0.6), (None, 0.7, 0.7)], "category string, recall double, f1 double")
    assert evaluate.compare(base, base, critical=("SVN",)).count() == 0
    assert evaluate.compare(base, worse, critical=("SVN",)).count() == 3


def test_retention(spark):
    now = dt.datetime(2026, 1, 1)
    rows = [(now - dt.timedelta(days=d), f"w{d}", str(d)) for d in (1, 90, 91, 2555, 2556)] + [(None, "keep", "n")]
    log = spark.createDataFrame(rows, "timestamp timestamp, entity_word string, document_id string")
    at = F.lit("2026-01-01").cast("timestamp")
    kept = {r.document_id: r.entity_word for r in stores.enforce_retention(log, at).collect()}
    assert kept == {"1": "w1", "90": "w90", "91": stores.REDACTED, "2555": stores.REDACTED, "n": "keep"}
    assert tuple(stores.retention_summary(log, at).first()) == (2, 1)
    assert stores.forget(log, log.where("document_id = '1'")).count() == 5


def test_mappings(spark):
    rows = spark.createDataFrame([(1, 1, "[A_1]", "x"), (1, 2, "[A_1]", "y"), (2, 1, "[A_1]", "z")], "doc_id long, version int, placeholder string, original string")
    assert {(r.doc_id, r.original) for r in stores.latest_mappings(rows).collect()} == {(1, "y"), (2, "z")}
    assert stores.lookup_mapping(rows, 2).first().original == "z"


def test_stream_equals_batch(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    spark.createDataFrame([(1, "an max@example.at"), (2, "nichts")], "doc_id long, text string").write.parquet(str(src))
    q = redact_stream(spark, str(src), str(out), "doc_id long, text string", channel="ifg")
    q.awaitTermination()
    rows = {r.doc_id: r.output for r in spark.read.parquet(str(out / "results")).collect()}
    assert rows == {1: "an [GESCHWÄRZT:EMAIL]", 2: "nichts"}


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
