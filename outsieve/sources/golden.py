"""Golden regression runs: marker substitution, comparison with what is expected, and the files they leave."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import reports
from ..plans.inspect import inspect


def filled(text: Column, markers: dict[str, str]) -> Column:
    """``text`` with each ``{{NAME}}`` marker replaced by its value."""
    for name, value in markers.items():
        text = F.replace(text, F.lit("{{" + name + "}}"), F.lit(value))
    return text


def outcomes(corpus: DataFrame, markers: dict[str, str] | None = None, **how) -> DataFrame:
    """(sample, blocked, rule_ids) of a corpus (sample, text); rule ids sorted, each as often as it fired."""
    rows = corpus.select("sample", filled(F.col("text"), markers or {}).alias("response"))
    return inspect(rows, **how).select("sample", "blocked", F.array_sort("applied_rules").alias("rule_ids"))


def regression(corpus: DataFrame, golden: DataFrame, markers: dict[str, str] | None = None, **how) -> DataFrame:
    """(sample, difference) of the samples whose outcome isn't the golden one, or that one side lacks."""
    return reports.golden_diff(golden, outcomes(corpus, markers, **how))


def write_golden(outcome: DataFrame, path: str) -> None:
    """JSON lines, one sample each, in order of the samples."""
    outcome.select("sample", "blocked", "rule_ids").orderBy("sample").write.mode("overwrite").json(path)


def read_golden(spark, path: str) -> DataFrame:
    return spark.read.schema("sample string, blocked boolean, rule_ids array<string>").json(path)


def table_lines(rows: DataFrame, titles: list[str], most: int = 10_000) -> list[str]:
    """Lines of a Markdown table of a small report; more than ``most`` rows raise."""
    got = rows.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"a report of over {most} rows")
    cell = lambda v: "-" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    return ["| " + " | ".join(titles) + " |", "|" + "---|" * len(titles), *("| " + " | ".join(map(cell, r)) + " |" for r in got)]


def matrix_report(results: DataFrame, notes: dict[str, str] | None = None) -> tuple[str, str]:
    """(JSON, Markdown) of a scenario matrix: decision, score, rules and actions of each, then notes and findings."""
    rows = reports.matrix(results).orderBy("scenario")
    details = results.select("scenario", F.explode_outer("findings").alias("f")).select("scenario", "f.rule_id", "f.action", "f.type", "f.preview").orderBy("scenario", "rule_id")
    found = [r.asDict() for r in rows.collect()]
    lines = ["# Detector matrix", "", *table_lines(rows, ["Scenario", "Blocked", "Risk", "Rules", "Actions"]), "", "## Notes", ""]
    lines += [f"- {r['scenario']}: {(notes or {}).get(r['scenario'], 'no note')}" for r in found]
    lines += ["", "## Findings", "", *table_lines(details, ["Scenario", "Rule", "Action", "Type", "Preview"])]
    return json.dumps(found, indent=2), "\n".join(lines) + "\n"


def period_report(results: DataFrame, latency_ms: str | None = None) -> str:
    """Markdown of a period's results: totals, top rules, latency, contexts, explanations, predictions, advice."""
    total = reports.block_rate(results).first()
    rate = 100.0 * (total["block_rate"] or 0.0)
    explained = reports.explain_only_count(results).first()["explain_only"]
    lines = ["# Period report", "", "## Summary", "", f"- requests: {total['requests']}", f"- blocked: {total['blocked'] or 0}", f"- block rate: {rate:.1f} %"]
    average = 0.0
    if latency_ms:
        at = results.agg(F.avg(latency_ms), F.expr(f"percentile({latency_ms}, array(0.5, 0.95, 0.99))")).first()
        average = at[0] or 0.0
        lines += ["", "## Latency", "", *(f"- {n}: {v:.2f} ms" for n, v in zip(("average", "p50", "p95", "p99"), (average, *(at[1] or (0.0,) * 3)), strict=True))]
    hits = reports.each(results, "applied_rules", "rule_id")
    kinds = reports.share(reports.each(results, "segments", "s").select("s.type"), "type").select("type", "n", F.round("pct", 1).alias("pct")).orderBy(F.desc("n"), "type")
    lines += ["", "## Top rules", "", *table_lines(reports.top_rules(hits), ["Rule", "Hits"]), "", "## Contexts", "", *table_lines(kinds, ["Type", "Count", "%"])]
    lines += ["", f"Explanations: {explained}", "", "## Predictions", "", *table_lines(reports.shadow_counts(results).orderBy("ml_pred", "heuristic", "final"), ["Predicted", "Heuristic", "Final", "Count"])]
    advice = reports.recommendations(results.sparkSession.createDataFrame([(rate, float(average), int(explained))], "block_rate double, avg_latency_ms double, explain_only long")).first()["advice"]
    return "\n".join([*lines, "", "## Advice", "", *(f"- {a}" for a in advice or ["nothing stands out"])]) + "\n"
