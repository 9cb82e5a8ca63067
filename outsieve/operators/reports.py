"""Reports over inspected responses, findings and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = [0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0]


def each(results: DataFrame, column: str, name: str) -> DataFrame:
    """One row an entry of an array column; by ``explode_outer``, of which the optimiser infers no filter to push into the detectors."""
    return results.select(F.explode_outer(column).alias(name)).where(F.col(name).isNotNull())


def top_rules(findings: DataFrame, k: int = 10) -> DataFrame:
    return findings.groupBy("rule_id").agg(F.count("*").alias("hits")).orderBy(F.desc("hits"), "rule_id").limit(k)


def hits_by(findings: DataFrame, column: str) -> DataFrame:
    return findings.groupBy(column).agg(F.count("*").alias("hits"))


def block_rate(results: DataFrame) -> DataFrame:
    return results.agg(F.count("*").alias("requests"), F.sum(F.col("blocked").cast("long")).alias("blocked"), F.avg(F.col("blocked").cast("double")).alias("block_rate"))


def severity_counts(results: DataFrame) -> DataFrame:
    """Findings by severity as they were detected, those that validation drops included."""
    return each(results, "severities", "severity").groupBy("severity").agg(F.count("*").alias("hits"))


def decision_rates(results: DataFrame, time: str, length: str = "1 minute") -> DataFrame:
    """Blocked and allowed responses a second in each window."""
    seconds = F.unix_timestamp("w.end") - F.unix_timestamp("w.start")
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    got = results.groupBy(F.window(time, length).alias("w")).agg(n(F.col("blocked")).alias("b"), n(~F.col("blocked")).alias("a"))
    return got.select(F.col("w.start").alias("start"), (F.col("b") / seconds).alias("blocked_per_second"), (F.col("a") / seconds).alias("allowed_per_second"))


def explain_only_count(results: DataFrame) -> DataFrame:
    """Segments taken for explanations."""
    return results.agg(F.coalesce(F.sum(F.size(F.filter("segments", lambda s: s["explain_only"]))), F.lit(0)).cast("long").alias("explain_only"))


def shadow_counts(results: DataFrame) -> DataFrame:
    """(ml_pred, heuristic, final) of every predicted segment, whether they agree or not."""
    word = lambda c: F.when(c, "educational").otherwise("command")
    s = each(results, "segments", "s").where("s.ml_pred is not null")
    return s.groupBy("s.ml_pred", word(F.col("s.heuristic")).alias("heuristic"), word(F.col("s.explain_only")).alias("final")).agg(F.count("*").alias("n"))


def matrix(results: DataFrame, scenario: str = "scenario") -> DataFrame:
    """(scenario, blocked, risk_score, rules, actions): distinct rule ids and actions in order, '-' where none."""
    joined = lambda field: F.coalesce(F.nullif(F.array_join(F.array_sort(F.array_distinct(F.transform("findings", lambda f: f[field]))), ", "), F.lit("")), F.lit("-"))
    return results.select(scenario, "blocked", "risk_score", joined("rule_id").alias("rules"), joined("action").alias("actions"))


def metric_lines(results: DataFrame, prefix: str = "outsieve") -> DataFrame:
    """(line): counters of a table of results in the text format of metric scrapers, sorted by line."""
    hits = each(results, "applied_rules", "label").groupBy("label").count().select(F.lit("rule_hits_total").alias("name"), F.lit("rule_id").alias("key"), "label", "count")
    severities = severity_counts(results).select(F.lit("rule_severity_total").alias("name"), F.lit("severity").alias("key"), F.col("severity").alias("label"), F.col("hits").alias("count"))
    kinds = each(results, "segments", "s").groupBy(F.col("s.type").alias("label")).count().select(F.lit("context_type_total").alias("name"), F.lit("type").alias("key"), "label", "count")
    total = block_rate(results).select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.coalesce(c, F.lit(0)).cast("long").alias("count")) for n, c in (("requests_total", F.col("requests")), ("blocked_total", F.col("blocked")))])).alias("t")).select("t.name", F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("label"), "t.count")
    rows = hits.unionByName(severities).unionByName(kinds).unionByName(total)
    label = F.when(F.col("key").isNull(), F.lit("")).otherwise(F.concat(F.lit("{"), F.col("key"), F.lit('="'), F.coalesce("label", F.lit("unknown")), F.lit('"}')))
    return rows.select(F.concat(F.lit(f"{prefix}_"), "name", label, F.lit(" "), F.col("count").cast("string")).alias("line")).orderBy("line")


def share(df: DataFrame, column: str) -> DataFrame:
    """Count and percentage of each value; the total is over groups, not rows."""
    got = df.groupBy(column).agg(F.count("*").alias("n"))
    return got.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()))


def per_window(events: DataFrame, time: str, length: str, *by: str) -> DataFrame:
    got = events.groupBy(F.window(time, length).alias("w"), *by).agg(F.count("*").alias("n"))
    return got.select(F.col("w.start").alias("start"), *by, "n")


def rate(events: DataFrame, time: str) -> DataFrame:
    """Events a second in each minute."""
    return per_window(events, time, "1 minute").select("start", (F.col("n") / 60.0).alias("per_second"))


def bucketed_quantile(df: DataFrame, value: str, q: float, bounds: list[float]) -> DataFrame:
    """Quantile from cumulative bucket counts by linear interpolation; the last bound where beyond."""
    counts = df.agg(F.count(value).alias("total"), *[F.sum((F.col(value) <= b).cast("long")).alias(f"c{i}") for i, b in enumerate(bounds)])
    rank, out = F.col("total") * q, F.lit(None).cast("double")
    for i in reversed(range(len(bounds))):
        low, below = (bounds[i - 1], F.col(f"c{i - 1}")) if i else (0.0, F.lit(0))
        here = F.col(f"c{i}")
        out = F.when(here >= rank, low + (bounds[i] - low) * (rank - below) / F.nullif(here - below, F.lit(0))).otherwise(out if i < len(bounds) - 1 else F.lit(bounds[-1]))
    return counts.select(out.alias("quantile"))


def golden_diff(golden: DataFrame, actual: DataFrame, key: str = "sample") -> DataFrame:
    """Samples that differ in ``blocked`` or the sorted rule ids, or are on one side only."""
    g = golden.select(key, F.col("blocked").alias("g_blocked"), F.array_sort("rule_ids").alias("g_rules"))
    a = actual.select(key, F.col("blocked").alias("a_blocked"), F.array_sort("rule_ids").alias("a_rules"))
    both = g.join(a, key, "full_outer")
    state = F.when(F.col("a_rules").isNull(), "missing").when(F.col("g_rules").isNull(), "unexpected").when(F.col("g_blocked") != F.col("a_blocked"), "blocked").when(F.col("g_rules") != F.col("a_rules"), "rules")
    return both.select(key, state.alias("difference")).where("difference is not null")


def confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    return df.groupBy(label, predicted).agg(F.count("*").alias("n"))


def scores(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Precision, recall and F1 of each label; macro F1 is the mean of the last column."""
    cells = confusion(df, label, predicted)
    hit = F.when(F.col("c") == F.col("p"), F.col("n")).otherwise(0)
    cells = cells.select(F.col(label).alias("c"), F.col(predicted).alias("p"), "n")
    actual = cells.groupBy("c").agg(F.sum("n").alias("actual"), F.sum(hit).alias("hit"))
    said = cells.groupBy(F.col("p").alias("c")).agg(F.sum("n").alias("said"))
    both = actual.join(said, "c", "left")
    p, r = F.coalesce(F.col("hit") / F.col("said"), F.lit(0.0)), F.col("hit") / F.col("actual")
    return both.select(F.col("c").alias("label"), p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def recommendations(summary: DataFrame) -> DataFrame:
    """Advice from a one-row summary (block_rate in percent, avg_latency_ms, explain_only)."""
    c = F.col
    return summary.select(F.array_compact(F.array(F.when(c("block_rate") > 20, "block rate over 20 %: review strict rules"), F.when(c("block_rate") < 5, "block rate under 5 %: check coverage"), F.when(c("avg_latency_ms") > 50, "latency over 50 ms: tune patterns"), F.when(c("explain_only") > 0, "explain-only findings: review context settings"))).alias("advice"))
