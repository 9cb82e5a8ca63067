"""The whole inspection of a table of responses, one map-only plan per policy."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import decide, detect, segments
from .policy import DEFAULT, Policy, select

MOST_BYTES = 524_288


def oversized(df: DataFrame, text: str = "response", most: int = MOST_BYTES) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) by size in bytes; null counts as empty."""
    size = F.octet_length(F.coalesce(F.col(text), F.lit("")))
    return df.where(size <= most), df.where(size > most)


def _one(df: DataFrame, policy: Policy, text: str, tenant: str | None, classifier: str | None, parse: bool, bypass: bool, validate: bool, predictions: str | None) -> DataFrame:
    c = F.col
    df = X.normalise(df, text)
    t = c("norm.text")
    df = segments.segmented(df, t, "segments", classifier, predictions) if parse else df.withColumn("segments", segments.whole(t))
    df = detect.detected(df, policy, t, c(tenant) if tenant else F.lit(None).cast("string"))
    df = df.withColumn("severities", F.transform("findings", lambda f: f["severity"]))  # of all findings, before they are validated
    found = decide.valid_findings(c("findings")) if validate else c("findings")
    at = F.transform(found, lambda f: F.struct(f.alias("f"), segments.context_of(c("segments"), f["start"], f["end"]).alias("x")))
    df = df.withColumn("__at", at)
    df = df.withColumn("findings", F.transform("__at", lambda p: p["f"].withField("context", p["x"]["context"]).withField("explain_only", p["x"]["explain_only"]))).drop("__at")
    f = c("findings")
    df = df.withColumns({"blocked": decide.blocked(f, policy.context, bypass), "risk_score": decide.risk(f, policy.context), "applied_rules": F.transform(f, lambda x: x["rule_id"]), "message_key": decide.message_key(f, policy.context, bypass)})
    out = F.when(c("blocked"), decide.message(c("message_key"))).otherwise(decide.redacted(t, f))
    return df.withColumn("output", out).withColumn("policy_used", F.lit(policy.id))


def inspect(df: DataFrame, policies: dict[str, Policy] | None = None, text: str = "response", policy_id: str | None = None, tenant: str | None = None, classifier: str | None = "heuristic-v0", parse: bool = True, bypass: bool = False, validate: bool = True, predictions: str | None = None, most_bytes: int | None = None) -> DataFrame:
    """Rows of ``df`` with norm, segments, findings, severities, blocked, risk_score, applied_rules, message_key, output.

    ``policy_id``, ``tenant`` and ``predictions`` name columns. Rows are told apart by policy
    first, so every policy's rules are constants of its own plan; no shuffle in any of them.
    With ``most_bytes`` larger texts are left out (``oversized`` gives them).
    """
    if most_bytes is not None:
        df = oversized(df, text, most_bytes)[0]
    policies = policies or {"default": DEFAULT}
    run = lambda d, p: _one(d, p, text, tenant, classifier, parse, bypass, validate, predictions)
    if policy_id is None or len(policies) == 1:
        return run(df, select(policies, None))
    key = F.coalesce(F.col(policy_id), F.lit(""))
    parts = [run(df.where(key == name), p) for name, p in policies.items()]
    parts.append(run(df.where(~key.isin(*policies)), select(policies, None)))
    return reduce(DataFrame.unionByName, parts)


def findings_of(inspected: DataFrame, *keep: str) -> DataFrame:
    """One row per finding, with ``keep`` columns of its response and its order."""
    rows = inspected.select(*keep, X.pinned(F.col("findings")).alias("findings"))
    return rows.select(*keep, F.posexplode_outer("findings").alias("ordinal", "f")).where("ordinal is not null").select(*keep, "ordinal", "f.*")
