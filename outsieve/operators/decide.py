"""Policy decision and redaction over a row's findings: folds within the row, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.policy import MESSAGES, Context

UNKNOWN_WEIGHT, MOST_RISK = 10, 100
VALID_EMAIL = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"


def adjusted(f: Column, context: Context) -> Column:
    """A finding's weight where it stands."""
    w = F.coalesce(f["weight"], F.lit(UNKNOWN_WEIGHT))
    if not context.enabled:
        return F.greatest(w, F.lit(0))
    w = w - F.when(f["explain_only"] & (f["type"] == "cmd"), context.explain_only_penalty).otherwise(0)
    w = w - F.when((f["context"] == "code") & ~f["explain_only"], context.code_block_penalty).otherwise(0)
    w = w + F.when((f["context"] == "link") & (f["type"] == "url"), context.link_context_bonus).otherwise(0)
    return F.greatest(w, F.lit(0))


def bypassed(f: Column, context: Context, bypass: bool) -> Column:
    return f["explain_only"] & ((f["type"] == "cmd") | (adjusted(f, context) < 5)) if bypass else F.lit(False)


def risk(found: Column, context: Context) -> Column:
    return F.least(F.aggregate(found, F.lit(0), lambda a, f: a + adjusted(f, context)), F.lit(MOST_RISK))


def blocked(found: Column, context: Context, bypass: bool = False) -> Column:
    return F.exists(found, lambda f: (f["action"] == "block") & ~bypassed(f, context, bypass))


def message_key(found: Column, context: Context, bypass: bool = False) -> Column:
    said = F.transform(F.filter(found, lambda f: f["safe_message"].isNotNull() & ~bypassed(f, context, bypass)), lambda f: f["safe_message"])
    return F.coalesce(F.try_element_at(said, F.lit(1)), F.when(blocked(found, context, bypass), F.lit("blocked")))


def message(key: Column, messages: dict[str, str] | None = None) -> Column:
    """The text of a key; ``messages``: of a loaded file, else the default ones."""
    messages = messages or MESSAGES
    table = F.create_map(*[F.lit(x) for kv in messages.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.coalesce(key, F.lit("blocked"))), F.lit(messages.get("blocked", MESSAGES["blocked"])))


def replacement(f: Column) -> Column:
    put = F.coalesce(f["replacement"], F.lit("[REDACTED]"))
    return F.when(f["action"] == "annotate", F.concat(F.lit("[flagged:"), f["rule_id"], F.lit("]"))).when(f["action"] == "remove", F.lit("")).when(f["action"] == "delink", F.coalesce(f["replacement"], F.lit("[redacted-url]"))).otherwise(put)


def redacted(text: Column, found: Column) -> Column:
    """The text with replacements put in, by start then finding order; overlaps keep the first."""
    cuts = F.transform(F.filter(F.transform(found, lambda f, i: F.struct(f["start"].alias("start"), i.alias("i"), f["end"].alias("end"), f["action"].alias("action"), replacement(f).alias("put"))), lambda c: c["action"] != "block"), lambda c: c)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda a, c: F.when(c["start"] < a["at"], a).otherwise(F.struct(F.greatest(a["at"], c["end"]).alias("at"), F.concat(a["out"], F.substr(text, a["at"] + 1, c["start"] - a["at"]), c["put"]).alias("out")))
    return F.aggregate(F.array_sort(cuts), start, step, lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1)))


def valid_findings(found: Column) -> Column:
    """E-mail findings must pass a second, stricter pattern."""
    return F.filter(found, lambda f: (f["kind"] != "email") | f["kind"].isNull() | (f["type"] != "pii") | f["value"].rlike(VALID_EMAIL))
