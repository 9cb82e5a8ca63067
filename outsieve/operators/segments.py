"""Segmentation of a text into prose, code and links, and the context a finding stands in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

# Markdown patterns, hint words and the window looked at.
FENCED = r"(?sU)```\w*\n.*?```"
INLINE = r"`[^`\n]+`"
LINK = r"\[[^\]]+\]\([^)]+\)"
RAW_URL = r"(?iU)(?<![`\w])https?://[^\s\])>\"'`]+"
EXPLAIN_WORDS = [
    "example", "avoid", "never", "dangerous", "warning", "caution", "don't", "do not", "tutorial", "demonstrates", "here's how", "here is how", "shows how", "learn", "explain",
    "explanation", "do not run", "malicious", "unsafe", "insecure", "vulnerable", "attack", "exploit", "for educational", "for learning", "bad practice", "anti-pattern", "antipattern", "what not to do",
]
COMMAND_WORDS = ["curl", "wget", "powershell", "kubectl", "select", "insert", "delete"]
WINDOW = 200
SEGMENT = "array<struct<type:string,content:string,start:int,end:int,lang:string,url:string,link_text:string,fenced:boolean,raw:boolean,explain_only:boolean,ml_pred:string,heuristic:boolean>>"
# Predictions that call a code segment an explanation, and those that call it a command.
EXPLAINS, COMMANDS = ["educational", "explain_only", "text"], ["command", "executable", "malicious"]


def _inside(s: Column, *ranges: Column) -> Column:
    out = F.lit(False)
    for r in ranges:
        out = out | F.exists(r, lambda x: (x["start"] <= s["start"]) & (s["start"] < x["end"]))
    return out


def predicted(content: Column) -> Column:
    """The keyword classifier: ``command`` or ``text``."""
    return F.when(F.lower(content).rlike("|".join(COMMAND_WORDS)), "command").otherwise("text")


def segmented(df: DataFrame, text: Column, name: str = "segments", classifier: str | None = "heuristic-v0", predictions: str | None = None) -> DataFrame:
    """Add the segments in order; ``classifier``: None for hint words alone, or ``heuristic-v0``.

    ``predictions`` names a column map<string,string> from the content of a code segment to
    a trained model's prediction, which then counts instead of the classifier; a segment
    without one, or with an unknown one, goes by the hint words. Each kind of span is a column of its own, so that no expression holds another twice.
    """
    null = lambda t: F.lit(None).cast(t)

    def hints(s: Column) -> Column:
        begin = F.greatest(s["start"] - WINDOW, F.lit(0))
        around = F.concat(F.substr(text, begin + 1, s["start"] - begin), F.lit(" "), F.substr(text, s["end"] + 1, F.lit(WINDOW)))
        return F.lower(around).rlike("|".join(EXPLAIN_WORDS))

    def code(s: Column, content: Column, lang: Column, fenced: bool) -> Column:
        said = F.try_element_at(F.col(predictions), content) if predictions else predicted(content) if classifier else null("string")
        hinted = hints(s)
        explain = F.coalesce(F.when(said.isin(EXPLAINS), True).when(said.isin(COMMANDS), False), hinted)
        return F.struct(F.lit("code").alias("type"), content.alias("content"), s["start"].alias("start"), s["end"].alias("end"), lang.alias("lang"), null("string").alias("url"), null("string").alias("link_text"), F.lit(fenced).alias("fenced"), F.lit(False).alias("raw"), explain.alias("explain_only"), said.alias("ml_pred"), hinted.alias("heuristic"))

    def link(s: Column, url: Column, label: Column, raw: bool) -> Column:
        return F.struct(F.lit("link").alias("type"), url.alias("content"), s["start"].alias("start"), s["end"].alias("end"), null("string").alias("lang"), url.alias("url"), label.alias("link_text"), F.lit(False).alias("fenced"), F.lit(raw).alias("raw"), F.lit(False).alias("explain_only"), null("string").alias("ml_pred"), null("boolean").alias("heuristic"))

    tick = F.contains(text, F.lit("`"))
    fenced, inline, marked, raw = (F.col(f"__{c}") for c in ("fenced", "inline", "marked", "raw"))
    df = df.withColumns({"__fenced": X.spans(text, FENCED, tick), "__inline": X.spans(text, INLINE, tick), "__marked": X.spans(text, LINK, F.contains(text, F.lit("]("))), "__raw": X.spans(text, RAW_URL, F.contains(text, F.lit("://")))})
    df = df.withColumn("__inline", F.filter(inline, lambda s: ~_inside(s, fenced)))
    df = df.withColumn("__marked", F.filter(marked, lambda s: ~_inside(s, fenced, inline)))
    df = df.withColumn("__raw", F.filter(raw, lambda s: ~_inside(s, fenced, inline, marked)))
    group = lambda v, p, g: F.regexp_extract(v, p, g)
    all_of = F.concat(
        F.transform(fenced, lambda s: code(s, group(s["value"], r"(?sU)```\w*\n(.*?)```", 1), F.nullif(group(s["value"], r"(?U)^```(\w*)", 1), F.lit("")), True)),
        F.transform(inline, lambda s: code(s, F.substr(s["value"], F.lit(2), F.length(s["value"]) - 2), null("string"), False)),
        F.transform(marked, lambda s: link(s, group(s["value"], r"\]\(([^)]+)\)", 1), group(s["value"], r"\[([^\]]+)\]", 1), False)),
        F.transform(raw, lambda s: link(s, s["value"], null("string"), True)),
    ).cast(SEGMENT)
    df = df.withColumn("__cuts", F.array_sort(all_of, lambda a, b: a["start"] - b["start"])).drop("__fenced", "__inline", "__marked", "__raw")

    def prose(begin: Column, end: Column) -> Column:
        content = F.substr(text, begin + 1, end - begin)
        one = F.array(F.struct(F.lit("text").alias("type"), content.alias("content"), begin.alias("start"), end.alias("end"), null("string").alias("lang"), null("string").alias("url"), null("string").alias("link_text"), F.lit(False).alias("fenced"), F.lit(False).alias("raw"), F.lit(False).alias("explain_only"), null("string").alias("ml_pred"), null("boolean").alias("heuristic"))).cast(SEGMENT)
        return F.when((end > begin) & content.rlike(r"(?U)\S"), one).otherwise(F.array().cast(SEGMENT))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(SEGMENT).alias("out"))
    step = lambda a, s: F.when(s["start"] < a["at"], a).otherwise(F.struct(s["end"].alias("at"), F.concat(a["out"], prose(a["at"], s["start"]), F.array(s)).alias("out")))
    whole_row = F.aggregate("__cuts", start, step, lambda a: F.concat(a["out"], prose(a["at"], F.length(text))))
    return df.withColumn(name, X.pinned(whole_row)).drop("__cuts")


def whole(text: Column) -> Column:
    """One prose segment: segmentation switched off."""
    null = lambda t: F.lit(None).cast(t)
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("content"), F.lit(0).alias("start"), F.length(text).alias("end"), null("string").alias("lang"), null("string").alias("url"), null("string").alias("link_text"), F.lit(False).alias("fenced"), F.lit(False).alias("raw"), F.lit(False).alias("explain_only"), null("string").alias("ml_pred"), null("boolean").alias("heuristic"))).cast(SEGMENT)


def has_code(segs: Column) -> Column:
    return F.exists(segs, lambda s: s["type"] == "code")


def has_explain_only(segs: Column) -> Column:
    return F.exists(segs, lambda s: s["explain_only"])


def context_of(segs: Column, start: Column, end: Column) -> Column:
    """struct(context, explain_only) of the segment at ``start``, else the first that overlaps, else prose."""
    at = F.filter(segs, lambda s: (s["start"] <= start) & (start < s["end"]))
    over = F.filter(segs, lambda s: (s["start"] < end) & (s["end"] > start))
    s = F.coalesce(F.try_element_at(at, F.lit(1)), F.try_element_at(over, F.lit(1)))
    return F.struct(F.coalesce(s["type"], F.lit("text")).alias("context"), F.coalesce(s["explain_only"], F.lit(False)).alias("explain_only"))
