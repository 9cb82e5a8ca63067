"""Sources and sink payloads: text corpora, JSON lines (strict and lenient), event delivery formats."""

from __future__ import annotations

import json
import time
import urllib.request

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REQUEST = "request_id string, response string, policy_id string, metadata map<string,string>"
SAMPLE = "text string, label string, segment_type string, language string"


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """(sample, text) of every .txt file below ``path``; sample is the path relative to it."""
    df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(path, wholetext=True)
    name = F.regexp_replace(F.col("_metadata.file_path"), ".*?" + path.strip("/").replace(".", "\\.") + "/+", "")
    return df.select(F.url_decode(name).alias("sample"), F.col("value").alias("text"))


def json_lines(spark: SparkSession, path: str, schema: str = SAMPLE) -> DataFrame:
    return spark.read.schema(schema).json(path)


def lenient_json_lines(spark: SparkSession, path: str, schema: str = SAMPLE) -> tuple[DataFrame, DataFrame]:
    """(rows, lines that don't parse); blank lines and those that start ``` or # are skipped."""
    lines = spark.read.text(path).where("trim(value) <> '' and not trim(value) rlike '^(```|#)'")
    got = lines.select("value", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return got.where("r._bad is null").select("r.*").drop("_bad"), got.where("r._bad is not null").select("value")


# What a training sample may say and the words its label asks for or forbids.
LABELS, SEGMENT_TYPES = ["educational", "command", "text"], ["code", "text"]
LANGUAGES = ["en", "de", "tr", "es", "fr", "zh", "ru", "pt", "ja", "ko"]
TEACHING_WORDS = [
    "warning", "never", "dangerous", "example", "caution", "avoid", "do not run", "unsafe", "malicious", "tutorial",
    "warnung", "niemals", "uyarı", "asla", "advertencia", "nunca", "avertissement", "jamais", "警告", "切勿",
]
WARNING_WORDS = ["warning", "never", "dangerous", "caution", "avoid", "do not run", "unsafe", "example of", "demonstrates"]


def sample_errors() -> Column:
    """Errors of a training sample: empty array where it is fine."""
    c = F.col
    says = lambda words: F.coalesce(F.lower(c("text")).rlike("|".join(words)), F.lit(False))
    return F.array_compact(F.array(
        F.when(F.coalesce(F.trim(c("text")), F.lit("")) == "", "text missing"), F.when(~F.coalesce(c("label").isin(LABELS), F.lit(False)), "label unknown"),
        F.when(~F.coalesce(c("segment_type").isin(SEGMENT_TYPES), F.lit(False)), "segment_type unknown"), F.when(c("language").isNotNull() & ~c("language").isin(LANGUAGES), "language unknown"),
        F.when((c("label") == "educational") & c("text").isNotNull() & ~says(TEACHING_WORDS), "educational without a warning word"), F.when((c("label") == "command") & says(WARNING_WORDS), "command with a warning word"),
    ))


def _event(df: DataFrame) -> Column:
    return F.struct(*df.columns)


def splunk_payload(df: DataFrame, host: str, source: str, sourcetype: str, index: str, time_col: str = "timestamp") -> DataFrame:
    return df.select(F.to_json(F.struct(F.unix_timestamp(time_col).alias("time"), F.lit(host).alias("host"), F.lit(source).alias("source"), F.lit(sourcetype).alias("sourcetype"), F.lit(index).alias("index"), _event(df).alias("event"))).alias("line"))


def elastic_payload(df: DataFrame, name: str, time_col: str = "timestamp") -> DataFrame:
    index = F.concat(F.lit(f"{name}-"), F.date_format(time_col, "yyyy.MM.dd"))
    doc = F.struct(F.col(time_col).alias("@timestamp"), *[c for c in df.columns if c != time_col])
    action = F.to_json(F.struct(F.struct(index.alias("_index")).alias("index")))
    return df.select(F.concat(action, F.lit("\n"), F.to_json(doc)).alias("line"))


def webhook_payload(df: DataFrame, source: str, batch: int = 100) -> DataFrame:
    """Batches of at most ``batch`` events each; a batch is dealt by row hash, never one list of all."""
    rows = df.select(_event(df).alias("e"))
    n = F.monotonically_increasing_id()
    dealt = rows.select("e", F.spark_partition_id().alias("p"), F.floor(n.bitwiseAND((1 << 33) - 1) / batch).alias("b"))
    return dealt.groupBy("p", "b").agg(F.collect_list("e").alias("events")).select(F.to_json(F.struct(F.lit(source).alias("source"), F.size("events").alias("event_count"), "events")).alias("line"))


def post(url: str, body: str, headers: dict[str, str] | None = None, retries: int = 3, delay: float = 1.0, method: str = "POST") -> bool:
    """Send with ``retries`` further tries and linear backoff; true below status 400."""
    for attempt in range(retries + 1):
        try:
            req = urllib.request.Request(url, data=body.encode(), headers={"Content-Type": "application/json", **(headers or {})}, method=method)
            with urllib.request.urlopen(req, timeout=10) as r:
                if r.status < 400:
                    return True
        except OSError:
            pass
        if attempt < retries:
            time.sleep(delay * (attempt + 1))
    return False


def deliver(df: DataFrame, url: str, batch: int = 100, **how) -> None:
    """Send ``line`` rows from the executors in newline-joined batches; a failed batch fails its task, which Spark retries."""

    def send(rows) -> None:
        held: list[str] = []
        for r in rows:
            held.append(r["line"])
            if len(held) >= batch:
                if not post(url, "\n".join(held) + "\n", **how):
                    raise OSError("delivery failed")
                held = []
        if held and not post(url, "\n".join(held) + "\n", **how):
            raise OSError("delivery failed")

    df.foreachPartition(send)


def validate_sink(options: dict) -> list[str]:
    """What is wrong with a sink's options."""
    need = {"splunk": ("url", "token"), "elastic": ("url", "index"), "webhook": ("url",)}
    kind = options.get("kind")
    if kind not in need:
        return [f"unknown sink {json.dumps(kind)}"]
    out = [f"{k} missing" for k in need[kind] if not options.get(k)]
    return out + ([] if 1 <= int(options.get("batch", 100)) <= 1000 else ["batch not within 1..1000"])
