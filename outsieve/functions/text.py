"""Column functions on text: spans, normalisation, checks. Built-ins only, but for ``decode_escapes``."""

from __future__ import annotations

import html
import re
import unicodedata
import urllib.parse

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPAN = "array<struct<value:string,start:int,end:int>>"


def spans(text: Column, pattern: str, gate: Column | None = None) -> Column:
    """All matches as (value, start, end) in code points; ``gate``: a cheap test tried first.

    Matches and the pieces between them alternate, so a fold over both gives places.
    """
    found, between = F.regexp_extract_all(text, F.lit(pattern), 0), F.split(text, pattern, -1)
    pairs = F.zip_with(found, F.transform(F.slice(between, 1, F.size(found)), F.length), lambda m, g: F.struct(m.alias("0"), g.alias("1")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(a: Column, x: Column) -> Column:
        s = a["at"] + x["1"]
        e = s + F.length(x["0"])
        return F.struct(e.alias("at"), F.concat(a["out"], F.array(F.struct(x["0"].alias("value"), s.alias("start"), e.alias("end")))).alias("out"))

    got = F.aggregate(pairs, start, step, lambda a: a["out"])
    test = text.rlike(pattern) if gate is None else gate & text.rlike(pattern)
    return F.when(test, got).otherwise(F.array().cast(SPAN))


def pinned(c: Column) -> Column:
    """``c``, computed where it stands: the optimiser pushes no predicate on what follows below it.

    Else a filter on the decision (or on exploded findings) is rewritten in terms of the
    text, and the expression of every detector is copied into it over and over.
    """
    return F.when(F.rand(0) >= 0, c)


# --- normalisation ---------------------------------------------------------------

# The entity pattern, zero-width code points and limits must be these for equal results.
ENTITY = r"&(?:[a-zA-Z]+|#x?[0-9a-fA-F]+);"
ZERO_WIDTH = "​‌‍‎‏⁠﻿"
MAX_ENTITIES = 1000
NEEDS_DECODING = r"%[0-9A-Fa-f]{2}|&|[^\x00-\x7F]"

DECODED = T.StructType([T.StructField("text", T.StringType()), T.StructField("steps", T.ArrayType(T.StringType())), T.StructField("entities", T.IntegerType()), T.StructField("anomalies", T.ArrayType(T.StringType()))])


def decode_one(text: str, most: int = MAX_ENTITIES) -> tuple[str, list[str], int, list[str]]:
    """Percent-decode twice at most, HTML-unescape within limits, NFKC."""
    steps, odd, was, passes = [], [], text, 0
    while passes < 2 and (new := urllib.parse.unquote(text)) != text:
        text, passes = new, passes + 1
    if passes == 2:
        odd.append("url_decode_max_passes_reached")
    if text != was:
        steps.append("url_decode")
    n = len(re.findall(ENTITY, text))
    if n > most:
        odd.append(f"html_entity_count_exceeded: {n} > {most}")
    elif len(new := html.unescape(text)) > 2 * most:
        odd.append(f"html_output_length_exceeded: {len(new)} > {2 * most}")
    elif new != text:
        if 0 < (left := len(re.findall(ENTITY, new))) < n:
            odd.append(f"double_encoding_detected: {left} entities remain")
        text = new
        steps.append("html_unescape")
    if (new := unicodedata.normalize("NFKC", text)) != text:
        text = new
        steps.append("nfkc")
    return text, steps, n, odd


@F.pandas_udf(DECODED)
def decode_escapes(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([decode_one(t) for t in text], columns=["text", "steps", "entities", "anomalies"])


def expand_obfuscation(c: Column) -> Column:
    for word, sign in (("at", "@"), ("dot", ".")):
        c = F.regexp_replace(c, rf"(?iU)\[{word}\]|\({word}\)|\{{{word}\}}|\b{word}\b", sign)
    for p in (r"(?U)\s++(?=@)", r"(?U)(?<=@)\s++", r"(?U)\s++(?=\.)", r"(?U)(?<=\.)\s++"):
        c = F.regexp_replace(c, p, "")
    return c


def strip_zero_width(c: Column) -> Column:
    return F.translate(c, ZERO_WIDTH, "")


def strip_control(c: Column) -> Column:
    return F.regexp_replace(c, r"[\p{C}&&[^\n\r\t]]", "")


def newlines(c: Column) -> Column:
    return F.replace(c, F.lit("\r\n"), F.lit("\n"))


def normalise(df: DataFrame, text: str = "response") -> DataFrame:
    """Add ``norm`` struct(text, steps, entities, anomalies).

    Only rows with an escape or a non-ASCII character take the Arrow path; the others
    stay in the JVM, where decoding could only find the text too long.
    """
    raw = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("__raw", raw)
    needs = F.col("__raw").rlike(NEEDS_DECODING)
    long = F.length("__raw") > 2 * MAX_ENTITIES
    plain = F.struct(F.col("__raw").alias("text"), F.array().cast("array<string>").alias("steps"), F.lit(0).alias("entities"), F.when(long, F.array(F.concat(F.lit("html_output_length_exceeded: "), F.length("__raw").cast("string"), F.lit(f" > {2 * MAX_ENTITIES}")))).otherwise(F.array().cast("array<string>")).alias("anomalies"))
    both = df.where(~needs).withColumn("__dec", plain).unionByName(df.where(needs).withColumn("__dec", decode_escapes("__raw")))
    stages = [("expand_obfuscation", expand_obfuscation), ("strip_zero_width", strip_zero_width), ("strip_control", strip_control), ("normalize_newlines", newlines)]
    both = both.withColumn("__t0", F.col("__dec.text"))
    for i, (_, f) in enumerate(stages):
        both = both.withColumn(f"__t{i + 1}", f(F.col(f"__t{i}")))
    changed = [F.when(F.col(f"__t{i}") != F.col(f"__t{i + 1}"), F.lit(n)) for i, (n, _) in enumerate(stages)]
    first = F.when(F.col(text).isNull(), F.array(F.lit("coerce_str"))).otherwise(F.array().cast("array<string>"))
    steps = F.concat(first, F.col("__dec.steps"), F.array_compact(F.array(*changed)))
    norm = F.struct(F.col(f"__t{len(stages)}").alias("text"), steps.alias("steps"), F.col("__dec.entities").alias("entities"), F.col("__dec.anomalies").alias("anomalies"))
    return both.withColumn("norm", pinned(norm)).drop("__raw", "__dec", *(f"__t{i}" for i in range(len(stages) + 1)))


# --- checks ----------------------------------------------------------------------


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\p{Nd}]", "")


def _digit(c: Column, i: int) -> Column:
    return F.substring(c, i, 1).cast("int")


def is_tckn(c: Column) -> Column:
    """Turkish national id: the tenth and eleventh digits check the others."""
    odd, even = sum(_digit(c, i) for i in (1, 3, 5, 7, 9)), sum(_digit(c, i) for i in (2, 4, 6, 8))
    return (_digit(c, 1) != 0) & (_digit(c, 10) == F.pmod(odd * 7 - even, F.lit(10))) & (_digit(c, 11) == sum(_digit(c, i) for i in range(1, 11)) % 10)


def luhn(c: Column) -> Column:
    doubled = F.transform(F.reverse(F.split(c, "")), lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise((x.cast("int") * 2) % 10 + F.floor(x.cast("int") * 2 / 10).cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def entropy(c: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    chars = F.split(c, "")
    n = F.size(chars)
    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, x: a - (F.size(F.filter(chars, lambda y: y == x)) / n) * F.log2(F.size(F.filter(chars, lambda y: y == x)) / n))


def iban_valid(c: Column) -> Column:
    """Mod-97 check of an IBAN without spaces."""
    turned = F.upper(F.concat(F.substring(c, 5, 99), F.substring(c, 1, 4)))
    number = F.transform(F.split(turned, ""), lambda x: F.when(x.rlike("[A-Z]"), (F.ascii(x) - 55).cast("string")).otherwise(x))
    return F.aggregate(F.split(F.array_join(number, ""), ""), F.lit(0), lambda a, x: (a * 10 + x.cast("int")) % 97) == 1


def private_ipv4(c: Column) -> Column:
    return c.rlike(r"^(?:10\.|192\.168\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|127\.|169\.254\.)")


def urlsafe_decoded(c: Column) -> Column:
    """Text of URL-safe base64, padding optional; null where it isn't."""
    plain = F.translate(c, "-_", "+/")
    return F.try_to_binary(F.concat(plain, F.repeat(F.lit("="), F.pmod(-F.length(plain), F.lit(4)))), F.lit("base64")).cast("string")


def is_jwt(c: Column) -> Column:
    parts = F.split(c, r"\.")
    head, body = urlsafe_decoded(parts[0]), urlsafe_decoded(parts[1])
    exp = F.get_json_object(body, "$.exp")
    return (F.size(parts) == 3) & (F.length(parts[0]) <= 2048) & (F.length(parts[1]) <= 4096) & F.get_json_object(head, "$.alg").isNotNull() & F.get_json_object(body, "$").startswith("{") & (exp.isNull() | exp.rlike(r"^-?[0-9.eE+]+$"))


def preview(c: Column, limit: int = 24) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("..."))).otherwise(c)


def masked_email(c: Column) -> Column:
    local = F.substring_index(c, "@", 1)
    domain = F.substr(c, F.length(local) + 2)
    short = F.concat(F.substring(local, 1, 1), F.lit("*@"), domain)
    return F.when(F.length(local) <= 2, short).otherwise(F.concat(F.substring(local, 1, 1), F.lit("***"), F.substring(local, -1, 1), F.lit("@"), domain))


def hostname(url: Column) -> Column:
    """What stands between the scheme and the first slash, up to a colon."""
    return F.lower(F.substring_index(F.substring_index(F.regexp_replace(url, r"^[^:]+://", ""), "/", 1), ":", 1))


def language(c: Column) -> Column:
    return F.when(c.rlike("[çğıöşüÇĞİÖŞÜ]"), "tr").when(c.rlike("[äßÄ]"), "de").otherwise("en")
