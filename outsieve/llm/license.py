"""Licence scans by sentence-rule recognition, in DataFrame functions only.

A text is cut into sentences, each normalised (lower case, punctuation and white space
made one space) and mapped to the identifier of the first known licence sentence that it
matches; the sequence of identifiers is then matched against ordered licence rules, each
of which consumes the identifiers it matches. Identifiers that no rule consumes count as
``unmatched``. No shuffle: every row is scored on its own.

Defined results: null and empty texts have no sentence and no licence ('' and 0); a
sentence that matches nothing is skipped; repeated rows each get a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GATE = "(?i)licen[cs]|copyright|rights reserved|warrant|redistribut|permission|public domain|as is|liab"

#: Known licence sentences by identifier; the first whose pattern is found counts.
SENTENCES = [
    ("spdxMIT", "spdx license identifier mit"),
    ("spdxApache", "spdx license identifier apache 2"),
    ("spdxOther", "spdx license identifier"),
    ("apache2", "apache (software )?licen[cs]e,? version 2|apache 2\\.0 licen[cs]e"),
    ("agpl3", "affero general public licen[cs]e"),
    ("lgpl3", "(lesser|library) general public licen[cs]e.*(version|v) ?3"),
    ("lgpl2", "(lesser|library) general public licen[cs]e.*(version|v) ?2"),
    ("lgplAny", "(lesser|library) general public licen[cs]e"),
    ("gpl3", "general public licen[cs]e.*(version|v) ?3"),
    ("gpl2", "general public licen[cs]e.*(version|v) ?2"),
    ("gplAny", "general public licen[cs]e"),
    ("orLater", "any later version"),
    ("mitGrant", "permission is hereby granted free of charge"),
    ("mitNamed", "mit licen[cs]e"),
    ("noticeKept", "above copyright notice and this permission notice"),
    ("bsdNamed", "bsd licen[cs]e"),
    ("bsdGrant", "redistribution and use in source and binary forms"),
    ("bsdSource", "redistributions of source code must retain"),
    ("bsdBinary", "redistributions in binary form must reproduce"),
    ("bsdEndorse", "neither the names? of"),
    ("mpl2", "mozilla public licen[cs]e.*2"),
    ("epl", "eclipse public licen[cs]e"),
    ("isc", "isc licen[cs]e"),
    ("ccByNcSa", "creative commons attribution noncommercial share ?alike|cc by nc sa"),
    ("ccByNc", "creative commons attribution noncommercial|cc by nc"),
    ("ccBySa", "creative commons attribution share ?alike|cc by sa"),
    ("ccBy", "creative commons attribution|cc by"),
    ("cc0", "cc0|public domain"),
    ("asIs", "provided as is|as is basis|without warrant"),
    ("noLiability", "in no event (shall|will)"),
    ("allRights", "all rights reserved"),
    ("copyright", "^(copyright|c) .*[0-9]{4}|copyright c"),
    ("seeFile", "licen[cs]e file|file licen[cs]e|copying file"),
]

#: Licence by the identifiers in a row that show it, tried in this order.
RULES = [
    ("MIT", ",mitGrant,(?:noticeKept,)?(?:asIs,)?(?:noLiability,)?"),
    ("BSD-3-Clause", ",bsdGrant,bsdSource,bsdBinary,bsdEndorse,(?:asIs,)?(?:noLiability,)?"),
    ("BSD-2-Clause", ",bsdGrant,bsdSource,bsdBinary,(?:asIs,)?(?:noLiability,)?"),
    ("GPL-3.0-or-later", ",gpl3,orLater,"),
    ("GPL-2.0-or-later", ",gpl2,orLater,"),
    ("AGPL-3.0", ",agpl3,(?:orLater,)?"),
    ("LGPL-3.0", ",lgpl3,(?:orLater,)?"),
    ("LGPL-2.x", ",lgpl2,(?:orLater,)?"),
    ("LGPL", ",lgplAny,"),
    ("GPL-3.0", ",gpl3,"),
    ("GPL-2.0", ",gpl2,"),
    ("GPL", ",gplAny,"),
    ("Apache-2.0", ",(?:apache2|spdxApache),(?:asIs,)?"),
    ("MIT", ",(?:mitNamed|spdxMIT),(?:asIs,)?"),
    ("BSD", ",bsdNamed,"),
    ("MPL-2.0", ",mpl2,"),
    ("EPL", ",epl,"),
    ("ISC", ",isc,"),
    ("CC-BY-NC-SA", ",ccByNcSa,"),
    ("CC-BY-NC", ",ccByNc,"),
    ("CC-BY-SA", ",ccBySa,"),
    ("CC-BY", ",ccBy,"),
    ("Public-Domain", ",cc0,"),
    ("Proprietary", ",(?:copyright,)?allRights,"),
    ("Other", ",(?:spdxOther|seeFile),"),
]


def sentences(text: Column) -> Column:
    return F.split(F.regexp_replace(text, "([.!?;])[ \t\r\n]+", "$1\n"), "\n", -1)


def normalised(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9.]+", " "))


def identifier(sentence: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for name, pattern in SENTENCES:
        out = out.when(sentence.rlike(pattern), F.lit(name))
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, sentence_ids, licenses, unmatched): comma-joined identifiers, licences in rule order."""
    ids = F.filter(F.transform(F.filter(sentences(F.col(text)), lambda s: s.rlike(GATE)), lambda s: identifier(normalised(s))), lambda x: x.isNotNull())
    found = F.when(F.col(text).rlike(GATE), F.array_join(ids, ",")).otherwise("")
    rows = docs.select(id_col, F.coalesce(found, F.lit("")).alias("__ids"))
    rows = rows.withColumns({"__seq": F.concat(F.lit(","), F.col("__ids"), F.lit(",")), "__got": F.lit("")})
    for name, pattern in RULES:
        hit = F.col("__seq").rlike(pattern)
        rows = rows.select(id_col, "__ids", F.when(hit, F.regexp_replace("__seq", pattern, ",")).otherwise(F.col("__seq")).alias("__seq"), F.when(hit, F.concat("__got", F.lit(f"{name},"))).otherwise(F.col("__got")).alias("__got"))
    left = F.size(F.filter(F.split("__seq", ","), lambda x: x != ""))
    return rows.select(id_col, F.col("__ids").alias("sentence_ids"), F.expr("rtrim(',', __got)").alias("licenses"), left.cast("long").alias("unmatched"))


def scan_sql() -> str:
    """The same in DuckDB's SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    case = " ".join(f"WHEN regexp_matches(s, {quote(p)}) THEN {quote(n)}" for n, p in SENTENCES)
    sql = f"""SELECT doc_id, coalesce(array_to_string(list_filter(list_transform(list_transform(
      list_filter(string_split(regexp_replace(text, '([.!?;])[ \\t\\r\\n]+', '\\1' || chr(10), 'g'), chr(10)), lambda x: regexp_matches(x, {quote(GATE)})),
      lambda x: trim(regexp_replace(lower(x), '[^a-z0-9.]+', ' ', 'g'))), lambda s: CASE {case} END), lambda x: x IS NOT NULL), ','), '') AS ids FROM documents"""
    sql = f"SELECT doc_id, ids, ',' || ids || ',' AS seq, '' AS got FROM ({sql})"
    for name, pattern in RULES:
        sql = f"SELECT doc_id, ids, regexp_replace(seq, {quote(pattern)}, ',', 'g') AS seq, CASE WHEN regexp_matches(seq, {quote(pattern)}) THEN got || {quote(name + ',')} ELSE got END AS got FROM ({sql})"
    return f"SELECT doc_id, ids AS sentence_ids, rtrim(got, ',') AS licenses, len(list_filter(string_split(seq, ','), lambda x: x <> '')) AS unmatched FROM ({sql})"
