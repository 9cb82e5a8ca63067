"""PII surrogates: keyed, type-consistent replacements, in DataFrame functions only.

Entities are found by one alternation of patterns and typed by the first pattern that
the match fits whole. Each distinct entity (type and canonical form: letters lower-cased
or digits alone, so that one entity in two formats stays one) gets a surrogate drawn
from SHA-256 of key, type, entity and attempt; the surrogate keeps each occurrence's
format: digits stay digits, letters keep case and script, punctuation stays, country
codes, titles and prefixes stay, a person keeps the gender the title shows, a card keeps
whether its check digit holds. The entity's surrogate is the same everywhere
(coreference). Given names and surnames are entities of their own, so a surname alone gets
the surname that stands in the full name's surrogate; a phone in a national form, which
here is always one of country code 1, is the phone that shows the code. Collision checks: surrogates that equal a real entity or another's
surrogate move to the next attempt until all are distinct. A phone's surrogate holds the
country code that some occurrence of it shows, so what is compared is what is written.

Defined results: null text stays null, text without entities is untouched; rows that
repeat an id or have none are each rewritten; other columns pass through, but for one
named n_entities where ``counts`` asks for it. At most about 2^27 distinct
IPv4 addresses have room; the loop raises after 40 attempts rather than repeat one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, keyed, scratch, small_enough

_NAME = r"\p{Lu}[\p{Ll}'-]{1,30}"
#: Type and pattern, in order; no capturing groups; repeats are bounded or possessive.
PATTERNS = [
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}\b"),
    ("aws_key", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    ("password", r"\b(?:password|passwd|pwd)=[^\s\"'&*#$%]{6,}+"),
    ("token", r"\b[0-9a-f]{40}\b"),
    ("iban", r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("card", r"\b(?:[0-9]{4}[ -]?){3}[0-9]{4}\b"),
    ("ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"),
    ("ipv4", r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"),
    ("phone", r"\+[0-9]{1,3}[ -]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}\b|(?<![0-9-])[0-9]{3}[-.][0-9]{3}[-.][0-9]{4}(?![0-9-])"),
    ("person", rf"(?<!\p{{L}})(?:Mrs|Mr|Ms|Miss|Herrn|Herr|Frau|Señora|Señor|Monsieur|Madame|Mme|Господин|Госпожа)\.? {_NAME}(?: {_NAME})?"),
]
#: The one country code whose national forms the phone pattern takes.
NATIONAL = "1"
ALL = "|".join(p for _, p in PATTERNS)
FEMALE = "^(?:Mrs|Ms|Miss|Frau|Señora|Madame|Mme|Госпожа)"
_SYLLABLES = ["la", "mi", "ro", "ne", "da", "ve", "so", "ti", "ka", "be", "no", "lu", "ra", "pe", "go", "si"]
_CYRILLIC = ["ла", "ми", "ро", "не", "да", "ве", "со", "ти", "ка", "бе", "но", "лу", "ра", "пе", "го", "си"]
MOST_ATTEMPTS = 40


def kind_of(match: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for name, p in PATTERNS:
        # lookarounds see the match alone here, so they hold at its ends
        out = out.when(match.rlike(f"^(?:{p})$"), F.lit(name))
    return out


def fixed_part(kind: Column, match: Column) -> Column:
    """The start of a match that stays: country code, title, prefix."""
    cut = lambda p: F.regexp_extract(match, p, 0)
    return F.when(kind == "phone", cut(r"^\+[0-9]{1,3}(?=[ (-])")).when(kind == "person", cut(r"^\p{L}+\.? ")).when(kind == "password", cut("^[a-z]+=")).when(kind == "aws_key", F.substring(match, 1, 4)).when(kind == "iban", F.substring(match, 1, 2)).otherwise("")


def canonical(kind: Column, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    return (
        F.when(kind == "phone", F.when(match.startswith("+"), digits).otherwise(F.concat(F.lit(NATIONAL), digits)))
        .when(kind.isin("card", "ssn"), digits)
        .when(kind == "iban", F.regexp_replace(match, " ", ""))
        .when(kind == "email", F.lower(match))
        .when(kind == "person", F.concat(F.when(match.rlike(FEMALE), "f:").otherwise("m:"), F.regexp_replace(match, r"^\p{L}+\.? ", "")))
        .otherwise(match)
    )


def parts(kind: Column, canon: Column) -> Column:
    """The entities that an occurrence is made of, in order: a person's names, else itself."""
    names = F.split(F.substring(canon, 3, 200), " ")
    part = lambda k, c: F.struct(k.alias("kind"), c.alias("canon"))
    last = part(F.lit("surname"), F.element_at(names, -1))
    given = part(F.lit("given"), F.concat(F.substring(canon, 1, 2), F.element_at(names, 1)))
    return F.when(kind != "person", F.array(part(kind, canon))).when(F.size(names) > 1, F.array(given, last)).otherwise(F.array(last))


def _at(digest: Column, i: Column, n: int) -> Column:
    """A number below n from byte i of a hex digest, varied past its length."""
    byte = F.conv(F.substr(digest, (i % 31) * 2 + 1, F.lit(4)), 16, 10).cast("int")
    return (byte + (i / 31).cast("int") * 7) % n


def _mapped(text: Column, digest: Column, hex_letters: bool = False) -> Column:
    """``text`` with each letter and digit replaced by one of its kind."""
    pick = lambda alphabet, i: F.substr(F.lit(alphabet), _at(digest, i, len(alphabet)) + 1, F.lit(1))
    low = "abcdef" if hex_letters else "abcdefghijklmnopqrstuvwxyz"

    def one(c: Column, i: Column) -> Column:
        return (
            F.when(c.rlike("[0-9]"), pick("0123456789", i))
            .when(c.rlike("[a-z]"), pick(low, i))
            .when(c.rlike("[A-Z]"), pick(low.upper(), i))
            .when(c.rlike(r"\p{IsCyrillic}"), pick("абвгдежзиклмнопрстуфхцчшщыэюя", i))
            .when(c.rlike(r"\p{Ll}"), pick("àâéèêîôûñü", i))
            .when(c.rlike(r"\p{Lu}"), pick("ÀÂÉÈÊÎÔÛÑÜ", i))
            .otherwise(c)
        )

    chars = F.split(text, "")
    return F.array_join(F.transform(chars, one), "")


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of the digits that stand before a check digit."""
    body = F.reverse(F.split(digits, ""))
    doubled = F.transform(body, lambda c, i: F.when(i % 2 == 0, (c.cast("int") * 2) % 10 + (c.cast("int") * 2 / 10).cast("int")).otherwise(c.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x)


def _name(digest: Column, cyrillic: Column, attempt: Column) -> Column:
    """A name of four syllables, longer after many collisions, so that there is room for any number."""
    syllables = F.when(attempt < 4, 4).when(attempt < 8, 6).otherwise(10)

    def build(table: list[str]) -> Column:
        one = lambda j: F.element_at(F.array(*map(F.lit, table)), _at(digest, j, 16) + 1)
        return F.initcap(F.array_join(F.transform(F.sequence(F.lit(0), syllables - 1), one), ""))

    return F.when(cyrillic, build(_CYRILLIC)).otherwise(build(_SYLLABLES))


def surrogate(kind: Column, canon: Column, digest: Column) -> Column:
    """Canonical surrogate of a canonical entity (row with attempt), with the first ``__keep`` digits of a phone as they are."""
    octet = lambda i, lo, n: (F.lit(lo) + _at(digest, F.lit(i), n)).cast("string")
    ip = F.concat_ws(".", octet(0, 240, 15), octet(3, 0, 256), octet(6, 0, 256), octet(9, 1, 254))
    email = F.concat(_mapped(F.substring_index(canon, "@", 1), digest), F.lit("@"), F.substring(F.translate(digest, "0123456789", "ghijklmnop"), 40, 8), F.lit(".example."), F.substring_index(canon, ".", -1))
    body = F.concat(F.lit("9"), F.substring(_mapped(canon, digest), 2, 99))
    body = F.substring(body, 1, 15)
    check = (10 - _luhn_sum(body) % 10) % 10
    card = F.concat(body, F.when(F.expr("luhn_check(__canon)"), check).otherwise((check + 1 + _at(digest, F.lit(29), 9)) % 10).cast("string"))
    female, cyrillic = canon.startswith("f:"), canon.rlike(r"\p{IsCyrillic}")
    name = _name(digest, cyrillic, F.col("attempt"))
    end = F.when(cyrillic, F.when(female, "на").otherwise("н")).otherwise(F.when(female, "na").otherwise("n"))
    return (
        F.when(kind == "ipv4", ip)
        .when(kind == "email", email)
        .when(kind == "card", card)
        .when(kind == "ssn", F.concat(F.lit("9"), F.substring(_mapped(canon, digest), 2, 99)))
        .when(kind == "token", F.substring(digest, 1, 40))
        .when(kind == "given", F.concat(F.substring(canon, 1, 2), name, end))
        .when(kind == "surname", name)
        .when(kind == "aws_key", F.concat(F.substring(canon, 1, 4), _mapped(F.substring(canon, 5, 99), digest)))
        .when(kind == "iban", F.concat(F.substring(canon, 1, 2), _mapped(F.substring(canon, 3, 99), digest)))
        .when(kind == "password", F.concat(F.substring_index(canon, "=", 1), F.lit("="), _mapped(F.substr(canon, F.instr(canon, "=") + 1), digest, True)))
        .otherwise(F.concat(F.substr(canon, F.lit(1), F.col("__keep")), F.substr(_mapped(canon, digest), F.col("__keep") + 1)))
    )


def _keyed(key: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.col("__kind"), F.col("__canon"), F.col("attempt").cast("string")), 256)


def assign(entities: DataFrame, key: str) -> DataFrame:
    """(__kind, __canon, sur): distinct surrogates, as they are written, of the distinct entities (__kind, __canon, __keep); none a real entity."""
    draw = lambda df: df.withColumn("sur", surrogate(F.col("__kind"), F.col("__canon"), _keyed(key)))
    real = entities.select("__kind", F.col("__canon").alias("sur"))
    now = scratch(draw(entities.select("__kind", "__canon", "__keep", F.lit(0).alias("attempt"))))
    for _ in range(MOST_ATTEMPTS):
        held = now.groupBy("__kind", "sur").agg(F.count("*").alias("c"), F.min(F.struct("attempt", "__canon")).alias("w")).where("c > 1").select("__kind", "sur", F.col("w.__canon").alias("win"))
        lost = now.join(held, ["__kind", "sur"]).where("__canon <> win").select("__kind", "__canon")
        lost = scratch(lost.union(now.join(real, ["__kind", "sur"], "left_semi").select("__kind", "__canon")).distinct())
        if lost.isEmpty():
            return now.select("__kind", "__canon", "sur")
        again = draw(now.join(lost, ["__kind", "__canon"], "left_semi").select("__kind", "__canon", "__keep", (F.col("attempt") + 1).alias("attempt")))
        now = scratch(now.join(lost, ["__kind", "__canon"], "left_anti").unionByName(again))
    raise RuntimeError("no room for distinct surrogates")


def _dressed(kind: Column, match: Column, fixed: Column, sur: Column) -> Column:
    """The surrogate in the occurrence's own format."""
    rest = F.substr(match, F.length(fixed) + 1)
    # the code's digits that the occurrence keeps, or leaves out in a national form
    skip = F.length(sur) - F.length(F.regexp_replace(rest, "[^0-9]", ""))
    drawn = F.substr(sur, skip + 1)
    before = lambda i: F.length(F.regexp_replace(F.substr(rest, F.lit(1), i + 1), "[^0-9]", ""))
    digits = F.array_join(F.transform(F.split(rest, ""), lambda c, i: F.when(c.rlike("[0-9]"), F.substr(drawn, before(i), F.lit(1))).otherwise(c)), "")
    alnum = lambda i: F.length(F.regexp_replace(F.substr(match, F.lit(1), i + 1), "[^0-9A-Z]", ""))
    iban = F.array_join(F.transform(F.split(match, ""), lambda c, i: F.when(c.rlike("[0-9A-Z]"), F.substr(sur, alnum(i), F.lit(1))).otherwise(c)), "")
    return F.when(kind.isin("phone", "card", "ssn"), F.concat(fixed, digits)).when(kind == "iban", iban).when(kind == "given", F.substring(sur, 3, 200)).otherwise(sur)


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text: str = "text", counts: bool = False) -> DataFrame:
    """``docs`` with every entity replaced; with ``counts`` also n_entities."""
    columns = [c for c in docs.columns if not (counts and c == "n_entities")]
    docs, key_col = keyed(docs.select(*columns), id_col, text)
    hit = docs.where(F.col(text).rlike(ALL))
    plain = docs.where(~F.coalesce(F.col(text).rlike(ALL), F.lit(False)))
    found = scratch(hit.select(F.col(key_col).alias("__d"), F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(ALL), 0))).alias("__m")))
    kinds = found.select("__m").distinct().withColumn("__kind", F.coalesce(kind_of(F.col("__m")), F.lit("other")))
    kinds = kinds.withColumn("__canon", canonical(F.col("__kind"), F.col("__m"))).withColumn("__fixed", fixed_part(F.col("__kind"), F.col("__m")))
    kinds = scratch(kinds.select("__m", "__fixed", F.posexplode(parts(F.col("__kind"), F.col("__canon"))).alias("__at", "__e")).select("__m", "__fixed", "__at", F.col("__e.kind").alias("__kind"), F.col("__e.canon").alias("__canon")))
    kind, m, fixed = F.col("__kind"), F.col("__m"), F.col("__fixed")
    code = F.when(m.startswith("+"), F.length(F.regexp_replace(fixed, "[^0-9]", ""))).otherwise(len(NATIONAL))
    kept = F.when(kind == "phone", code).otherwise(0)
    drawn = assign(scratch(kinds.groupBy("__kind", "__canon").agg(F.max(kept).alias("__keep"))), key)
    dressed = kinds.join(drawn, ["__kind", "__canon"]).withColumn("__r", _dressed(kind, m, fixed, F.col("sur")))
    titled = F.when(kind.isin("given", "surname") & (F.col("__at") == 0), F.concat(fixed, F.col("__r"))).otherwise(F.col("__r"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__at", titled.alias("r")))), lambda p: p["r"]), " ")
    table = scratch(dressed.groupBy("__m").agg(whole.alias("__r")))
    maps = found.join(F.broadcast(table) if small_enough(table, 200_000) else table, "__m").groupBy("__d").agg(F.map_from_entries(F.collect_set(F.struct("__m", "__r"))).alias("__map"))
    by = fresh(docs, "__map")
    maps = maps.select(F.col("__d").alias(key_col), F.col("__map").alias(by))
    joined = hit.join(maps, key_col)
    got = F.regexp_extract_all(F.col(text), F.lit(ALL), 0)
    new = F.array_join(F.zip_with(F.split(F.col(text), ALL, -1), F.concat(F.transform(got, lambda x: F.element_at(F.col(by), x)), F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    more = lambda n: [n.cast("long").alias("n_entities")] if counts else []
    out = joined.select(*[new.alias(c) if c == text else F.col(c) for c in columns], *more(F.size(got)))
    return out.unionByName(plain.select(*columns, *more(F.lit(0))))
