"""Detectors: a rule's findings as an array of structs, built from column functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.policy import FAMILIES, Allow, Policy, Rule

FINDING = "array<struct<family:int,ord:int,rule_id:string,action:string,type:string,kind:string,start:int,end:int,value:string,snippet_hash:string,replacement:string,preview:string,pattern:string,reason:string,length:int,weight:int,severity:string,safe_message:string>>"

# Detector patterns (possessive where a repeat runs over unbounded text).
EMAIL = r"(?U)\b[A-Za-z0-9ıİſK._%+-]+@[A-Za-z0-9ıİſK.-]+\.[A-Za-zıİſK]{2,}\b"
PHONES = {
    "phone_tr": r"(?U)\b(?:\+?90|0)?\s?(?:5\d{2}|[2348]\d{2})[\s-]?\d{3}[\s-]?\d{2}[\s-]?\d{2}\b",
    "phone_en": r"(?U)\b(?:\+?1|\+?44)?[-.\s]?(?:\(\d{3}\)|\d{3})[-.\s]?\d{3}[-.\s]?\d{4}\b",
    "phone_de": r"(?U)\b(?:\+?49)?[\s-]?(?:\(0\))?(?:1\d{2}|[2-9]\d{1,3})[\s-]?\d{3,8}\b",
    "phone_fr": r"(?U)\b(?:\+?33|0)[\s.-]?[1-9](?:[\s.-]?\d{2}){4}\b",
    "phone_es": r"(?U)\b(?:\+?34)?\s?(?:[67]\d{2}|9\d{2})\s?\d{3}\s?\d{3}\b",
    "phone_it": r"(?U)\b(?:\+?39)?\s?3\d{2}\s?\d{3}\s?\d{4}\b",
    "phone_pt": r"(?U)\b(?:\+?351)?\s?9\d{2}\s?\d{3}\s?\d{3}\b",
    "phone_hi": r"(?U)\b(?:\+?91)?\s?[6-9]\d{4}\s?\d{5}\b",
    "phone_zh": r"(?U)\b(?:\+?86)?\s?1[3-9]\d{9}\b",
    "phone_ru": r"(?U)\b(?:\+?7|8)\s?\d{3}\s?\d{3}\s?\d{2}\s?\d{2}\b",
    "phone": r"(?U)\b(?:\+?\d{1,3}[\s\-.]?)?(?:\(?\d{2,4}\)?[\s\-.]?){2,3}\d{2,4}\b",
}
IBANS = {"iban_tr": (r"(?iU)\bTR\d{2}(?:\s*\d{4}){5}\s*\d{2}\b", 26), "iban_de": (r"(?iU)\bDE\d{2}(?:\s*\d{4}){4}\s*\d{2}\b", 22)}
TCKN = r"(?U)\b\d{11}\b"
PAN = r"(?U)(?<!\d)(?:[3456]\d[\s-]?)(?:\d[\s-]?){12,18}(?!\d)"
IPV4 = r"(?U)\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b"
BLOBS = {"large_base64": (r"(?U)(?:[A-Za-z0-9+/]{80}\s*+){10,}+", 800), "large_hex": (r"(?U)(?:[0-9A-Fa-f]{64}\s*+){10,}+", 640)}
URLS = {
    "ip_literal": r"(?iU)\bhttps?://(?:\d{1,3}\.){3}\d{1,3}(?::\d{1,5})?(?:/[^\s]*)?",
    "data_uri": r"(?iU)\bdata:[^,\s]{1,100},[^\s]+",
    "executable_ext": r"(?iU)\b(?:https?|ftp)://[^\s]+?\.(?:exe|msi|bat|cmd|ps1|psm1|js|scr|vbs|jar|zip|tgz|tar\.gz|sh|dll)(?:[?#][^\s]*)?",
    "cred_in_url": r"(?iU)\bhttps?://[^/\s:@]+:[^@\s]+@[^\s]+",
    "shortener": r"(?iU)\bhttps?://[^\s]+",
    "suspicious_tld": r"(?iU)\bhttps?://[^\s]+",
}
URLS["ip"], URLS["data"], URLS["risky_extension"] = URLS["ip_literal"], URLS["data_uri"], URLS["executable_ext"]
SHORTENERS = ["bit.ly", "goo.gl", "tinyurl.com", "t.co", "ow.ly", "is.gd", "cutt.ly", "rb.gy", "rebrand.ly", "buff.ly"]
TLDS = [".zip", ".mov", ".country", ".support", ".top", ".xyz", ".click", ".gq", ".work", ".kim"]
COMMANDS = {
    "curl_pipe": (r"(?iU)\bcurl\s+[^\n|]+?\|\s*(?:sh|bash)\b", "curl"),
    "wget_pipe": (r"(?iU)\bwget\s+[^\n|]+?\|\s*(?:sh|bash)\b", "wget"),
    "powershell_encoded": (r"(?iU)\bpowershell(?:\.exe)?\s+-enc(?:odedcommand)?\s+[A-Za-z0-9+/=]+", "powershell"),
    "invoke_webrequest": (r"(?iU)\binvoke-webrequest\s+[^\n;]+?(?:\|\s*iex|\|\s*invoke-expression)", "invoke-webrequest"),
    "powershell_iwr": (r"(?iU)\b(?:invoke-webrequest|iwr)\s+[^\n]+\|\s*powershell", "powershell"),
    "rm_rf": (r"(?iU)\brm\s+-rf\s+/(?:\S*)", "-rf"),
    "reg_add": (r"(?iU)\breg\s+add\s+[^\n]+", "reg"),
    "certutil": (r"(?iU)\bcertutil\.exe?\s+-urlcache(?:\s+-split)?\s+-f\s+[^\s]+", "certutil"),
    "mshta": (r"(?iU)\bmshta\.exe?\s+[^\s]+", "mshta"),
    "rundll32": (r"(?iU)\brundll32\.exe?\s+[^\s,]+,[^\s]+", "rundll32"),
}
# Secret patterns are our own, within what is known of their results.
SECRETS = {
    "jwt": r"\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+",
    "aws_access_key": r"\bAKIA[0-9A-Z]{16}\b",
    "aws_secret_key": r"(?<![A-Za-z0-9/+])[A-Za-z0-9/+]{40}(?![A-Za-z0-9/+=])",
    "openai_api_key": r"\bsk-(?:(?:live|test)-[A-Za-z0-9]{20,}|[A-Za-z0-9]{32,})",
    "github_token": r"\bgh[pousr]_[A-Za-z0-9]{36,}",
    "slack_token": r"\bxox[abprs]-[A-Za-z0-9-]{10,}",
    "stripe_key": r"\bsk_(?:live|test)_[A-Za-z0-9]{16,}",
    "twilio_key": r"\bSK[0-9a-fA-F]{32}\b",
    "azure_sas": r"\bsv=[^&\s]+&[^\s]*\bsig=[^&\s]+",
    "gcp_service_account": r'"type"\s*:\s*"service_account"',
    "pem_private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----[^-]*+(?:-(?!----END)[^-]*+)*+-----END [A-Z ]*PRIVATE KEY-----",
    "high_entropy": r"[A-Za-z0-9+/_]{32,}+",
}
MIXED = lambda v: v.rlike("[A-Z]") & v.rlike("[a-z]") & v.rlike("[0-9]")
URL_MARK, COMMAND_MARK, SECRET_MARK = "[redacted-url]", "[command-blocked]", "[secret]"
BLOB_MARKS, BLOB_PREVIEW = {"large_base64": "[base64-blob]", "large_hex": "[hex-blob]"}, "[truncated-blob]"
URL_REASONS = {"ip": "ip_url", "ip_literal": "ip_url", "data": "data_url", "data_uri": "data_url", "risky_extension": "executable_ext"}


def _rule(rule: Rule, text: Column) -> tuple[Column, object, object, dict] | None:
    """(spans, check, replacement, more fields) of a rule; None where its kind is unknown."""
    kind = rule.kind or ""
    has = lambda s: F.contains(F.lower(text), F.lit(s))
    if rule.pattern and rule.type in ("url", "cmd"):
        mark = URL_MARK if rule.type == "url" else COMMAND_MARK
        return X.spans(text, f"(?iU){rule.pattern}"), None, lambda v: F.lit(mark), {"reason": F.lit("pattern")}
    if rule.type == "pii":
        digit = text.rlike(r"\p{Nd}")
        if kind == "email":
            return X.spans(text, EMAIL, has("@")), None, X.masked_email, {}
        if kind.startswith("phone"):
            return X.spans(text, PHONES.get(kind, PHONES["phone"]), digit), lambda v: F.length(X.digits(v)).between(9, 15), lambda v: F.concat(F.lit("***"), F.substring(X.digits(v), -2, 2)), {"pattern": F.lit(kind)}
        if kind in IBANS:
            pattern, n = IBANS[kind]
            flat = lambda v: F.regexp_replace(v, r"(?U)\s", "")
            return X.spans(text, pattern, digit), lambda v: F.length(flat(v)) == n, lambda v: F.concat(F.lit(kind[-2:].upper() + "*" * 16), F.substring(flat(v), -4, 4)), {}
        if kind == "tckn":
            return X.spans(text, TCKN, digit), X.is_tckn, lambda v: F.concat(F.lit("*" * 8), F.substring(v, -3, 3)), {}
        if kind == "pan":
            return X.spans(text, PAN, digit), lambda v: F.length(X.digits(v)).between(13, 19) & X.luhn(X.digits(v)), lambda v: F.concat(F.lit("**** **** **** "), F.substring(X.digits(v), -4, 4)), {}
        if kind == "ipv4":
            return X.spans(text, IPV4, digit), None, lambda v: F.lit("[ip-redacted]"), {"preview": lambda v: v}
    if rule.type == "exfil" and kind in BLOBS:
        pattern, least = BLOBS[kind]
        flat = lambda v: F.regexp_replace(v, r"(?U)\s", "")
        check = (lambda v: (F.length(flat(v)) >= least) & (X.entropy(flat(v)) >= 4.5)) if kind == "large_base64" else (lambda v: F.length(flat(v)) >= least)
        return X.spans(text, pattern, F.length(text) >= least), check, lambda v: F.lit(BLOB_MARKS[kind]), {"length": lambda v: F.length(flat(v)), "preview": lambda v: F.lit(BLOB_PREVIEW)}
    if rule.type == "secret" and kind in SECRETS:
        check = {"jwt": X.is_jwt, "aws_secret_key": lambda v: MIXED(v) & (X.entropy(v) >= 4.5), "high_entropy": lambda v: MIXED(v) & (X.entropy(v) >= 3.5)}.get(kind)
        mark = "[pem-private-key]" if kind == "pem_private_key" else SECRET_MARK
        gates = {"jwt": "eyJ", "aws_access_key": "AKIA", "openai_api_key": "sk-", "github_token": "_", "slack_token": "xox", "stripe_key": "sk_", "twilio_key": "SK", "azure_sas": "sv=", "gcp_service_account": "service_account", "pem_private_key": "PRIVATE KEY-----"}
        got = X.spans(text, SECRETS[kind], F.contains(text, F.lit(gates[kind])) if kind in gates else text.rlike("[0-9]"))
        if kind == "high_entropy":  # the first of equal values
            got = F.aggregate(got, F.array().cast(X.SPAN), lambda a, x: F.when(F.exists(a, lambda y: y["value"] == x["value"]), a).otherwise(F.concat(a, F.array(x))))
        return got, check, lambda v: F.lit(mark), {}
    if rule.type == "url" and kind in URLS:
        check = {"shortener": lambda v: X.hostname(v).isin(SHORTENERS), "suspicious_tld": lambda v: X.hostname(v).rlike("(?:" + "|".join(t.replace(".", "\\.") for t in TLDS) + ")$")}
        valid = lambda v: ~F.exists(F.split(X.hostname(v), r"\."), lambda o: (o.cast("int") > 255) | o.rlike("^0[0-9]"))
        gate = has("data:") if kind.startswith("data") else has("://")
        return X.spans(text, URLS[kind], gate), check.get(kind, valid if kind.startswith("ip") else None), lambda v: F.lit(URL_MARK), {"reason": F.lit(URL_REASONS.get(kind, kind)), "preview": lambda v: X.preview(v, 48)}
    if rule.type == "cmd" and kind in COMMANDS:
        pattern, word = COMMANDS[kind]
        return X.spans(text, pattern, has(word)), None, lambda v: F.lit(COMMAND_MARK), {"reason": F.lit(kind), "preview": lambda v: X.preview(v, 60)}
    return None


def allowed(rule: Rule, entries: tuple[Allow, ...], value: Column, tenant: Column) -> Column:
    out = F.lit(False)
    for a in entries:
        if (a.types and rule.type not in a.types) or (a.kinds and rule.kind not in a.kinds) or (a.rule_ids and rule.id not in a.rule_ids):
            continue
        hit = F.lit(False)
        if a.value is not None:
            hit = hit | (value == a.value)
        if a.regex is not None:
            hit = hit | value.rlike(f"(?iu){a.regex}")
        if a.tenants:
            hit = hit & F.coalesce(tenant.isin(*a.tenants), F.lit(False))
        out = out | hit
    return out


def rule_findings(rule: Rule, ord: int, policy: Policy, text: Column, tenant: Column) -> Column:
    got = _rule(rule, text)
    if got is None:
        return F.array().cast(FINDING)
    spans, check, replace, more = got
    if check is not None:
        spans = F.filter(spans, lambda s: F.coalesce(check(s["value"]), F.lit(False)))
    if policy.allow:
        spans = F.filter(spans, lambda s: ~allowed(rule, policy.allow, s["value"], tenant))
    # of equal ids the last one's settings count, as in a lookup by id
    said = next(r for r in reversed(policy.rules) if r.id == rule.id)

    def finding(s: Column) -> Column:
        v = s["value"]
        field = lambda k, kind: (more[k](v) if callable(more.get(k)) and not isinstance(more[k], Column) else more.get(k, F.lit(None))).cast(kind)
        text_of = replace(v)
        shown = field("preview", "string") if "preview" in more else text_of
        return F.struct(
            F.lit(FAMILIES.index(rule.type)).alias("family"), F.lit(ord).alias("ord"), F.lit(rule.id).alias("rule_id"), F.lit(rule.action).alias("action"), F.lit(rule.type).alias("type"), F.lit(rule.kind).cast("string").alias("kind"),
            s["start"].alias("start"), s["end"].alias("end"), v.alias("value"), F.concat(F.lit("sha256:"), F.sha2(v, 256)).alias("snippet_hash"), text_of.alias("replacement"), shown.alias("preview"),
            field("pattern", "string").alias("pattern"), field("reason", "string").alias("reason"), field("length", "int").alias("length"), F.lit(said.weight).alias("weight"), F.lit(said.severity).alias("severity"), F.lit(said.message).cast("string").alias("safe_message"),
        )

    return F.transform(spans, finding)


def detected(df: DataFrame, policy: Policy, text: Column, tenant: Column, families: tuple[str, ...] = FAMILIES, name: str = "findings", early_stop: bool = True) -> DataFrame:
    """Add all findings in (family, rule, place) order, a family at a time.

    With ``early_stop`` a family after one that blocks isn't evaluated for that row.
    """
    none = F.array().cast(FINDING)
    df = df.withColumn(name, none)
    for f in families:
        parts = [rule_findings(r, i, policy, text, tenant) for i, r in policy.family(f)]
        if parts:
            more = F.concat(F.col(name), *parts)
            over = F.exists(name, lambda x: x["action"] == "block")
            df = df.withColumn(name, X.pinned(F.when(over, F.col(name)).otherwise(more) if early_stop else more))
    return df
