"""Policies as data: rules, allowlist, context settings, safe messages, and their loaders."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field

FAMILIES = ("pii", "exfil", "secret", "url", "cmd")


@dataclass(frozen=True)
class Rule:
    id: str
    type: str
    kind: str | None
    action: str
    severity: str = "medium"
    weight: int = 10
    message: str | None = None
    pattern: str | None = None


@dataclass(frozen=True)
class Allow:
    """An exact value or a pattern to search for; empty scopes fit anything."""

    value: str | None = None
    regex: str | None = None
    types: tuple[str, ...] = ()
    kinds: tuple[str, ...] = ()
    rule_ids: tuple[str, ...] = ()
    tenants: tuple[str, ...] = ()


@dataclass(frozen=True)
class Context:
    enabled: bool = True
    code_block_penalty: int = 15
    explain_only_penalty: int = 25
    link_context_bonus: int = 5


@dataclass(frozen=True)
class Policy:
    id: str = "default"
    rules: tuple[Rule, ...] = ()
    allow: tuple[Allow, ...] = ()
    context: Context = field(default_factory=Context)

    def family(self, name: str) -> list[tuple[int, Rule]]:
        return [(i, r) for i, r in enumerate(self.rules) if r.type == name]


# Rule ids, kinds, actions, severities, weights and message keys of the default policy.
_DEFAULT = """
PII-EMAIL pii email mask medium 15 masked
PII-PHONE-TR pii phone_tr mask medium 12 masked
PII-PHONE-EN pii phone_en mask medium 12 masked
PII-PHONE-DE pii phone_de mask medium 12 masked
PII-PHONE-FR pii phone_fr mask medium 12 masked
PII-PHONE-ES pii phone_es mask medium 12 masked
PII-PHONE-IT pii phone_it mask medium 12 masked
PII-PHONE-PT pii phone_pt mask medium 12 masked
PII-PHONE-HI pii phone_hi mask medium 12 masked
PII-PHONE-ZH pii phone_zh mask medium 12 masked
PII-PHONE-RU pii phone_ru mask medium 12 masked
PII-IBAN-TR pii iban_tr mask high 30 masked
PII-IBAN-DE pii iban_de mask high 30 masked
PII-TCKN pii tckn mask high 35 masked
PII-PAN pii pan block critical 45 blocked
PII-IPV4 pii ipv4 mask medium 10 masked
SECRET-JWT secret jwt block high 40 blocked
SECRET-AWS-AK secret aws_access_key block critical 45 blocked
SECRET-AWS-SK secret aws_secret_key block critical 45 blocked
SECRET-OPENAI secret openai_api_key block high 40 blocked
SECRET-GITHUB secret github_token block high 35 blocked
SECRET-SLACK secret slack_token block high 35 blocked
SECRET-STRIPE secret stripe_key block high 35 blocked
SECRET-TWILIO secret twilio_key block high 35 blocked
SECRET-AZURE-SAS secret azure_sas block high 35 blocked
SECRET-GCP-SA secret gcp_service_account block critical 50 blocked
SECRET-PEM secret pem_private_key block critical 60 blocked
SECRET-HIGH-ENTROPY secret high_entropy block high 30 blocked
URL-DATA-URI url data_uri block high 35 blocked
URL-EXECUTABLE url executable_ext delink high 25 masked
URL-IP-LITERAL url ip_literal delink medium 20 masked
URL-CREDENTIALS url cred_in_url block high 30 blocked
URL-SHORTENER url shortener delink medium 15 masked
URL-SUSPICIOUS-TLD url suspicious_tld delink medium 18 masked
CMD-CURL-BASH cmd curl_pipe block high 40 blocked
CMD-WGET-BASH cmd wget_pipe block high 40 blocked
CMD-POWERSHELL-ENC cmd powershell_encoded block high 35 blocked
CMD-POWERSHELL-IWR cmd powershell_iwr block high 35 blocked
CMD-RM-RF cmd rm_rf block critical 50 blocked
CMD-REG-ADD cmd reg_add block medium 25 blocked
CMD-CERTUTIL cmd certutil block high 35 blocked
CMD-MSHTA cmd mshta block high 35 blocked
CMD-RUNDLL32 cmd rundll32 block high 35 blocked
EXFIL-LARGE-B64 exfil large_base64 block high 40 blocked
EXFIL-LARGE-HEX exfil large_hex block medium 30 blocked
"""

DEFAULT = Policy(
    rules=tuple(Rule(i, t, k, a, s, int(w), m) for i, t, k, a, s, w, m in (x.split() for x in _DEFAULT.strip().splitlines())),
    allow=(
        Allow(value="https://status.example.com", types=("url",)),
        Allow(value="support@company.com", types=("pii",)),
        Allow(regex=r"public@company\.com", types=("pii",)),
        Allow(value="curl https://docs.company.com/install.sh | bash", types=("cmd",), tenants=("internal-lab",)),
    ),
)

# The texts shown for a blocked response.
MESSAGES = {
    "blocked": "Response blocked: The assistant response was blocked due to sensitive content.",
    "masked": "Content masked: Sensitive details were masked to protect user data.",
    "delinked": "Dangerous link removed: Potentially risky links were replaced to keep recipients safe.",
    "exfil_blocked": "Transfer blocked: Large encoded payloads were blocked to prevent data exfiltration.",
}


def _allow(entry, regex: bool, tenants: tuple[str, ...] = ()) -> Allow:
    if isinstance(entry, str):
        entry = {"regex" if regex else "value": entry}
    scope = lambda k: tuple(entry.get(k) or ())
    return Allow(entry.get("value"), entry.get("regex"), scope("types"), scope("kinds"), scope("rule_ids"), tenants or scope("tenants"))


def from_mapping(data: dict, id: str = "default") -> Policy:
    """A policy from parsed YAML or JSON."""
    if not data:
        raise ValueError("empty policy")
    rules = tuple(Rule(r["id"], r["type"], r.get("kind"), r["action"], r.get("severity", "medium"), int(r.get("risk_weight", r.get("weight", 10))), r.get("safe_message"), r.get("pattern")) for r in data.get("rules", ()))
    allow = [_allow(e, False) for e in data.get("allowlist", ())] + [_allow(e, True) for e in data.get("allowlist_regex", ())]
    for tenant, entries in (data.get("tenant_allowlist") or {}).items():
        allow += [_allow(e, isinstance(e, dict) and "regex" in e, (tenant,)) for e in entries]
    c = data.get("context_settings") or {}
    return Policy(id, rules, tuple(allow), Context(**{k: c[k] for k in Context.__dataclass_fields__ if k in c}))


def _parsed(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        raw = f.read()
    if path.endswith(".json"):
        return json.loads(raw) or {}
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("YAML files need PyYAML; JSON ones don't") from e
    return yaml.safe_load(raw) or {}


def load(path: str) -> dict[str, Policy]:
    """Policies of a YAML (where PyYAML is installed) or JSON file, by id; one or a ``policies:`` map."""
    data = _parsed(path)
    if not data:
        raise ValueError(f"empty policy file {path}")
    if "policies" in data:
        return {k: from_mapping(v, k) for k, v in data["policies"].items()}
    name = data.get("policy_id", "default")
    return {name: from_mapping(data, name)}


def select(policies: dict[str, Policy], id: str | None) -> Policy:
    """The policy of that id, else the default, else the first."""
    return policies.get(id or "") or policies.get("default") or next(iter(policies.values()))


_LOADED: dict[str, tuple[int, dict[str, Policy]]] = {}


def current(path: str) -> dict[str, Policy]:
    """``load``, again only where the file changed: call it for each job or micro-batch."""
    stamp = os.stat(path).st_mtime_ns
    if path not in _LOADED or _LOADED[path][0] != stamp:
        _LOADED[path] = (stamp, load(path))
    return _LOADED[path][1]


def forget(path: str | None = None) -> None:
    """Drop what ``current`` holds of one file, or of all."""
    if path is None:
        _LOADED.clear()
    else:
        _LOADED.pop(path, None)


def load_messages(path: str) -> dict[str, str]:
    """Key -> text shown, from a file's ``safe_messages`` map of title and description; empty where the file is missing."""
    if not os.path.exists(path):
        return {}
    entries = _parsed(path).get("safe_messages")
    out = {}
    for key, entry in entries.items() if isinstance(entries, dict) else ():
        if isinstance(entry, dict):
            said = [entry[k] for k in ("title", "description") if entry.get(k)]
            out[str(key)] = ": ".join(said) if said else "Response blocked due to policy violation."
    return out
