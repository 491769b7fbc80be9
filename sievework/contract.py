"""The contract of a table: a rule a column, policies, and how severe each check is at each stage. Driver-side only."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import SparkSession

PRE, POST = "pre-clean", "post-clean"
#: Checks that cleaning is there to mend: before it they only measure.
MENDED_BY_CLEANING = frozenset("type_invalid format_invalid category_invalid length_invalid alphabetic_invalid duplicate_row".split())
CUSTOMERS = Path(__file__).parent / "contracts" / "customers.yaml"


class InputError(Exception):
    """The input or its contract is at fault; trying again won't help."""


@dataclass(frozen=True)
class ColumnRule:
    name: str
    type: str = "string"
    required: bool = False
    unique: bool = False
    min: float | None = None
    max: float | None = None
    min_length: int | None = None
    max_length: int | None = None
    alphabetic: bool = False
    format: str | None = None
    date_format: str = "%Y-%m-%d"
    min_age_years: float | None = None
    max_age_years: float | None = None
    allowed: tuple[str, ...] = ()
    pii: str = "none"
    on_fail: str | None = None


@dataclass(frozen=True)
class Contract:
    columns: tuple[ColumnRule, ...]
    expected: tuple[str, ...]
    null_tokens: tuple[str, ...] = ("",)
    severity: dict[str, str] = field(default_factory=dict)
    max_quarantine_pct: float = 100.0
    missing: dict[str, str] = field(default_factory=dict)
    date_policy: str = "day_first"
    synonyms: dict[str, dict[str, str]] = field(default_factory=dict)
    masking: dict[str, dict] = field(default_factory=dict)
    salt_env: str = "PII_PSEUDONYM_SALT"
    drop_on_export: tuple[str, ...] = ()
    birth: str = "date_of_birth"
    created: str = "created_date"
    address: str = "address"
    quasi: tuple[str, ...] = ("date_of_birth", "income", "account_status")
    person: tuple[str, str, str] = ("first_name", "last_name", "date_of_birth")
    contact: tuple[str, str, str] = ("account_status", "email", "phone")

    def rule(self, name: str) -> ColumnRule | None:
        return next((r for r in self.columns if r.name == name), None)

    @property
    def key(self) -> str | None:
        return next((r.name for r in self.columns if r.unique), None)

    def severity_of(self, check: str, stage: str, column: str | None = None) -> str:
        if stage == PRE and check in MENDED_BY_CLEANING:
            return "warn"
        rule = self.rule(column) if column else None
        return rule.on_fail if rule and rule.on_fail else self.severity.get(check, "warn")


def parse(raw: dict) -> Contract:
    """From a dict: policies may stand with the column or, under missing_strategy, masking and category_synonyms, apart."""
    if not isinstance(raw, dict) or not isinstance(raw.get("columns"), dict):
        raise InputError("a contract needs columns")
    missing, masking, synonyms = (dict(raw.get(k) or {}) for k in ("missing_strategy", "masking", "category_synonyms"))
    rules = []
    for name, given in raw["columns"].items():
        given = dict(given or {})
        for target, key in ((missing, "missing"), (masking, "mask"), (synonyms, "synonyms")):
            if key in given:
                target[name] = given.pop(key)
        given["allowed"] = tuple(given.get("allowed") or ())
        rules.append(ColumnRule(name=name, **{k: v for k, v in given.items() if k in ColumnRule.__dataclass_fields__}))
    options = {k: tuple(raw[k]) if isinstance(raw[k], list) else raw[k] for k in ("birth", "created", "address", "quasi", "person", "contact") if k in raw}
    return Contract(
        tuple(rules), tuple(raw.get("expected_columns") or [r.name for r in rules]), tuple(raw.get("null_like_values") or [""]), dict(raw.get("severity") or {}),
        float(raw.get("max_quarantine_rate_pct", 100)), missing, raw.get("ambiguous_date_policy", "day_first"), synonyms, masking,
        raw.get("pseudonym_salt_env", "PII_PSEUDONYM_SALT"), tuple(raw.get("drop_on_export") or ()), **options)


def load_contract(path: str | Path = CUSTOMERS, spark: SparkSession | None = None) -> Contract:
    """A YAML or JSON contract; with a session, from any path that Spark reads."""
    try:
        text = "\n".join(r[0] for r in spark.read.text(str(path), wholetext=True).collect()) if spark else Path(path).read_text(encoding="utf-8")
    except Exception as e:  # not found, not readable, not text
        raise InputError(f"contract can't be read: {path}") from e
    try:
        try:
            import yaml
        except ImportError:
            return parse(json.loads(text))
        return parse(yaml.safe_load(text))
    except InputError:
        raise
    except Exception as e:
        raise InputError(f"contract can't be parsed: {path}") from e
