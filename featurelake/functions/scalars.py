"""Column expressions shared by the operators. All stay inside whole-stage codegen."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, TimestampNTZType

# Texts that count as a positive outcome, and as a true switch.
POSITIVE_OUTCOMES = ["sim", "yes", "1", "true"]
TRUTHY_SWITCHES = ["1", "true", "yes", "y", "on"]

# Tag aliases and their canonical form.
TAG_ALIASES = {"indice": "index", "indices": "index", "index": "index"}


def literal(value, kind: DataType) -> Column:
    """Literal for a value read from a column of that type; a zone-less time stays zone-less."""
    if isinstance(kind, TimestampNTZType) and isinstance(value, datetime):
        return F.lit(value.isoformat(sep=" ")).cast(kind)
    return F.lit(value).cast(kind)


def to_number(c: Column) -> Column:
    """Numeric coercion: text that is no number, and NaN, become null."""
    value = c.try_cast("double")
    return F.when(~F.isnan(value), value)


def is_member(c: Column, accepted: Sequence[str]) -> Column:
    """Trimmed, case-folded membership; null is never a member."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin(list(accepted)), F.lit(False))


def positive_flag(c: Column, accepted: Sequence[str] = POSITIVE_OUTCOMES) -> Column:
    return is_member(c, accepted).cast("int")


def truthy(c: Column, default: bool = False) -> Column:
    """Switch text: null keeps the default."""
    return F.when(c.isNull(), F.lit(default)).otherwise(is_member(c, TRUTHY_SWITCHES))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den, null when the denominator is zero or null."""
    return num / F.nullif(den.cast("double"), F.lit(0.0))


def ratio_or_zero(num: Column, den: Column) -> Column:
    return F.coalesce(safe_ratio(num, den), F.lit(0.0))


def _ascii_letters() -> tuple[str, str, dict[str, str]]:
    """Translation of all characters whose Unicode decomposition has ASCII in it, derived from that."""
    single_from, single_to, several = [], [], {}
    for code in range(0x80, sys.maxunicode + 1):
        plain = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            single_from.append(chr(code))
            single_to.append(plain)
        elif len(plain) > 1:
            several[chr(code)] = plain
    return "".join(single_from), "".join(single_to), several


_FROM, _TO, _SEVERAL = _ascii_letters()


def normalize_tag(c: Column) -> Column:
    """Accent- and case-insensitive form of a tag: plain letters only, trimmed, lower case."""
    text = F.coalesce(c, F.lit(""))
    table = F.create_map(*[F.lit(x) for pair in _SEVERAL.items() for x in pair])
    longer = F.array_join(F.transform(F.split(text, ""), lambda x: F.coalesce(F.try_element_at(table, x), x)), "")
    # Characters that become several are rare, so only texts beyond ASCII are looked at one by one.
    plain = F.translate(F.when(F.rlike(text, F.lit(r"[^\x00-\x7F]")), longer).otherwise(text), _FROM, _TO)
    return F.lower(F.trim(F.regexp_replace(plain, r"[^\x00-\x7F]", "")))


def canonical_tag(c: Column, aliases: Mapping[str, str] = TAG_ALIASES) -> Column:
    plain = normalize_tag(c)
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.coalesce(F.try_element_at(table, plain), plain)


def metric_name(c: Column, prefix: str) -> Column:
    """Legal metric name below a common prefix; an empty name gets a generic one."""
    body = F.regexp_replace(F.trim(c), "[^a-zA-Z0-9_:]", "_")
    body = F.when(body == "", F.lit(f"{prefix}job_metric")).otherwise(body)
    return F.when(F.startswith(body, F.lit(prefix)), body).otherwise(F.concat(F.lit(prefix), body))


def feature_metric_name(c: Column) -> Column:
    """Blank to underscore, parentheses dropped."""
    return F.translate(c, " ()", "_")


def truncate_text(c: Column, length: int = 500) -> Column:
    return F.left(c, F.lit(length))


def parse_id_list(c: Column) -> Column:
    """Comma-separated ids: struct of the parsed ids and whether every item was a number."""
    ids = F.transform(F.split(c, ","), lambda x: F.trim(x).try_cast("bigint"))
    return F.struct(ids.alias("ids"), (~F.exists(ids, lambda x: x.isNull())).alias("valid"))


def parse_json_body(c: Column) -> Column:
    """Body that starts with a brace and parses as JSON, as a variant; otherwise null."""
    return F.when(c.rlike(r"^\{"), F.try_parse_json(c))


def json_text(c: Column, path: str) -> Column:
    return F.get_json_object(c, f"$.{path}")


def log_defaults(fields: Mapping[str, Column], service: str, environment: str) -> dict[str, Column]:
    """Complete a log record: every standard field present, falling back to the next best one.

    ``fields`` holds the columns the record has; absent ones count as null.
    """
    def have(name: str) -> Column:
        return fields.get(name, F.lit(None).cast("string"))

    def filled(name: str) -> Column:
        return F.nullif(have(name), F.lit(""))

    event = F.coalesce(F.nullif(F.trim(have("event")), F.lit("")), F.lit("log"))
    return {
        "event": event,
        "message": F.coalesce(have("message"), event),
        "service": F.coalesce(have("service"), F.lit(service)),
        "environment": F.coalesce(have("environment"), F.lit(environment)),
        "component": F.coalesce(filled("component"), filled("logger"), filled("module"), F.lit("application")),
        "trace_id": have("trace_id"),
        "run_id": have("run_id"),
        "model_version": have("model_version"),
    }
