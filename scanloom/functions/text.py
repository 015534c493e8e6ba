"""File names, timestamps in names, content ids, redaction."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Keys masked by default.
SECRET_KEYS = ("token", "access_token", "refresh_token", "api_key", "secret", "password", "authorization")


def parse_name(name: Column) -> dict[str, Column]:
    parts = F.split(name, "_")
    full = F.size(parts) >= 3
    number = F.when(F.get(parts, F.lit(2)).rlike(r"^\+?[0-9]+$"), F.get(parts, F.lit(2)).try_cast("int"))
    return {
        "rotation": F.when(full, F.coalesce(number, F.lit(0)) * 10.0).otherwise(F.lit(0.0)),
        "vantage": F.when(full, F.get(parts, F.lit(1))).otherwise(F.lit("mid")),
        "subject": F.when(full, F.get(parts, F.lit(0))).otherwise(name),
    }


def camera_index(name: Column) -> Column:
    def marked(n):
        return name.contains(f"CAM{n}") | name.contains(f"cam{n}") | name.contains(f"_{n}_")

    return F.when(marked(2), F.lit(1)).when(marked(3), F.lit(2)).otherwise(F.lit(0))


def exif_time(raw: Column) -> Column:
    """Timestamps such as ``2024:01:02 03:04:05``, null when not valid."""
    flat = F.regexp_replace(F.regexp_replace(raw, "T", " "), ":", "-")
    return F.try_to_timestamp(F.when(flat.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}-\d{2}-\d{2}$"), flat), F.lit("yyyy-MM-dd HH-mm-ss"))


def compact_time(name: Column) -> Column:
    """First valid 14-digit window among the digits of a name."""
    digits = F.regexp_replace(name, "[^0-9]", "")
    starts = F.when(F.length(digits) >= 14, F.sequence(F.lit(1), F.length(digits) - 13)).otherwise(F.array().cast("array<int>"))
    stamps = F.transform(starts, lambda i: F.try_to_timestamp(F.substr(digits, i, F.lit(14)), F.lit("yyyyMMddHHmmss")))
    return F.get(F.filter(stamps, lambda s: s.isNotNull()), F.lit(0))


def stable_id(domain: str, *parts: Column) -> Column:
    """SHA-256 over a domain tag and the parts, separated by zero bytes."""
    return F.sha2(F.concat_ws("\x00", F.lit(domain), *parts), 256)


def _mask(value, keys):
    if isinstance(value, dict):
        return {k: "[redacted]" if k.lower() in keys else _mask(v, keys) for k, v in value.items()}
    if isinstance(value, list):
        return [_mask(v, keys) for v in value]
    return value


def redact_json(extra_keys: tuple[str, ...] = ()):
    """Arrow UDF masking listed keys at any depth (column functions cannot recurse)."""
    keys = frozenset(k.lower() for k in (*SECRET_KEYS, *extra_keys))

    @F.pandas_udf("string")
    def redact(raw: pd.Series) -> pd.Series:
        return raw.map(lambda s: json.dumps(_mask(json.loads(s), keys), separators=(",", ":"), ensure_ascii=False),
                       na_action="ignore")

    return redact
