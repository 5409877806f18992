"""Byte-exact canonical JSON, which no built-in writes: sorted keys, compact, ASCII."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, functions as F, types as T


@F.pandas_udf(T.StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    """The canonical form of each JSON text; null for null, invalid JSON, duplicate keys or non-finite numbers."""

    def reject(_: str):
        raise ValueError

    def unique(pairs):
        out = dict(pairs)
        if len(out) != len(pairs):
            raise ValueError
        return out

    def one(text):
        if text is None:
            return None
        try:
            value = json.loads(text, object_pairs_hook=unique, parse_constant=reject)
            return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True, allow_nan=False)
        except ValueError:
            return None

    return texts.map(one)


def manifest_hash(text: Column) -> Column:
    """SHA-256 of the canonical form."""
    return F.sha2(canonical_json(text), 256)
