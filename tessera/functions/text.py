"""Functions that need Python's Unicode tables or JSON, in Arrow batches."""

from __future__ import annotations

import json
import re
import unicodedata
from urllib.parse import parse_qs, urlencode

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.normalise import DROP_FIELDS


@F.pandas_udf(T.StringType())
def search_text(values: pd.Series) -> pd.Series:
    """NFKC, case folding and single spaces: the form in which titles and aliases are compared."""
    return values.map(lambda v: None if v is None else " ".join(unicodedata.normalize("NFKC", v).casefold().split()))


def redact_json(column: Column, drop: tuple[str, ...] = DROP_FIELDS) -> Column:
    """JSON text without the fields, at any depth, whose name matches; canonical order; null if it is no JSON."""
    pattern = re.compile("|".join(drop), re.IGNORECASE)

    def clean(value):
        if isinstance(value, dict):
            return {k: clean(v) for k, v in value.items() if not pattern.search(k)}
        return [clean(v) for v in value] if isinstance(value, list) else value

    @F.pandas_udf(T.StringType())
    def redact(values: pd.Series) -> pd.Series:
        def one(text):
            try:
                return json.dumps(clean(json.loads(text)), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
            except (TypeError, ValueError):
                return None

        return values.map(one)

    return redact(column)


#: Most bytes and fields of a request body that is kept. Fixed values of the policy.
MOST_BYTES, MOST_FIELDS = 1 << 20, 1000


def sanitised_body(body: Column, content_type: Column, drop: tuple[str, ...] = DROP_FIELDS) -> Column:
    """A request body without the fields that match, in canonical form: a JSON object, a list of objects, or a form.

    Null for another type, a body that can't be read, is too large, or whose fields have no names.
    """
    pattern = re.compile("|".join(drop), re.IGNORECASE)

    def clean(value):
        if isinstance(value, dict):
            return {k: clean(v) for k, v in value.items() if not pattern.search(k)}
        return [clean(v) for v in value] if isinstance(value, list) else value

    def one(text, kind):
        if text is None or len(text.encode()) > MOST_BYTES:
            return None
        try:
            if kind == "application/json":
                value = json.loads(text)
                named = isinstance(value, dict) or isinstance(value, list) and all(isinstance(x, dict) for x in value)
                return json.dumps(clean(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False) if named else None
            if kind == "application/x-www-form-urlencoded":
                fields = parse_qs(text, keep_blank_values=True, max_num_fields=MOST_FIELDS)
                return urlencode({k: v for k, v in fields.items() if not pattern.search(k)}, doseq=True)
        except ValueError:
            pass
        return None

    @F.pandas_udf(T.StringType())
    def sanitise(texts: pd.Series, kinds: pd.Series) -> pd.Series:
        return pd.Series([one(t, k) for t, k in zip(texts, kinds)], dtype=object)

    return sanitise(body, content_type)


@F.pandas_udf(T.BooleanType())
def is_json(texts: pd.Series) -> pd.Series:
    """Whether a text is one JSON value and nothing else; false for null."""

    def one(text):
        try:
            json.loads(text)
        except (TypeError, ValueError):
            return False
        return True

    return texts.map(one).astype(bool)
