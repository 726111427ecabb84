"""Content that is written differently but means the same gets the same text."""

from __future__ import annotations

import json
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, functions as F, types as T


def _number(text: str):
    d = Decimal(text)
    if not d:
        return 0
    if -40 < d.adjusted() < 40 and d == d.to_integral_value():
        return int(d)
    return d


def _refuse(text: str):
    raise ValueError(text)


_DECODER = json.JSONDecoder(parse_int=_number, parse_float=_number, parse_constant=_refuse)
_ENCODER = json.JSONEncoder(sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=lambda d: {"\0number": str(d.normalize())})


def canonical_json_text(text: str | None) -> str | None:
    """One spelling for each JSON value.

    Key order, blanks, escapes and the way a number is written don't count (``3.70``, ``37e-1``); a
    missing key isn't a null one; of a repeated key the last counts. Text that isn't JSON stands for itself, marked so that it equals no JSON value.
    """
    if text is None:
        return None
    try:
        return "j" + _ENCODER.encode(_DECODER.decode(text))
    except (ValueError, ArithmeticError, RecursionError):
        return "t" + text


@F.pandas_udf(T.StringType())
def _canonical_json(s: pd.Series) -> pd.Series:
    # each distinct text of a batch is parsed once
    codes, texts = pd.factorize(s)
    done = pd.Series([canonical_json_text(x) for x in texts] + [None], dtype=object)
    return done.iloc[codes].reset_index(drop=True)  # the code of null is -1, the last


def canonical_json(c: Column) -> Column:
    return _canonical_json(c)


def numbers_text(c: Column) -> Column:
    """An array of numbers as text, equal for equal values: -0.0 is 0.0, nulls stay visible."""
    return F.transform(c, lambda x: x + F.lit(0.0).cast("float")).cast("string")


def content_hash(*texts: Column) -> Column:
    """128 bits of several texts of which each may be null; null differs from every text."""
    return F.md5(F.concat_ws("\u0001", *(F.coalesce(F.concat(F.lit("v"), t), F.lit("n")) for t in texts)))
