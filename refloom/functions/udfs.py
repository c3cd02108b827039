"""String kernels as Arrow UDFs."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from refloom.functions import cleanup, compare, jsontext, parsing, strings, text


def _each(function: Callable, kind: str) -> Callable[..., Column]:
    """A UDF of one or several columns; null in any of them gives null."""

    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([None if any(v is None for v in row) else function(*row) for row in zip(*columns, strict=True)], dtype=object)

    def one(a: pd.Series) -> pd.Series:
        return run(a)

    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return run(a, b)

    def apply(*columns: Column) -> Column:
        return F.pandas_udf(one if len(columns) == 1 else two, kind)(*columns)

    return apply


fold = _each(strings.fold, "string")


def exact_fold(column: Column) -> Column:
    """As `text.fold` where that is exact; texts with other characters go through Arrow."""
    wide = text.is_wide(column)
    return F.when(wide, fold(F.when(wide, column))).otherwise(text.fold(column))


def exact_surname_keys(names: Column) -> Column:
    """The last folded word of each name of an array."""
    wide = F.exists(names, text.is_wide)
    return F.when(wide, compare.surname_keys(F.when(wide, names))).otherwise(F.transform(names, text.surname_key))


sanitized_json = _each(lambda body: json.dumps(jsontext.sanitized(json.loads(body)), ensure_ascii=False, separators=(",", ":")), "string")
canonical_words = _each(strings.canonical_words, "array<string>")
clean_text = _each(cleanup.clean_text, "string")
decode_text = _each(lambda b: cleanup.decode_text(bytes(b)), "string")
indel_ratio = _each(strings.ratio, "double")
token_sort_ratio = _each(strings.token_sort_ratio, "double")
lcs_length = _each(strings.lcs, "int")


def _parse_authors(segment: pd.Series) -> pd.DataFrame:
    found = [parsing.parse_authors(s or "") for s in segment]
    return pd.DataFrame({"authors": [[n._asdict() for n in f.names] for f in found], "et_al": [f.et_al for f in found], "confidence": [f.confidence for f in found]})


def parse_authors(segment: Column) -> Column:
    return F.pandas_udf(_parse_authors, "struct<authors:array<struct<surname:string,given:string>>,et_al:boolean,confidence:double>")(segment)
