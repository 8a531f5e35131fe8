"""Markup functions that need a parser, as Arrow-batched UDFs over the kernels.

Texts without markup come back as they are: their rows pass through the Arrow stage
as nulls, as an expression cannot leave rows out, but are neither sent nor parsed.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..kernels import markup


@F.pandas_udf(T.StringType())
def _plain(fragment: pd.Series) -> pd.Series:
    return fragment.map(markup.plain_text, na_action="ignore")


def plain_text(fragment: Column) -> Column:
    """The visible text of a fragment; a malformed one as it is."""
    return F.when(F.regexp_like(fragment, F.lit("[<&\r]")), _plain(F.when(F.regexp_like(fragment, F.lit("[<&\r]")), fragment))).otherwise(fragment)


@F.pandas_udf(T.StringType())
def fragment_error(fragment: pd.Series) -> pd.Series:
    """Why a fragment is malformed, or null."""
    return fragment.map(markup.fragment_error, na_action="ignore")


@F.pandas_udf(T.StructType([T.StructField("plain", T.StringType()), T.StructField("names", T.ArrayType(T.StringType()))]))
def _read(fragment: pd.Series, dialect: pd.Series) -> pd.DataFrame:
    known = {k: markup.read_fragment(*k) for k in {*zip(fragment, dialect, strict=True)} if isinstance(k[0], str)}
    rows = [known.get(k, (None, [])) for k in zip(fragment, dialect, strict=True)]
    return pd.DataFrame({"plain": [p for p, _ in rows], "names": [n for _, n in rows]}, index=fragment.index, dtype=object)


def read_fragment(fragment: Column, dialect: Column) -> Column:
    """Visible text (plain) and all placeholders (names) of a fragment, by one parse; equal texts of a batch are parsed once."""
    may = F.regexp_like(fragment, F.lit("[%{<&\r]"))
    none = F.struct(fragment.alias("plain"), F.array().cast("array<string>").alias("names"))
    return F.when(may, _read(F.when(may, fragment), dialect)).otherwise(none)


def placeholders(fragment: Column, dialect: Column) -> Column:
    """All placeholders of a fragment."""
    return read_fragment(fragment, dialect)["names"]


@F.pandas_udf(T.ArrayType(T.StringType()))
def inline_elements(fragment: pd.Series) -> pd.Series:
    """Inline elements of a fragment, up to its first error."""
    return pd.Series([markup.inline_elements(f) if f is not None and f == f else [] for f in fragment], dtype=object)
