"""Code-list phenotyping: flags, labels and drug lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from claimweave.functions.clean import any_code_match, code_match, flag, member, overwrite


def flag_codes(df: DataFrame, spec: Mapping[str, tuple[str, Sequence[str]]]) -> DataFrame:
    """Add 0/1 flags from ``{flag: (regex, code columns)}``."""
    return df.withColumns({name: flag(any_code_match(cols, pattern)) for name, (pattern, cols) in spec.items()})


def flag_orders(df: DataFrame, column: str, spec: Mapping[str, Sequence[str]]) -> DataFrame:
    """Add 0/1 flags from ``{flag: order codes}``."""
    return df.withColumns({name: flag(member(column, codes)) for name, codes in spec.items()})


def code_list(
    df: DataFrame, code: str, cls: str, include: str, flags: Mapping[str, str] | None = None
) -> DataFrame:
    """Distinct (code, class) rows of the wanted classes, with 0/1 subclass flags."""
    wanted = df.filter(code_match(cls, include)).select(code, cls).distinct()
    return wanted.withColumns({name: flag(code_match(cls, pattern)) for name, pattern in (flags or {}).items()})


def label_of(column: str, labels: Sequence[tuple[str, str]], prefix: str = "") -> Column:
    """Disease label of a code; the last matching pattern wins, no match is null."""
    rules = [(code_match(column, pattern), prefix + name) for name, pattern in labels]
    return overwrite(F.lit(None).cast("string"), *rules)


def label_codes(
    df: DataFrame, column: str, labels: Sequence[tuple[str, str]], prefix: str = "", name: str = "dx"
) -> DataFrame:
    """Label each code and drop rows whose code belongs to no listed disease."""
    return df.withColumn(name, label_of(column, labels, prefix)).filter(F.col(name).isNotNull())
