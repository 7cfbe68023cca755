"""Data-quality rules over request tables (Q1-Q4).

Each check returns violation rows instead of raising, so a table of a
billion requests yields its bad rows in one pass. Q1-Q3 are narrow
(row-local expressions; Q1 explodes a small fixed array of candidate
violations); Q4 is one partial aggregate.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.truthy import is_defined, is_truthy

# Violation message formats.
MSG_MISSING = 'Error: Missing option "{missing}" is required by "{label}".'
MSG_ANY = 'Error: "{label}" requires at least one of the following options to be set: {at_least}'


@dataclass(frozen=True)
class Rule:
    """If ``option`` is truthy (and equals ``when_value`` when given), every
    column in ``all_of`` must be truthy and at least one column in
    ``any_of`` must be defined (not NULL; ``''`` counts as defined)."""
    option: str
    all_of: Sequence[str] = field(default_factory=tuple)
    any_of: Sequence[str] = field(default_factory=tuple)
    when_value: object = None


def _trigger(df: DataFrame, rule: Rule) -> Column:
    t = is_truthy(df, rule.option)
    if rule.when_value is not None:
        t = t & (F.col(rule.option) == F.lit(rule.when_value))
    return t


def _label(rule: Rule) -> str:
    if rule.when_value is None:
        return rule.option
    return f"{rule.option} {rule.when_value}"


def check_requirements(df: DataFrame, id_cols: Sequence[str], rules: Iterable[Rule]) -> DataFrame:
    """Violations of all ``rules``: ``id..., option, rule, missing, message``."""
    cand = []
    for rule in rules:
        trig = _trigger(df, rule)
        label = _label(rule)
        for req in rule.all_of:
            msg = MSG_MISSING.format(missing=req, label=label)
            cand.append(F.when(trig & ~is_truthy(df, req), F.struct(
                F.lit(rule.option).alias("option"), F.lit("requires_all").alias("rule"),
                F.lit(req).alias("missing"), F.lit(msg).alias("message"))))
        if rule.any_of:
            none_defined = F.lit(True)
            for req in rule.any_of:
                none_defined = none_defined & ~is_defined(req)
            listed = ", ".join(f'"{r}"' for r in rule.any_of)
            msg = MSG_ANY.format(label=label, at_least=listed)
            cand.append(F.when(trig & none_defined, F.struct(
                F.lit(rule.option).alias("option"), F.lit("requires_any").alias("rule"),
                F.lit(", ".join(rule.any_of)).alias("missing"), F.lit(msg).alias("message"))))
    if not cand:
        raise ValueError("no rules")
    return (df.select(*id_cols, F.explode(F.array(*cand)).alias("_v"))
            .filter(F.col("_v").isNotNull())
            .select(*id_cols, "_v.option", "_v.rule", "_v.missing", "_v.message"))


def requires(df: DataFrame, id_cols: Sequence[str], option: str, all_of: Sequence[str] = (),
             any_of: Sequence[str] = (), when_value=None) -> DataFrame:
    return check_requirements(df, id_cols, [Rule(option, tuple(all_of), tuple(any_of), when_value)])


def _used(df: DataFrame, cols: Sequence[str]) -> tuple[Column, Column]:
    """Comma-joined names of the set (truthy) columns, and their number."""
    names = F.concat_ws(",", *[F.when(is_truthy(df, c), F.lit(c)) for c in cols])
    count = sum((is_truthy(df, c).cast("int") for c in cols), F.lit(0))
    return names, count


def mutually_exclusive(df: DataFrame, id_cols: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Rows where more than one of ``cols`` is set (truthy)."""
    names, count = _used(df, cols)
    return (df.select(*id_cols, names.alias("used"), count.alias("n_used"))
            .filter(F.col("n_used") > 1))


def exactly_one(df: DataFrame, id_cols: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Rows where not exactly one of ``cols`` is set."""
    _, count = _used(df, cols)
    n = F.col("n_set")
    return (df.select(*id_cols, count.alias("n_set"))
            .filter(n != 1)
            .withColumn("problem", F.when(n == 0, F.lit("none set")).otherwise(F.lit("more than one set"))))


def at_most_one(df: DataFrame, key: str | Sequence[str], pred: Column) -> DataFrame:
    """Groups where more than one row matches ``pred`` (e.g. two masters)."""
    keys = [key] if isinstance(key, str) else list(key)
    return (df.filter(pred).groupBy(*keys).agg(F.count(F.lit(1)).alias("matches"))
            .filter(F.col("matches") > 1))
