"""Checks of the two input tables. Each data check is one conditional count, and a table takes one aggregation."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .config import SENTIMENTS, SIGNALS
from .folders import Tables

log = logging.getLogger(__name__)
ID = "conversation_id"
REQUIRED_A = (ID, "created_at", "text", "l5_id", "sentiment", *SIGNALS)


class ContractError(ValueError):
    """An input table breaks the contract."""


def _require(df: DataFrame, columns: tuple[str, ...], table: str) -> None:
    if missing := sorted(set(columns) - set(df.columns)):
        raise ContractError(f"{table}: missing required columns: {missing}")


def violations(a: DataFrame) -> dict[str, Column]:
    """By check, whether a row of Table A breaks it."""
    bad = lambda good: ~F.coalesce(good, F.lit(False))
    out = {
        "created_at": F.col("created_at").cast("string").try_cast("timestamp").isNull(),
        "sentiment": bad(F.col("sentiment").isin(*SENTIMENTS)),
        **{s: bad(F.col(s).cast("int").isin(0, 1)) for s in SIGNALS},
        "l5_id": bad(F.trim("l5_id") != ""),
    }
    if "severity" in a.columns:
        out["severity"] = F.coalesce(~F.col("severity").between(1, 5), F.lit(False))
    return out


def count_violations(a: DataFrame) -> DataFrame:
    """One row: how many rows of Table A break each check."""
    return a.agg(*(F.count_if(bad).alias(name) for name, bad in violations(a).items()))


def validate_table_a(a: DataFrame) -> DataFrame:
    _require(a, REQUIRED_A, "Table A")
    _refuse(a, count_violations(a).first().asDict())
    return a.withColumn("created_at", F.col("created_at").cast("timestamp"))


def _refuse(a: DataFrame, found: dict[str, int]) -> None:
    """Raises ContractError for counts of violations that are not zero."""
    broken = {k: n for k, n in found.items() if n}
    if broken:
        examples = ""
        if "sentiment" in broken:
            rows = a.where(violations(a)["sentiment"]).select("sentiment").distinct().limit(5).collect()
            examples = f"; sentiment has {sorted(str(r[0]) for r in rows)}"
        raise ContractError(f"Table A: rows that break a check: {broken}{examples}")


def dimension_columns(b: DataFrame) -> list[str]:
    """Table B's string-like columns but the id."""
    return [f.name for f in b.schema if isinstance(f.dataType, T.StringType | T.VarcharType | T.CharType) and f.name != ID]


def validate_table_b(b: DataFrame, dimensions: list[str] | None = None) -> list[str]:
    """The dimension columns: those declared, or those found."""
    _require(b, (ID,), "Table B")
    if len(b.columns) < 2:
        raise ContractError("Table B: no column besides conversation_id")
    if dimensions:
        if missing := sorted(set(dimensions) - set(b.columns)):
            raise ContractError(f"Table B: declared dimension columns are missing: {missing}")
        return list(dimensions)
    if not (found := dimension_columns(b)):
        raise ContractError("Table B: no categorical dimension columns detected")
    return found


#: Values a dimension may have: the cube has a cell for each of them and each leaf.
MAX_VALUES = 10_000


def validate_values(b: DataFrame, dimensions: list[str], most: int = MAX_VALUES) -> None:
    """Refuses dimensions with far too many values, such as a column of ids; counts are approximate, within some percents."""
    _refuse_values(b.agg(*_value_counts(dimensions)).first().asDict(), most)


def _value_counts(dimensions: list[str]) -> list[Column]:
    return [F.approx_count_distinct(c).alias(c) for c in dimensions]


def _refuse_values(found: dict[str, int], most: int = MAX_VALUES) -> None:
    if broken := {c: n for c, n in found.items() if n > 1.1 * most}:
        raise ContractError(f"Table B: dimension columns with more than {most} values (declare the dimensions, or bucket these): {broken}")


def join_coverage(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: n_a distinct ids of A, n_joined of them that B has, and the share.

    Both tables' ids meet in one aggregation. A join might broadcast them: files of dictionary-coded columns make Spark take the ids for small.
    """
    ids = a.select(ID, F.lit(True).alias("in_a")).unionByName(b.select(ID, F.lit(False).alias("in_a")))
    by = ids.groupBy(ID).agg(F.bool_or("in_a").alias("in_a"), F.bool_or(~F.col("in_a")).alias("in_b")).where("in_a")
    return by.agg(F.count("*").alias("n_a"), F.count_if(F.col("in_b") & F.col(ID).isNotNull()).alias("n_joined")).withColumn("coverage", F.try_divide("n_joined", "n_a"))


def validate_join(a: DataFrame, b: DataFrame) -> float:
    r = join_coverage(a, b).first()
    if not r["n_joined"]:
        raise ContractError("Table A and Table B share no conversation_id")
    share = r["n_joined"] / r["n_a"]
    (log.warning if share < 0.5 else log.info)("join coverage: %.1f %% of Table A's conversations", 100 * share)
    return share


def admit(a: DataFrame, b: DataFrame, tables: Tables, dimensions: list[str] | None = None, values: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, list[str], int]:
    """What ``validate`` checks, in one job a table: both are written with the columns that a build reads (of B also ``values``), and
    counted while they are; then the ids are joined. Returns both as written, the dimension columns, and the rows of A."""
    _require(a, REQUIRED_A, "Table A")
    found = validate_table_b(b, dimensions)
    seen_a, seen_b = Observation(), Observation()
    bad = violations(a)
    kept = a.observe(seen_a, F.count(F.lit(1)).alias("rows"), *(F.count_if(x).alias(name) for name, x in bad.items()))
    # a value that is no timestamp is counted, not cast: the write must not stop at it
    kept = tables.cut(kept.withColumn("created_at", F.col("created_at").cast("string").try_cast("timestamp") if dict(a.dtypes)["created_at"] == "string" else F.col("created_at").cast("timestamp")))
    counts = dict(seen_a.get)
    rows = counts.pop("rows")
    _refuse(a, counts)
    own = tables.cut(b.select(ID, *dict.fromkeys(c for c in (*found, *values) if c in b.columns)).observe(seen_b, *_value_counts(found)))
    _refuse_values(dict(seen_b.get))
    validate_join(kept, own)
    return kept, own, found, rows


def validate(a: DataFrame, b: DataFrame, dimensions: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Table A with its timestamps cast, and the dimension columns; raises ContractError at the first broken check."""
    a = validate_table_a(a)
    found = validate_table_b(b, dimensions)
    validate_values(b, found)
    validate_join(a, b)
    return a, found
