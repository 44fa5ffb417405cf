"""Column types of the two database dialects and their Spark equivalents."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# SQL Server type -> (PostgreSQL type, Spark type).
SQLSERVER_TO_POSTGRES = {
    "BIGINT": ("BIGINT", "bigint"),
    "INT": ("INTEGER", "int"),
    "BIT": ("BOOLEAN", "boolean"),
    "NVARCHAR": ("VARCHAR", "string"),
    "VARCHAR": ("VARCHAR", "string"),
    "NVARCHAR(MAX)": ("TEXT", "string"),
    "CHAR": ("CHAR", "string"),
    "DECIMAL": ("NUMERIC", "decimal"),
    "MONEY": ("NUMERIC(19,4)", "decimal(19,4)"),
    "FLOAT": ("DOUBLE PRECISION", "double"),
    "DATETIME2": ("TIMESTAMPTZ", "timestamp"),
}

_NAME = re.compile(r"^\s*([A-Z0-9 ]+?)\s*(\(.*\))?\s*$")


def map_type(declared: str) -> tuple[str, str]:
    """(target dialect type, Spark type) for a declared source type such as ``DECIMAL(12,2)``."""
    text = declared.upper().replace(", ", ",")
    if text in SQLSERVER_TO_POSTGRES:
        return SQLSERVER_TO_POSTGRES[text]
    m = _NAME.match(text)
    if not m or m.group(1) not in SQLSERVER_TO_POSTGRES:
        raise ValueError(f"no mapping for type {declared!r}")
    target, spark = SQLSERVER_TO_POSTGRES[m.group(1)]
    args = m.group(2) or ""
    return target + args, spark + args if spark == "decimal" else spark


def map_types(df: DataFrame, declared: dict[str, str]) -> DataFrame:
    """Cast the declared columns to the Spark type of their mapped dialect type.

    Fixed-width text loses its trailing blanks, so that both sides compare equal. ``type_error``
    names the first column whose value does not fit, else it is null.
    """
    cols, bad = [], []
    for c in df.columns:
        if c not in declared:
            cols.append(F.col(c))
            continue
        spark = map_type(declared[c])[1]
        col = F.col(c).try_cast(spark)
        bad.append(F.when(F.col(c).isNotNull() & col.isNull(), F.lit(c)))
        if declared[c].upper().startswith("CHAR"):
            col = F.rtrim(col)
        cols.append(col.alias(c))
    return df.select(*cols, F.coalesce(*bad, F.lit(None).cast("string")).alias("type_error"))
