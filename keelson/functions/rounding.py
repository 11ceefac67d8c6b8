"""Result tidying shared by reports: six decimals, no negative zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def r6(c: str | Column, name: str | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    out = F.round(col, 6) + F.lit(0.0)
    return out.alias(name or c) if (name or isinstance(c, str)) else out


def tidy(df: DataFrame) -> DataFrame:
    """Rounds every double and widens integers."""
    out = []
    for f in df.schema.fields:
        t = f.dataType.simpleString()
        if t in ("double", "float"):
            out.append((F.round(F.col(f.name).cast("double"), 6) + F.lit(0.0)).alias(f.name))
        elif t in ("int", "smallint", "tinyint"):
            out.append(F.col(f.name).cast("bigint").alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)
