"""Result shaping shared by the query plans.

Doubles leave a plan as floor(x * 1e6 + 0.5) / 1e6. The oracle SQL applies the
same IEEE operations, so equal inputs give bit-identical outputs; engine
``round()`` functions disagree on values sitting at a .5 boundary.
Integer columns that may hold NULL leave as doubles on both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SCALE = 1000000


def r6(c: Column) -> Column:
    return F.floor(c * F.lit(float(SCALE)) + F.lit(0.5)) / F.lit(float(SCALE))


def R6(sql_expr: str) -> str:
    return f"(floor(({sql_expr}) * {SCALE} + 0.5) / {SCALE})"


def shape(df: DataFrame, doubles=(), as_double=()) -> DataFrame:
    """Apply r6 to ``doubles`` and cast ``as_double`` (nullable ints) to double."""
    out = []
    for c in df.columns:
        if c in doubles:
            out.append(r6(F.col(c).cast("double")).alias(c))
        elif c in as_double:
            out.append(F.col(c).cast("double").alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)
