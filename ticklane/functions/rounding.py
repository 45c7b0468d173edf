"""Rounding a double to n digits the way the report contract asks for."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_sql(x: str, digits: int) -> str:
    """SQL for half-even rounding of the exact binary value of ``x``, as a double.

    Spark's ``round`` and ``bround`` work on the shortest decimal text of the
    double, which moves values such as 12.35 (in binary just below the tie) the
    wrong way. ``format_number`` rounds the exact value. Its only miss is the
    double nearest to half of the last digit, which is handled apart. NaN and
    infinity have no number text and stay as they are.
    """
    half = float(f"5e-{digits + 1}")
    pattern = "0." + "0" * digits
    return (
        f"coalesce(if(abs({x}) = {half!r}D, signum({x}) * {round(half, digits)!r}D, null), "
        f"try_cast(format_number({x}, '{pattern}') as double), {x})"
    )


def py_round(column: str, digits: int) -> Column:
    return F.expr(round_sql(column, digits))
