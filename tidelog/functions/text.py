"""``key:value`` lines and their rendering."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_lines(lines: DataFrame, line: str = "line", order: str = "seq", sep: str = ":") -> DataFrame:
    """Splits at the first separator; lines without one are skipped."""
    at = F.instr(F.col(line), sep)
    return lines.where(at > 0).select(
        F.expr(f"substring({line}, 1, instr({line}, '{sep}') - 1)").alias("key"),
        F.col(order).alias("seq"),
        F.lit(False).alias("is_tombstone"),
        F.expr(f"substring({line}, instr({line}, '{sep}') + 1)").alias("value"),
    )


def render(key: str = "key", value: str = "value") -> Column:
    """``key => value`` with bytes shown as text."""
    return F.concat_ws(" => ", F.col(key).cast("string"), F.col(value).cast("string"))
