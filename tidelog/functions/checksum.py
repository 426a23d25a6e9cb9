"""Entry checksums: IEEE CRC-32 over key then value, as Spark's crc32 computes it."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def entry_crc(key: str = "key", value: str = "value") -> Column:
    return F.crc32(F.concat(F.col(key).cast("binary"), F.coalesce(F.col(value).cast("binary"), F.lit(b""))))


def mismatches(entries: DataFrame, crc: str = "crc") -> DataFrame:
    """Entries whose stored checksum differs from the recomputed one."""
    return entries.where(~F.col(crc).eqNullSafe(entry_crc()))
