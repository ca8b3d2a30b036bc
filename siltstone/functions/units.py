"""Time units of expiry settings."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values
UNIT_MILLIS = {"SECONDS": 1000, "MINUTES": 60_000, "HOURS": 3_600_000, "DAYS": 86_400_000}


def to_millis(amount: Column, unit: Column) -> Column:
    """``amount`` of the named unit in ms; an unknown or null unit, or a null amount, gives null."""
    factor = F.lit(None).cast("long")
    for name, ms in UNIT_MILLIS.items():
        factor = F.when(unit == name, F.lit(ms).cast("long")).otherwise(factor)
    return amount.cast("long") * factor
