"""Records (table rows, JSON objects) as text and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fields that may hold a record's date, in order; the last two may also be epochs.
DATE_FIELDS = ("date", "created_at", "timestamp", "time", "datetime", "created")
EPOCH_FIELDS = ("created_at", "timestamp")


def record_text(columns: list[str]) -> Column:
    """``name: value`` parts joined by ``; ``; NULL and empty values are left out."""
    parts = [F.when(F.col(c).cast("string") != "", F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))) for c in columns]
    return F.concat_ws("; ", *parts)


def record_date(record: Column) -> Column:
    """The first date (yyyy-MM-dd) found in a JSON object's date fields."""
    found = []
    for name in DATE_FIELDS:
        value = F.get_json_object(record, f"$.{name}")
        found.append(F.nullif(F.regexp_extract(value, r"(\d{4}-\d{2}-\d{2})", 1), F.lit("")))
        if name in EPOCH_FIELDS:
            number = F.when(value.rlike(r"^\d{6,16}(\.\d+)?$"), value.cast("double"))
            found.append(F.date_format(F.timestamp_seconds(F.when(number > 1e12, number / 1000).otherwise(number)), "yyyy-MM-dd"))
    return F.coalesce(*found)
