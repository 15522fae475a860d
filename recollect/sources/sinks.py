"""Writing results: JSON lines in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def write_results(rows: DataFrame, folder: str) -> str:
    """rows as JSON lines in a new folder below `folder`; returns its path."""
    path = f"{folder.rstrip('/')}/{uuid.uuid4().hex}"
    rows.write.option("ignoreNullFields", "false").json(path)
    return path


def reread(rows: DataFrame, folder: str) -> DataFrame:
    """What write_results has written, with rows' schema."""
    return rows.sparkSession.read.schema(rows.schema).json(write_results(rows, folder))
