"""Report sinks: ordered CSV, JSON lines, pretty JSON and pipe tables for small results."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.functions.text import sheet_guard, table_escape


def write_csv(df: DataFrame, path: str, columns: list[str], one_file: bool = False) -> None:
    """CSV with a header and the columns in order, text cells guarded against formulas."""
    out = df.select(*[sheet_guard(F.col(c)).alias(c) if dict(df.dtypes)[c] == "string" else F.col(c) for c in columns])
    (out.coalesce(1) if one_file else out).write.mode("overwrite").csv(path, header=True)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_pretty_json(df: DataFrame, path: str, most_rows: int = 100_000) -> None:
    """One indented JSON array on the driver; refused for more rows than a report has."""
    rows = df.limit(most_rows + 1).toJSON().collect()
    if len(rows) > most_rows:
        raise ValueError("too many rows for a report")
    Path(path).write_text(json.dumps([json.loads(r) for r in rows], ensure_ascii=False, indent=2) + "\n", encoding="utf-8")


def pipe_table(df: DataFrame, columns: list[str], most_rows: int = 10_000) -> str:
    """A pipe table of a small result."""
    rows = df.select(*[table_escape(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in columns]).limit(most_rows + 1).collect()
    if len(rows) > most_rows:
        raise ValueError("too many rows for a table")
    return "\n".join(["| " + " | ".join(columns) + " |", "|" + "-|" * len(columns), *["| " + " | ".join(r) + " |" for r in rows]]) + "\n"
