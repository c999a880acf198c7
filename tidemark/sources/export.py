"""Sinks: change rows as CSV, JSON and Markdown; appends, upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import spreadsheet_safe

CHANGE = ("category", "table", "object", "change", "severity", "detail", "manual")


def csv(df: DataFrame, path: str, header: bool = True) -> None:
    """Every field quoted, quotes doubled."""
    df.write.csv(path, header=header, quoteAll=True, escape='"', mode="errorifexists")


def csv_lines(df: DataFrame) -> DataFrame:
    """The same lines as a column, for documents of several blocks."""
    cell = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    return df.select(F.concat_ws(",", *[cell(c) for c in df.columns]).alias("line"))


def activity_csv(df: DataFrame, path: str) -> None:
    """Cells that a spreadsheet would run as formulas get a quote in front."""
    csv(df.select(*[spreadsheet_safe(F.col(c).cast("string")).alias(c) for c in df.columns]), path)


def json_documents(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*"), {"pretty": "true", "ignoreNullFields": "false"}).alias("document"))


def markdown(changes: DataFrame, title: str) -> str:
    """Headings by category and a bullet a change, for a person: all changes, read from one partition after the other."""
    lines, last = [f"# {title}", ""], None
    for r in changes.orderBy("category", "table", "object").toLocalIterator():
        if r.category != last:
            lines += ["" if last else "", f"## {r.category}", ""]
            last = r.category
        lines.append(f"- **{r.table}**{'.' + r.object if r.object else ''}: {r.change} ({r.severity}){' — ' + r.detail if r.detail else ''}{' — by hand' if r.manual else ''}")
    return "\n".join(lines)


def appended_with_parent(rows: DataFrame, parents: DataFrame, key: str, copied: Sequence[str]) -> DataFrame:
    """Rows with columns copied from their parent; rows without one are left out, as by INSERT … SELECT."""
    return rows.join(parents.select(key, *copied), key)


def upserted(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], replace: bool = True) -> DataFrame:
    """The table after an upsert: incoming rows win (or, with replace=False, lose) on equal keys."""
    winner, loser = (incoming, existing) if replace else (existing, incoming)
    return winner.unionByName(loser.join(winner.select(*keys), list(keys), "left_anti"))
