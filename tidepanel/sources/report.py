"""Markdown reports of small aggregates."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame


def spanish(x: float | None, decimals: int = 2) -> str:
    """1234.5 -> '1.234,50'."""
    if x is None:
        return "-"
    return f"{x:,.{decimals}f}".translate(str.maketrans(",.", ".,"))


def slug(model: str, alpha: float | None = None) -> str:
    return model if alpha is None else f"{model}_alpha_{alpha:g}".translate({46: 95})


def markdown_table(df: DataFrame, order: list[str] | None = None) -> str:
    """A table of an aggregate that is small by construction."""
    rows = (df.orderBy(*order) if order else df).collect()
    cell = lambda v: "" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in rows])


def write_report(path: str | Path, title: str, sections: dict[str, DataFrame | str]) -> None:
    parts = [f"# {title}"]
    for head, body in sections.items():
        parts += [f"## {head}", body if isinstance(body, str) else markdown_table(body)]
    Path(path).write_text("\n\n".join(parts) + "\n", encoding="utf-8")
