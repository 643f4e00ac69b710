"""Reports of evaluation aggregates: Spark computes a few rows, the driver renders them."""

from __future__ import annotations

import html as _html
import json
import time

from pyspark.sql import DataFrame

from loomquery.operators.evaluate import distribution, overall
from loomquery.sources import sinks

#: Lower bounds of the grades.
GRADES = [(0.8, "excellent"), (0.6, "good"), (0.4, "fair"), (0.0, "poor")]
#: Rows of details that a report shows at most. ``save`` writes all of them beside it, from the executors.
DETAIL_ROWS = {"text": 5, "markdown": 10_000, "html": 10, "json": 10_000}


def grade(score: float | None) -> str:
    return next((name for least, name in GRADES if score is not None and score >= least), "unknown")


def summarise(long: DataFrame, weights: dict[str, float] | None = None) -> dict:
    rows = [r.asDict() for r in distribution(long).orderBy("metric_name").collect()]
    total = overall(long, weights).first()
    return {"metrics": rows, "overall": total["overall"] if total else None}


def render(summary: dict, details: DataFrame | None = None, kind: str = "markdown") -> str:
    """The report as text, markdown, json or html; ``details`` adds rows up to the format's count."""
    most = DETAIL_ROWS[kind]
    rows = [r.asDict() for r in details.limit(most).collect()] if details is not None else []
    cols = ["metric_name", "mean", "std", "min", "p25", "p50", "p75", "max", "n"]
    if kind == "json":
        return json.dumps(summary | {"details": rows}, ensure_ascii=False, indent=2, default=str)
    if kind == "html":
        cell = lambda x: f"<td>{_html.escape(str(x))}</td>"
        body = "".join(f'<tr class="{grade(m["mean"])}">{"".join(cell(m[c]) for c in cols)}</tr>' for m in summary["metrics"])
        more = "".join(f"<tr>{''.join(cell(v) for v in r.values())}</tr>" for r in rows)
        return f"<html><body><h1>Evaluation</h1><p>Overall {summary['overall']}</p><table><tr>{''.join(f'<th>{c}</th>' for c in cols)}</tr>{body}</table><table>{more}</table></body></html>"
    if kind == "text":
        lines = [f"Overall: {summary['overall']}", *(f"{m['metric_name']}: mean {m['mean']} std {m['std']} ({grade(m['mean'])})" for m in summary["metrics"])]
        return "\n".join([*lines, *(str(r) for r in rows)])
    table = ["| " + " | ".join(cols) + " |", "|" + "-|" * len(cols), *("| " + " | ".join(str(m[c]) for c in cols) + " |" for m in summary["metrics"])]
    return "\n".join(["# Evaluation", "", f"Overall: {summary['overall']}", "", *table, *(f"- {r}" for r in rows)])


def save(summary: dict, details: DataFrame, folder: str, name: str = "evaluation") -> dict[str, str]:
    """A stamped set of files: the summary as JSON, Markdown and HTML, and all details as JSON lines; their paths."""
    stamp = time.strftime("%Y%m%d_%H%M%S")
    paths = {kind: f"{folder.rstrip('/')}/{name}_{stamp}.{end}" for kind, end in (("json", "json"), ("markdown", "md"), ("html", "html"))}
    for kind, path in paths.items():
        sinks.text_file(details.sparkSession, path, render(summary, details, kind))
    paths["details"] = f"{folder.rstrip('/')}/{name}_{stamp}_details"
    sinks.json_rows(details, paths["details"])
    return paths
