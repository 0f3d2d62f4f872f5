"""Evaluation reports: a small table of metrics, and its text form."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tidemark import fixed
from tidemark.operators import metrics


@dataclass(frozen=True)
class Report:
    title: str
    notes: tuple[str, ...]
    macro_f1: float
    lines: dict[str, tuple]
    cells: dict[tuple[str, str], int]
    labels: tuple[str, ...]
    unscored: int = 0

    def text(self) -> str:
        """The printed report: heading, macro-F1, per-class table, confusion matrix."""
        out = [self.title, *self.notes, "-" * 53, f"macro F1 {self.macro_f1:.4f}, without prediction {self.unscored}", ""]
        out += [f"{'class':>12}{'precision':>11}{'recall':>10}{'F1':>10}{'rows':>10}", ""]
        for name in self.labels:
            out.append(self._row(name))
        out.append("")
        for name in ("accuracy", "macro avg", "weighted avg"):
            out.append(self._row(name))
        out += ["", f"true class down, predicted class across: {', '.join(self.labels)}"]
        for t in self.labels:
            out.append(" ".join(f"{self.cells[t, p]:>9}" for p in self.labels))
        return "\n".join(out) + "\n"

    def _row(self, name: str) -> str:
        *scores, support = self.lines[name]
        shown = [" " * w if v is None else f"{v:>{w}.3f}" for v, w in zip(scores, (11, 10, 10))]
        return f"{name:>12}{''.join(shown)}{support:>10}"


def evaluate(
    pairs: DataFrame, title: str, notes: Sequence[str] = (), labels: Sequence[str] = fixed.LABELS
) -> Report:
    """Count the pairs where they lie; the driver sees the cells only."""
    spark = pairs.sparkSession
    counted = metrics.confusion_matrix(pairs, labels=labels, unscored=True).collect()
    cells = spark.createDataFrame(counted, "true_label string, pred_label string, n bigint")
    lines = {r["class"]: (r.precision, r.recall, r.f1, r.support) for r in metrics.classification_report(cells).collect()}
    return Report(
        title,
        tuple(notes),
        float(metrics.macro_f1(cells).first()["macro_f1"]),
        lines,
        {(r.true_label, r.pred_label): r.n for r in counted if r.pred_label is not None},
        tuple(labels),
        sum(r.n for r in counted if r.pred_label is None),
    )


def header(
    counts: Mapping[str, int | None], cuts: Mapping[str, str], signals: Sequence[str] = (), notes: Sequence[str] = ()
) -> list[str]:
    """Heading lines: rows by split (only the name where the number is None), split dates, signals, other notes."""
    shown = ", ".join(name if n is None else f"{name} {n}" for name, n in counts.items())
    lines = [f"rows: {shown}", "cuts: " + ", ".join(f"{k} {v}" for k, v in cuts.items())]
    return lines + ([f"signals: {', '.join(signals)}"] if signals else []) + list(notes)


def write_report(spark, report: Report, path: str) -> None:
    """Store the text as one file in a folder on the job's file system."""
    text = spark.createDataFrame([(report.text(),)], "value string")
    text.coalesce(1).write.mode("overwrite").text(path)
