"""Flat metric tables and charts of score summaries (RPT1-RPT4, SNK7, SNK8)."""

from __future__ import annotations

from pathlib import Path

from quillon.operators.scoring import GROUPINGS, METRICS, RATES
from quillon.sources.sinks import write_csv_rows
from quillon.sources.tables import read_summary

COLUMNS = ["run_name", "source_file", "group_type", "group", *METRICS, *RATES]


def rate(n, d) -> float | None:
    return round((n or 0) / d, 6) if d else None


def flatten(paths: list[str], run_names: list[str] | None = None) -> list[dict]:
    """One row for each run and group: overall, then the groupings in their order, groups sorted."""
    names = run_names or [Path(p).stem for p in paths]
    if len(names) != len(paths):
        raise ValueError("as many run names as inputs are needed")
    rows = []
    for name, path in zip(names, paths, strict=True):
        summary = read_summary(path)
        for kind in GROUPINGS:
            found = {"overall": summary.get("overall", {})} if kind == "overall" else summary.get(kind, {})
            for group in sorted(found):
                m = {k: found[group].get(k, 0 if k.endswith("_count") else None) for k in METRICS}
                rows.append({"run_name": name, "source_file": str(path), "group_type": kind, "group": group, **m, **{r: rate(m[c], m["items"]) for r, c in RATES.items()}})
    return rows


def write_tables(rows: list[dict], folder: str) -> tuple[Path, Path]:
    overall, group = Path(folder, "tables/overall_metrics.csv"), Path(folder, "tables/group_metrics.csv")
    write_csv_rows([r for r in rows if r["group_type"] == "overall"], str(overall), COLUMNS)
    write_csv_rows([r for r in rows if r["group_type"] != "overall"], str(group), COLUMNS)
    return overall, group


def render_figures(rows: list[dict], folder: str) -> list[Path]:
    """Bar, grouped-bar and line charts of a few dozen rows; needs matplotlib, which may be absent."""
    try:
        import matplotlib

        matplotlib.use("Agg")
        import matplotlib.pyplot as plt
    except ImportError as e:
        raise RuntimeError("figures need matplotlib") from e
    out = Path(folder, "figures")
    out.mkdir(parents=True, exist_ok=True)
    overall = [r for r in rows if r["group_type"] == "overall"]
    made = []

    def save(name, draw):
        fig, ax = plt.subplots(figsize=(8, 4.5))
        draw(ax)
        ax.set_title(name.replace("_", " "))
        fig.tight_layout()
        fig.savefig(out / f"{name}.png")
        plt.close(fig)
        made.append(out / f"{name}.png")

    def bars(rows, fields):
        def draw(ax):
            for k, f in enumerate(fields):
                ax.bar([i + k / (len(fields) + 1) for i in range(len(rows))], [r[f] or 0 for r in rows], 1 / (len(fields) + 1), label=f)
            ax.set_xticks(range(len(rows)), [f"{r['run_name']}:{r['group']}" for r in rows], rotation=30, ha="right")
            ax.legend()
        return draw

    def lines(rows, fields):
        def draw(ax):
            for f in fields:
                ax.plot([r["run_name"] for r in rows], [r[f] or 0 for r in rows], marker="o", label=f)
            ax.legend()
        return draw

    several = len(overall) > 1
    for name, own, fields, draw in charts(rows):
        save(name, lines(own, fields) if draw == "line" and several else bars(own, fields))
    return made


def charts(rows: list[dict]) -> list[tuple[str, list[dict], list[str], str]]:
    """Name, rows, fields and kind of every chart that the rows allow; a line over one run is drawn as bars."""
    overall = [r for r in rows if r["group_type"] == "overall"]
    probes = [r for r in rows if r["group_type"] == "by_hallucination_probe"]
    h1 = [r for r in probes if r["group"] == "H1"]
    every = [
        ("accuracy_by_probe", probes, ["accuracy"], "bar"), ("h_counts_by_probe", probes, ["h1_count", "h2_count"], "bar"),
        ("overall_accuracy", overall, ["accuracy"], "line"), ("overall_h_rates", overall, ["h1_rate", "h2_rate"], "line"),
        ("h1_direction_counts", h1, ["h1_false_positive_count", "h1_false_negative_count"], "bar"),
    ]
    return [c for c in every if c[1]]
