"""Reports as text, from facts alone. Values appear as shapes, but for the masked sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.detect import MASK_FOR, remarks

RULE = "=" * 78
CHANGES_SHOWN, FAILURES_SHOWN = 45, 40


def _section(title: str, lines) -> list[str]:
    return ["", title, "-" * len(title), *lines]


def _page(title: str, *sections: list[str]) -> str:
    return "\n".join([RULE, title, RULE, *(x for s in sections for x in s)]) + "\n"


def _table(rows: list[tuple], head: tuple) -> list[str]:
    cells = [tuple(str(x) for x in r) for r in [head, *rows]]
    width = [max(len(r[i]) for r in cells) for i in range(len(head))]
    return ["  ".join(x.ljust(w) for x, w in zip(r, width)).rstrip() for r in cells]


def quality(facts: dict) -> str:
    columns = [(n, f["declared_type"], f["missing"], f"{f['missing_pct']}%", f["distinct_count"], len(f["issues"])) for n, f in facts["columns"].items()]
    head = [f"rows {facts['rows']}, duplicate rows {facts['duplicate_rows']}, completeness {facts['completeness_pct']}%"]
    issues = [f"{n}: {i}" for n, f in facts["columns"].items() for i in f["issues"]] or ["none"]
    formats = [f"{n}: {label}: {k}" for n, f in facts["columns"].items() for label, k in f.get("formats", [])]
    return _page("DATA QUALITY", _section("Table", head), _section("Columns", _table(columns, ("column", "type", "missing", "share", "distinct", "issues"))), _section("Issues", issues),
                 _section("Formats", formats or ["none"]), _section("Across columns", [f"{k}: {v}" for k, v in facts["cross"].items()] or ["not checked"]))


def personal_data(found: dict) -> str:
    rows = [(c, f.declared, f.pii_type or "-", f.confidence, f.populated, f.sensitivity, f.identifiability, MASK_FOR.get(f.pii_type, "ask whoever owns it")) for c, f in found["columns"].items()]
    hits = [f"{c}: {d}: {h.match_count} ({h.match_rate}%), such as {h.example_shape}" for c, f in found["columns"].items() for d, h in f.content.items()]
    t = found["table"]
    head = [f"risk {t.risk}, {t.pii_columns} columns of personal data, exposure {t.exposure}, rows {found['rows']}", f"direct identifiers: {t.direct or 'none'}", f"quasi-identifiers: {t.quasi or 'none'}"]
    again = [f"{k}: {v}" for k, v in found["reidentification"].items()] or ["not checked"]
    return _page("PERSONAL DATA", _section("Summary", head), _section("Columns", _table(rows, ("column", "declared", "type", "confidence", "populated", "sensitivity", "identifies", "mask"))),
                 _section("Content", hits or ["none"]), _section("Flags", [f"{c}: {x}" for c, f in found["columns"].items() for x in remarks(f)] or ["none"]), _section("Alone in birth year and city", again))


def first_rows(df: DataFrame, n: int) -> list:
    return df.orderBy(F.col("row_index").asc_nulls_first(), *(F.col(c).asc_nulls_first() for c in df.columns if c != "row_index")).limit(n).collect()


def validation(pre, post) -> str:
    sections = []
    for v in (pre, post):
        head = [f"rows {v.rows}, failures {v.total}, rows quarantined {v.quarantined}" + (f", FATAL: {v.fatal}" if v.fatal else "")]
        sections.append(_section(v.stage, head + _table(sorted(v.by_check.items()), ("check", "n")) + [""] + _table(sorted(v.by_column.items()), ("column", "n"))))
        if v.failures is not None:
            rows = [(r.row_index if r.row_index is not None else "-", r.column or "<dataset>", r.check, r.severity, r.message, r.value_shape or "") for r in first_rows(v.failures, FAILURES_SHOWN)]
            sections.append(_section(f"{v.stage}: first {FAILURES_SHOWN}", _table(rows, ("row", "column", "check", "severity", "message", "shape"))))
    solved = 100 * (pre.total - post.total) / max(pre.total, 1)
    return _page("VALIDATION", *sections, _section("Resolved by cleaning", [f"{solved:.1f}%"]))


def cleaning(summary: dict, counts: list, changes: DataFrame, policy: str) -> str:
    rows = [(r.row_index, r.column or "<row>", r.action, r.reason, r.before_shape or "", r.after_shape or "") for r in first_rows(changes, CHANGES_SHOWN)]
    return _page("CLEANING", _section("Summary", [f"{k}: {v}" for k, v in summary.items()] + [f"ambiguous dates are read {policy}"]),
                 _section("Changes", _table(sorted((r.column, r.action, r.n) for r in counts), ("column", "action", "n"))),
                 _section(f"First {CHANGES_SHOWN}", _table(rows, ("row", "column", "action", "reason", "before", "after"))))


def masked_sample(samples: dict, counts: dict, residual: dict) -> str:
    pairs = [(c, b, a) for c, some in samples.items() for b, a in some]
    return _page("MASKED SAMPLE: RESTRICTED, holds raw values", _section("Values changed", _table(sorted(counts.items()), ("column", "n"))),
                 _section("Samples", _table(pairs, ("column", "before", "after"))), _section("Residual risk", [f"{k}: {v}" for k, v in residual.items()]))


def execution(run) -> str:
    steps = [(s.name, s.status, f"{s.seconds:.3f}", s.rows_in if s.rows_in is not None else "-", s.rows_out if s.rows_out is not None else "-", s.detail or s.error or "") for s in run.steps]
    end = f"halted at {run.halted_at}: {run.halt_reason}" if run.halted_at else "complete"
    return _page(f"RUN {run.run_id}", _section("Outcome", [end, f"exit code {run.exit_code}", f"{run.duration:.2f} s"]), _section("Steps", _table(steps, ("step", "status", "s", "in", "out", "detail"))),
                 _section("Metrics", [f"{k}: {v}" for k, v in run.metrics.items()] or ["none"]), _section("Outputs", run.outputs or ["none"]))
