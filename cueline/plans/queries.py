"""All registered queries of the core library."""

from __future__ import annotations

from . import checks, cues, folds, jobs, reports, runs, scans, texts, timing

GROUPS = (timing.QUERIES, reports.QUERIES, texts.QUERIES, runs.QUERIES, folds.QUERIES, scans.QUERIES, checks.QUERIES, cues.QUERIES, jobs.QUERIES)
QUERIES = {name: q for group in GROUPS for name, (q, _) in group.items()}
ORACLES = {name: sql for group in GROUPS for name, (_, sql) in group.items() if sql}
