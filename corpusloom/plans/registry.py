"""Every query of the library with its DuckDB twin, if SQL can express it."""

from __future__ import annotations

from . import queries_eval, queries_files, queries_rules, queries_search, queries_text

ENTRIES = {**queries_text.ENTRIES, **queries_search.ENTRIES, **queries_rules.ENTRIES, **queries_eval.ENTRIES, **queries_files.ENTRIES}
QUERIES = {name: f for name, (f, _) in ENTRIES.items()}
ORACLES = {name: sql for name, (_, sql) in ENTRIES.items() if sql}
