"""Registered queries of the library and the SQL that says what each must return."""

from vecatlas.plans import cohorts, extra, jobs, ledger, lenses, library, more, moves, scoring, search, series, streams, wide
from vecatlas.plans import layout as layouts

MODULES = (search, library, scoring, series, ledger, layouts, more, extra, wide, jobs, streams, cohorts, moves, lenses)
QUERIES = {k: f for m in MODULES for k, f in m.book.queries.items()}
ORACLE = {k: s for m in MODULES for k, s in m.book.sql.items()}
