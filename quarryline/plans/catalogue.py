"""All queries of the core by name, and their SQL."""

from quarryline.plans import dispositions, graphs, identity, mining, portfolio, problems, projection, relational, rules, scalars, scans, timeline
from quarryline.streaming import ledger

_MODULES = (problems, relational, scalars, graphs, mining, dispositions, rules, portfolio, timeline, projection, scans, identity, ledger)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL = {name: text for m in _MODULES for name, text in m.SQL.items()}
