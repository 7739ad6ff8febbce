"""Queries by name, and the SQL that gives the same rows."""

from lectern.plans import align, catalog, lint, python_plans, text, timeline
from lectern.plans.dialect import duck_sql, query

PLANS = {**text.PLANS, **catalog.PLANS, **timeline.PLANS, **lint.PLANS, **align.PLANS}
QUERIES = {name: query(plan) for name, plan in PLANS.items()} | python_plans.QUERIES
ORACLE = {name: duck_sql(plan) for name, plan in PLANS.items()} | python_plans.ORACLE
