"""Queries over the driver's tables; importing the package registers them."""

from quire.plans import accounts, catalogue, folds, pages, relational, routing, rules, texts
from quire.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "accounts", "catalogue", "folds", "pages", "relational", "routing", "rules", "texts"]
