"""Importing the query modules fills the registry."""

from folioworks.plans import layout_queries, ledger_queries, note_queries, page_queries, record_queries, text_queries  # noqa: F401
from folioworks.plans.registry import ORACLES, QUERIES  # noqa: F401
