"""All queries of the library outside the training-data subpackage, with their SQL."""

from __future__ import annotations

from . import catalogue_claims, catalogue_layout, catalogue_more, catalogue_pages, catalogue_rules, catalogue_text, catalogue_tree

_ALL = (catalogue_text, catalogue_layout, catalogue_more, catalogue_claims, catalogue_pages, catalogue_tree, catalogue_rules)

QUERIES = {k: v for m in _ALL for k, v in m.QUERIES.items()}
SQL = {k: v for m in _ALL for k, v in m.SQL.items()}
