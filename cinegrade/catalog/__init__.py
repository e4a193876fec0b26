"""Registered queries over the driver tables, each with its SQL twin where one exists."""

from cinegrade.catalog import corpus, features, guide, joins, matching, models

_PARTS = [corpus, guide, joins, matching, features, models]
QUERIES = {name: fn for part in _PARTS for name, fn in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
