"""All queries of the library: importing this module registers them."""

from factloom.plans import aggregates, changesets, documents, headline, ingest, named, relational, scalars, views, windows, written  # noqa: F401
from factloom.plans.registry import ORACLES, QUERIES  # noqa: F401
