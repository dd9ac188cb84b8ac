"""All registered queries over the driver's tables and their SQL."""

from __future__ import annotations

from . import changes, equality, hierarchy, linking, mappings, measuring, modelling, naming, slicing

FLAGSHIP = "link_suppliers"
MODULES = (linking, hierarchy, naming, modelling, mappings, equality, slicing, changes, measuring)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: text for module in MODULES for name, text in module.ORACLES.items()}
