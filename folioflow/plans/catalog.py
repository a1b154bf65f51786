"""All queries of the library by name, with the SQL that tells the same."""

from __future__ import annotations

from folioflow.plans import evidence_layer, function_layer, kept_layer, meeting_layer, portal_layer, read_layer, source_layer, text_layer

FLAGSHIP = "align_agenda"
LAYERS = (read_layer, text_layer, evidence_layer, function_layer, meeting_layer, portal_layer, kept_layer, source_layer)
QUERIES = {name: query for layer in LAYERS for name, query in layer.R.queries.items()}
ORACLES = {name: sql for layer in LAYERS for name, sql in layer.R.oracles.items()}
