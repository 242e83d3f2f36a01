"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

import importlib

QUERIES = {}
ORACLES = {}
for _name in ("queries",):
    _m = importlib.import_module(f"{__package__}.{_name}")
    QUERIES |= _m.QUERIES
    ORACLES |= _m.ORACLES
