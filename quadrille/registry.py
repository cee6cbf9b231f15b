"""Every query of the spatial operators, and its DuckDB SQL."""

from __future__ import annotations

from quadrille.plans import spatial

QUERIES: dict = dict(spatial.QUERIES)
ORACLES: dict = dict(spatial.ORACLES)
