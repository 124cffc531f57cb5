"""Registered queries of the geoparsing engine, and the SQL that each can be held against."""

from __future__ import annotations

from . import basics, flows, more, rest, spatial  # noqa: F401
from .flows import flagship  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
