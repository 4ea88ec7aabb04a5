"""Imports every query module and exposes the full registry."""

from wakeline.catalog import auditing, cleaning, gating, modelling, windowing  # noqa: F401
from wakeline.catalog.base import ORACLES, QUERIES  # noqa: F401
