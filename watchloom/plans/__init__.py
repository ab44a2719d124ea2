"""Registered queries; importing the package registers all of them."""

from watchloom.plans import q_decide, q_detect, q_ingest, q_stream, q_windows  # noqa: F401
from watchloom.plans.registry import ORACLES, QUERIES  # noqa: F401
