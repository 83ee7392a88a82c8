"""Registered queries over the driver's tables; importing this package fills the registry."""

import importlib

MODULES = ["q_criteria", "q_search", "q_text", "q_derive", "q_snapshot", "q_marks", "q_sources", "q_corpus"]
for _module in MODULES:
    importlib.import_module(f"{__name__}.{_module}")

from .registry import ORACLES, QUERIES  # noqa: E402,F401
