"""Versioned specification documents as tables: types of rows, change logs, checks and the store.

The names here are the library's public ones; they are loaded when they are first used.
"""

from __future__ import annotations

import importlib

#: Public names and where they live.
_PUBLIC = {
    "SECTION_CAP": "operators.diff", "keyed_diff": "operators.diff", "deep_diff": "operators.diff", "cap_sections": "operators.diff",
    "diff_info": "plans.builds", "diff_flows": "plans.builds", "diff_attributes": "plans.builds", "diff_errors": "plans.builds", "diff_actions": "plans.builds", "diff_paths": "plans.builds", "diff_docs": "plans.builds",
    "changelog": "plans.builds", "section_table": "plans.builds", "reconstruct": "plans.builds", "facts": "plans.builds",
    "Check": "operators.validate", "CHECKS": "operators.validate", "run_checks": "operators.validate", "Store": "operators.store",
    "convert_build": "plans.convert", "convert_attributes": "plans.convert", "bundles": "plans.mining", "book": "plans.book",
}
__all__ = sorted(_PUBLIC)


def __getattr__(name: str):
    if name not in _PUBLIC:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(importlib.import_module(f".{_PUBLIC[name]}", __name__), name)
