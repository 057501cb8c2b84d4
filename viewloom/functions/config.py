"""Nested options: defaults, overrides by dotted names, and options named by others."""

from __future__ import annotations

import copy


def merged(base: dict, more: dict) -> dict:
    """``base`` with the nested values of ``more``; neither is changed."""
    out = copy.deepcopy(base)
    for k, v in more.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def overridden(base: dict, options: dict[str, object]) -> dict:
    """``base`` with options whose names are dotted paths, such as ``{"clustering.k": 8}``."""
    out = copy.deepcopy(base)
    for name, value in options.items():
        *way, last = name.split(".")
        at = out
        for k in way:
            if not isinstance(at.setdefault(k, {}), dict):
                at[k] = {}
            at = at[k]
        at[last] = value
    return out


def unknown(base: dict, options: dict[str, object]) -> list[str]:
    """Dotted names that the defaults lack, so that a misspelt option is seen."""
    missing = []
    for name in options:
        at: object = base
        for k in name.split("."):
            at = at.get(k) if isinstance(at, dict) else None
        if at is None:
            missing.append(name)
    return missing
