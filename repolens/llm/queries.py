"""Registered queries of this subpackage."""

from __future__ import annotations

from . import chat, decontaminate, jaccard, langid, mixing, omh, suffix, toxicity, units, warc

MODULES = (units, suffix, toxicity, omh, warc, jaccard, mixing, decontaminate, chat, langid)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in vars(m).items() if name.startswith("op") and name[2].isdigit() and callable(f)}


def oracle_sql() -> dict[str, str]:
    found = {}
    for name in queries():
        for m in MODULES:
            if sql := getattr(m, name.split("_")[0].upper() + "_SQL", None):
                found[name] = sql
    return found
