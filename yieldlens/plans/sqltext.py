"""Render rule sets as DuckDB SQL (RE2) for the oracle side of the checks."""

from __future__ import annotations

from ..functions.text import RuleSet, windowed
from .registry import q


def sql_match(text: str, rules: RuleSet, body: str) -> str:
    return f"regexp_matches({text}, {q(windowed(rules.anchors, rules.window, body))})"


def sql_label(text: str, rules: RuleSet) -> str:
    arms = []
    for c in rules.classes:
        cond = sql_match(text, rules, c.include)
        if c.exclude is not None:
            cond += f" AND NOT coalesce({sql_match(text, rules, c.exclude)}, false)"
        arms.append(f"WHEN {cond} THEN {q(c.label)}")
    return "CASE " + " ".join(arms) + f" ELSE {q(rules.default)} END"


def sql_subtype(text: str, rules: RuleSet) -> str:
    arms = [f"WHEN {sql_match(text, rules, body)} THEN {q(name)}" for name, body in rules.subtypes]
    return "CASE " + " ".join(arms) + " ELSE NULL END"
