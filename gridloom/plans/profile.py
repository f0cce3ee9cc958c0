"""Routing of ordered requests between two equivalent sources by a conjunctive rule over the request's facts."""

from __future__ import annotations

from gridloom.model import fields, require
from gridloom.operators.ordered import admit

RANGES = ("polygons", "windows", "selected_cells", "envelope_width", "envelope_height", "envelope_cells")


def eligible(rule: dict, facts: dict, access_class: str) -> bool:
    """All conditions hold; bounds are inclusive. An unknown access class is never eligible."""
    fields(rule, ("enabled", "access_classes", "bands", *RANGES), ("enabled", "access_classes", "bands", *RANGES))
    box = facts["window_envelope"] or [0, 0, 0, 0]
    seen = (facts["polygon_count"], facts["window_count"], facts["selected_cells"], box[2], box[3], facts["envelope_cells"])
    same = sorted(facts["selected_bands"]) == sorted(rule["bands"])
    return bool(rule["enabled"]) and access_class != "unknown" and access_class in rule["access_classes"] and same and all(lo <= v <= hi for v, (lo, hi) in zip(seen, (rule[r] for r in RANGES), strict=True))


def route(profile: dict, request: dict, view_id: str, numerical_policy: str, access_class: str = "unknown") -> tuple[str, dict]:
    """(``direct`` or ``accelerated``, facts). Exactly one source is opened and there is no fallback."""
    require(profile["view_id"] == view_id, "another view")
    require(profile["numerical_policy"] == numerical_policy, "another numerical policy")
    facts = admit(request)
    return ("accelerated" if eligible(profile["accelerated_when"], facts, access_class) else "direct"), facts
