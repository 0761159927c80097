"""Settings as plain values on the driver."""

from __future__ import annotations

import copy
import json
from pathlib import Path

# The defaults.
DEFAULTS: dict = {
    "decay": {"half_life_days": 30, "grace_period_days": 7, "recall_boost_factor": 0.3, "permanent_threshold": 15, "archive_threshold": 0.02},
    "reflector": {"min_quality_score": 0.3, "max_content_length": 500, "max_code_lines": 3, "llm_enabled": False, "llm_min_score": 70, "llm_timeout_ms": 5000},
    "search": {"keyword_weight": 0.6, "semantic_weight": 0.4, "recency_boost_days": 7, "recency_boost_factor": 1.2, "max_results": 5, "max_tokens": 2000, "min_score": 0.1},
    "sessions": {"idle_minutes": 5, "shutdown_minutes": 10, "check_seconds": 60},
}
CURATE_THRESHOLD = 0.8
CONFLICT_SIMILARITY = 0.75
DECAY_DELTA = 0.001


def merged(base: dict, over: dict) -> dict:
    """base with the values of over; dicts are merged, everything else replaced. Nulls in over are passed over."""
    out = copy.deepcopy(base)
    for k, v in over.items():
        if isinstance(v, dict) and isinstance(out.get(k), dict):
            out[k] = merged(out[k], v)
        elif v is not None:
            out[k] = v
    return out


def load(path: str) -> dict:
    """Settings of a JSON file over the defaults. The file is made if it is missing; one that can't be parsed counts as empty."""
    p = Path(path)
    if not p.exists():
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(json.dumps(DEFAULTS, indent=2))
        return copy.deepcopy(DEFAULTS)
    try:
        got = json.loads(p.read_text())
    except ValueError:
        return copy.deepcopy(DEFAULTS)
    return merged(DEFAULTS, got if isinstance(got, dict) else {})


def literal(text: str):
    """A value typed as text: true and false, numbers, or the text itself."""
    if text in ("true", "false"):
        return text == "true"
    try:
        n = float(text)
    except ValueError:
        return text
    return int(n) if n.is_integer() else n


def with_value(settings: dict, dotted: str, text: str) -> dict:
    """Settings with the value at a dotted path replaced; the path must exist."""
    out = copy.deepcopy(settings)
    at = out
    *parents, last = dotted.split(".")
    for k in parents:
        at = at.get(k) if isinstance(at, dict) else None
        if not isinstance(at, dict):
            raise KeyError(dotted)
    if last not in at:
        raise KeyError(dotted)
    at[last] = literal(text)
    return out
