"""Comparison of results."""

import hashlib


def rows_of(frame):
    """Rows of a pandas frame as sorted tuples of texts, columns by name."""
    import pandas as pd

    frame = frame[sorted(frame.columns)]
    return sorted(tuple("NULL" if v is None or v is pd.NaT or isinstance(v, float) and v != v else repr(float(v)) if isinstance(v, float) else str(v) for v in r) for r in frame.itertuples(index=False))


def cosine(a, b):
    size = sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5
    return sum(x * y for x, y in zip(a, b, strict=True)) / size if size and len(a) == len(b) else 0.0


def curated_in_order(bullets, records, threshold=0.8, cached=True):
    """(rows by id, outcomes): records merged one after the other against everything, as plainly as can be. bullets: dicts by rising id."""
    arrays = ("related_tools", "related_files", "key_entities", "tags")
    state, outcomes = {b["id"]: dict(b) for b in bullets}, []
    for r in records:
        if not (r["content"] or "").strip():
            outcomes.append("skipped")
            continue
        if cached and r["embedding"] is not None:
            near = [(round(cosine(r["embedding"], b["embedding"]), 12), -i, b) for i, b in enumerate(state.values()) if b["embedding"] is not None]
            best = max(near, key=lambda x: x[:2], default=None)
            hit = best[2] if best and best[0] >= threshold else None
        else:
            hit = min((b for b in state.values() if b["content"] == r["content"]), key=lambda b: (-b["decay_weight"], b["id"]), default=None)
        outcomes.append("merged" if hit else "added")
        if not hit:
            hit = r | {c: [] for c in arrays} | {"id": hashlib.sha256(f"{r['content']}|{r['scope']}|{r['seq']}".encode()).hexdigest(), "decay_weight": 1.0, "recall_count": 0}
            state[hit["id"]] = hit
        hit["content"] = max(hit["content"], r["content"], key=len)
        hit["instructivity_score"] = max(hit["instructivity_score"], r["instructivity_score"])
        hit["embedding"] = r["embedding"] if r["embedding"] is not None else hit["embedding"]
        for c in arrays:
            hit[c] = list(dict.fromkeys([*(hit[c] or []), *(r[c] or [])]))
    return state, outcomes
