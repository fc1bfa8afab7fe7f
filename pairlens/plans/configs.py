"""Which fields to compare: sequences of configurations, as plain functions of weights and token counts."""

from __future__ import annotations

Config = tuple[int, ...]


def leave_one_out(n: int) -> list[Config]:
    """All fields, then all but one for each; one field has no more than itself."""
    every = tuple(range(n))
    return [every] if n <= 1 else [every, *(tuple(f for f in every if f != gone) for gone in every)]


def top_down(weights: list[float], left_tokens: list[int], right_tokens: list[int]) -> list[Config]:
    """All fields, then level by level: all but one of those remaining, until one remains.

    The field of largest weight (the first of those) is never left out alone. Which field goes for
    good is decided by what the level's records keep without it: the first field without which at
    least half of the tokens summed over the level's configurations is kept on both sides, else the
    first of least weight. left_tokens, right_tokens: tokens of each field, over all records.
    """
    remaining = list(range(len(weights)))
    if not remaining:
        return []
    out = [tuple(remaining)]
    safe = max(remaining, key=lambda f: (weights[f], -f))
    while len(remaining) > 1:
        kept = []
        for gone in remaining:
            rest = [f for f in remaining if f != gone]
            if gone == safe:
                kept.append((0, 0))
                continue
            out.append(tuple(rest))
            kept.append((sum(left_tokens[f] for f in rest), sum(right_tokens[f] for f in rest)))
        l_total, r_total = (sum(x) for x in zip(*kept, strict=True))
        drop = next((i for i, (a, b) in enumerate(kept) if 2 * a >= l_total and 2 * b >= r_total), None)
        if drop is None:
            drop = min(range(len(remaining)), key=lambda i: (weights[remaining[i]], i))
        remaining.pop(drop)
    return out
