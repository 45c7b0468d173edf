"""Trees of Spark ML as nested conditions."""

import re

_LINE = re.compile(r"^\s*(If|Else) \(feature (\d+) (<=|>) (\S+)\)|^\s*Predict: (\S+)")


def nested(debug: str):
    """A tree's debug text as (feature, threshold, if at most, if above), or a leaf's value."""
    lines = [m for m in map(_LINE.match, debug.splitlines()) if m]
    at = 0

    def node():
        nonlocal at
        m = lines[at]
        at += 1
        if m[5] is not None:
            return float(m[5])
        low = node()
        at += 1  # the Else of the same condition
        return int(m[2]), float(m[4]), low, node()

    return node()


def paths(tree, before=()):
    """Every path from the root as conditions (feature, '<=' or '>', threshold), inner nodes too."""
    if before:
        yield before
    if isinstance(tree, tuple):
        feature, threshold, low, high = tree
        yield from paths(low, (*before, (feature, "<=", threshold)))
        yield from paths(high, (*before, (feature, ">", threshold)))


def value(tree, x) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree
