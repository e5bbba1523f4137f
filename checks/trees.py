"""A small forest stated in full, for the query that scores with it and for its SQL."""

from __future__ import annotations

FEATURES = ["quantity", "price", "discount"]

#: Sample size that the path lengths are scaled by, and the score above which a row is flagged.
SAMPLE = 16
FLAG_ABOVE = 0.56

#: A tree is a path length, or (feature, threshold, tree of the values up to it, tree of the rest).
TREES = [
    ("quantity", 25.5, ("price", 20000.0, 3.5, 2.25), ("price", 70000.0, ("discount", 0.045, 4.0, 4.75), 3.0)),
    ("price", 36500.25, ("discount", 0.085, 2.5, ("quantity", 4.5, 3.25, 3.0)), 1.75),
    ("discount", 0.005, 1.25, ("quantity", 48.5, ("price", 5000.0, 3.0, ("price", 30000.0, 4.5, 4.125)), 2.0)),
    5.0,
]


def arrays(tree) -> tuple[list[int], list[float], list[int], list[int], list[float]]:
    """(feature, threshold, left, right, path) by node, the root first."""
    nodes: list[tuple] = []

    def add(part) -> int:
        at = len(nodes)
        nodes.append(())
        if isinstance(part, float):
            nodes[at] = (-1, 0.0, -1, -1, part)
        else:
            feature, threshold, low, high = part
            nodes[at] = (FEATURES.index(feature), threshold, add(low), add(high), 0.0)
        return at

    add(tree)
    return tuple(list(column) for column in zip(*nodes))
