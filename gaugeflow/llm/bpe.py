"""When two BPE tokens can stand side by side in an encoding.

Two tokens stand side by side exactly if, while the merges inside them run, no
merge across their border comes first. Across the border only the last part of
the left token and the first part of the right one can merge, so it is enough
to walk up these two edges in the order of the merges that end each part.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache
from math import inf


class Neighbours:
    """``join(a, b)`` gives (time, token) of a merge or None, earlier times first; ``symbols(token)`` what a token starts from."""

    def __init__(self, join: Callable, symbols: Callable):
        self.join, self.symbols = join, symbols
        self.left_edge = cache(lambda token: self.edge(token, 0))
        self.right_edge = cache(lambda token: self.edge(token, 1))
        self.tree = cache(self.grow)

    def grow(self, token):
        """How merging makes the token from its symbols: (token, time, left, right), None if it doesn't."""
        out = self.merge(self.symbols(token))
        return out[0] if len(out) == 1 and out[0][0] == token else None

    def merge(self, symbols) -> list[tuple]:
        """Runs the earliest merge, the leftmost of equals, until there is none; gives the trees that are left."""
        out = [(s, -inf, None, None) for s in symbols]
        while True:
            best = None
            for i in range(len(out) - 1):
                made = self.join(out[i][0], out[i + 1][0])
                if made is not None and (best is None or made[0] < best[0]):
                    best = (made[0], i, made[1])
            if best is None:
                return out
            time, i, token = best
            out[i : i + 2] = [(token, time, out[i], out[i + 1])]

    def edge(self, token, side: int):
        """The parts on one edge of a token from the smallest up, each with the time of the merge that ends it.

        None if the token can't be made, or if a part is made later than the
        whole, so that times alone don't tell the order.
        """
        node, parts, end = self.tree(token), [], inf
        if node is None or not self.in_order(node):
            return None
        while node is not None:
            parts.append((node[0], end))
            end, node = node[1], node[2 + side]
        return parts[::-1]

    def in_order(self, node) -> bool:
        return node[2] is None or all(part[1] < node[1] and self.in_order(part) for part in node[2:])

    def alone(self, token) -> bool:
        return self.tree(token) is not None

    def fit(self, a, b) -> bool:
        left, right = self.right_edge(a), self.left_edge(b)
        if left is None or right is None:
            made = self.merge([*self.symbols(a), *self.symbols(b)])
            return [n[0] for n in made] == [a, b]
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = left[i], right[j]
            made = self.join(x, y)
            # Of merges at one time the leftmost runs: the left token's own, then the one across, then the right one's.
            if made is not None and made[0] < x_ends and made[0] <= y_ends:
                return False
            if x_ends == y_ends == inf:
                return True
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1
