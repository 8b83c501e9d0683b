"""Small weighted finite-state transducers over the symbols of a clause, their composition, and best paths.

Weights add along a path and the greater is the better (the tropical semiring with its sign turned). A symbol is a class,
a set of flags and the weight of its word; a transducer reads classes, and hands symbols on with flags of its own added or
the class changed. It may guess what comes later by having several arcs, of which those that guess wrong end in states that
aren't final.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

#: (class, flags, weight of the word)
Symbol = tuple[str, int, float]
#: (next state, symbol handed on, weight)
Arc = tuple[object, Symbol, float]


@dataclass
class Transducer:
    """arcs: state -> {class or "*" for any other: [(next state, class handed on or None for the same, flags added, weight)]}.
    A state without an arc for a class ends the path."""

    start: object
    arcs: dict
    dead: frozenset = frozenset()  # states that aren't final

    def step(self, state, symbol: Symbol) -> list[Arc]:
        of = self.arcs[state]
        found = of.get(symbol[0])
        if found is None:
            found = of.get("*", ())
        return [(n, (symbol[0] if c is None else c, symbol[1] | f, symbol[2]), w) for n, c, f, w in found]

    def final(self, state) -> bool:
        return state not in self.dead


@dataclass
class Composed:
    """The transducer that hands its input through `one` and what that hands on through `two`. Its states are pairs, made
    when they are reached and then kept."""

    one: object
    two: object
    known: dict = field(default_factory=dict)

    @property
    def start(self):
        return (self.one.start, self.two.start)

    def step(self, state, symbol: Symbol) -> list[Arc]:
        key = (state, symbol)
        out = self.known.get(key)
        if out is None:
            a, b = state
            out = self.known[key] = [((n, m), z, v + w) for n, y, v in self.one.step(a, symbol) for m, z, w in self.two.step(b, y)]
        return out

    def final(self, state) -> bool:
        return self.one.final(state[0]) and self.two.final(state[1])


def composed(first, *rest):
    out = first
    for t in rest:
        out = Composed(out, t)
    return out


def best_path(t, symbols: list[Symbol]) -> tuple[float, list[Symbol]] | None:
    """(weight, symbols handed on) of the path of most weight, of several the first found; None if no path is final."""
    paths: dict[object, tuple[float, tuple | None]] = {t.start: (0.0, None)}
    for x in symbols:
        after: dict[object, tuple[float, tuple | None]] = {}
        for state, (weight, back) in paths.items():
            for n, y, w in t.step(state, x):
                old = after.get(n)
                if old is None or weight + w > old[0]:
                    after[n] = (weight + w, (back, y))
        paths = after
    ends = [v for state, v in paths.items() if t.final(state)]
    if not ends:
        return None
    weight, back = max(ends, key=lambda v: v[0])
    out = []
    while back is not None:
        back, y = back
        out.append(y)
    return weight, out[::-1]


def all_paths(t, symbols: list[Symbol]) -> Iterator[tuple[float, tuple[Symbol, ...]]]:
    """Every path's weight and symbols, for tests."""
    stack = [(t.start, 0, 0.0, ())]
    while stack:
        state, k, weight, out = stack.pop()
        if k == len(symbols):
            if t.final(state):
                yield weight, out
            continue
        stack += [(n, k + 1, weight + w, (*out, y)) for n, y, w in t.step(state, symbols[k])]
