"""Probabilistic automata inferred from strings by merging prefix-tree states.

Frequencies sit on the states and transitions of a prefix tree.  Breadth
first by count, each fringe state is compared with the states accepted so
far; where stopping and continuing frequencies agree within Hoeffding's
bound, all the way down, the two are merged and their subtrees folded,
otherwise the state is accepted as new.  Strings are seen as character
classes.
"""

from __future__ import annotations

import math

#: Character -> class; anything else is its own class.
_CLASSES = {**{c: "0" for c in "0123456789"}, **{c: "a" for c in "abcdef"}, **{c: "g" for c in "ghijklmnopqrstuvwxyz"},
            **{c: "A" for c in "ABCDEF"}, **{c: "G" for c in "GHIJKLMNOPQRSTUVWXYZ"}}
_TABLE = str.maketrans(_CLASSES)
#: States with fewer arrivals say too little to keep two states apart.
MIN_ARRIVALS = 12
ALPHA = 0.01
#: Probability of what a state has never seen.
UNSEEN = 1e-4


def shape(text: str) -> str:
    """The string's character classes."""
    return text.translate(_TABLE)


class _State:
    __slots__ = ("arrivals", "stops", "next")

    def __init__(self):
        self.arrivals, self.stops, self.next = 0, 0, {}


def _prefix_tree(shapes: list[str]) -> _State:
    root = _State()
    for s in shapes:
        state = root
        state.arrivals += 1
        for c in s:
            state = state.next.setdefault(c, _State())
            state.arrivals += 1
        state.stops += 1
    return root


def _differ(f1: int, n1: int, f2: int, n2: int, alpha: float) -> bool:
    return abs(f1 / n1 - f2 / n2) >= math.sqrt(0.5 * math.log(2 / alpha)) * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))


def _compatible(a: _State, b: _State, alpha: float) -> bool:
    todo, met = [(a, b)], set()
    while todo:
        a, b = todo.pop()
        if (id(a), id(b)) in met or min(a.arrivals, b.arrivals) < MIN_ARRIVALS:
            continue
        met.add((id(a), id(b)))
        if _differ(a.stops, a.arrivals, b.stops, b.arrivals, alpha):
            return False
        for c in a.next.keys() | b.next.keys():
            x, y = a.next.get(c), b.next.get(c)
            if _differ(x.arrivals if x else 0, a.arrivals, y.arrivals if y else 0, b.arrivals, alpha):
                return False
            if x and y:
                todo.append((x, y))
    return True


def _fold(into: _State, tree: _State) -> None:
    todo = [(into, tree)]
    while todo:
        a, b = todo.pop()
        a.arrivals += b.arrivals
        a.stops += b.stops
        for c, y in b.next.items():
            if c in a.next:
                todo.append((a.next[c], y))
            else:
                a.next[c] = y


class Automaton:
    """Plain tables of an inferred automaton (picklable)."""

    def __init__(self, shapes: list[str], alpha: float = ALPHA):
        root = _prefix_tree(sorted(shapes))
        accepted = [root]
        while True:
            known = {id(s) for s in accepted}
            fringe = [(-y.arrivals, i, c) for i, s in enumerate(accepted) for c, y in s.next.items() if id(y) not in known]
            if not fringe:
                break
            _, i, c = min(fringe)
            state = accepted[i].next[c]
            for s in accepted:
                if _compatible(s, state, alpha):
                    accepted[i].next[c] = s
                    _fold(s, state)
                    break
            else:
                accepted.append(state)
        number = {id(s): i for i, s in enumerate(accepted)}
        # a transition's count is not kept by merged targets, so shares come from a replay of the strings
        went = [dict.fromkeys(s.next, 0) for s in accepted]
        stops, arrivals = [0] * len(accepted), [0] * len(accepted)
        for text in shapes:
            s = 0
            for c in text:
                arrivals[s] += 1
                went[s][c] += 1
                s = number[id(accepted[s].next[c])]
            arrivals[s] += 1
            stops[s] += 1
        self.next = [{c: number[id(y)] for c, y in s.next.items()} for s in accepted]
        self.log_step = [{c: math.log(n / max(1, arrivals[i])) if n else math.log(UNSEEN) for c, n in w.items()}
                         for i, w in enumerate(went)]
        self.log_stop = [math.log(max(n / max(1, arrivals[i]), UNSEEN)) for i, n in enumerate(stops)]

    def log_likelihood(self, text: str) -> float:
        """Log-probability of a string of classes."""
        s, total, unseen = 0, 0.0, math.log(UNSEEN)
        for c in text:
            step = self.log_step[s].get(c)
            if step is None:
                total += unseen
            else:
                total += step
                s = self.next[s][c]
        return total + self.log_stop[s]
