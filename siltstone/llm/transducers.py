"""Deterministic finite-state transducers over token classes, and their composition.

A transducer reads a clause's token classes and writes classes for the next one; a state
may carry a mark, which counts where the clause ends in it.  `compose` builds the product
machine of a chain: one table of states by classes, run once for each token.
"""

from __future__ import annotations

from dataclasses import dataclass

#: Token classes, and the classes that negation and reported speech turn insults into.
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, NEGATED, REPORTED = range(8)
CLASSES = range(8)
#: Tokens after a negation that it covers.
SCOPE = 3


@dataclass(frozen=True)
class Transducer:
    """`arcs[state][class]` is (next state, written class); state 0 starts; `marks[state]` or None."""

    arcs: tuple[tuple[tuple[int, int], ...], ...]
    marks: tuple[str | None, ...]


def machine(states: int, step, mark) -> Transducer:
    """A transducer from functions of (state, class) and of state."""
    return Transducer(tuple(tuple(step(s, c) for c in CLASSES) for s in range(states)), tuple(mark(s) for s in range(states)))


def negation() -> Transducer:
    """States count the tokens that a negation still covers; a covered insult becomes a negated one."""
    def step(state, c):
        after = SCOPE if c == NEGATION else max(0, state - 1)
        return after, NEGATED if c == INSULT and state else c

    return machine(SCOPE + 1, step, lambda s: None)


def reported_speech() -> Transducer:
    """After a verb of speech, insults are reported ones."""
    def step(state, c):
        return state or int(c == REPORT), REPORTED if state and c in (INSULT, NEGATED) else c

    return machine(2, step, lambda s: None)


def insult() -> Transducer:
    """Remembers the gravest insult: plain, then negated, then reported."""
    grave = {INSULT: 3, NEGATED: 2, REPORTED: 1}
    return machine(4, lambda s, c: (max(s, grave.get(c, 0)), c), lambda s: (None, "reported", "negated", "plain")[s])


def threat() -> Transducer:
    return machine(2, lambda s, c: (int(s or c == THREAT), c), lambda s: "threat" if s else None)


def target() -> Transducer:
    return machine(2, lambda s, c: (int(s or c == TARGET), c), lambda s: "target" if s else None)


def compose(*chain: Transducer) -> tuple[list[list[int]], list[frozenset[str]]]:
    """(next state by state and class, marks by state) of the chain's reachable product states; 0 starts."""
    start = (0,) * len(chain)
    number, order, table = {start: 0}, [start], []
    for states in order:  # grows while it is read
        row = []
        for c in CLASSES:
            after = []
            for transducer, state in zip(chain, states, strict=True):
                state, c = transducer.arcs[state][c]
                after.append(state)
            after = tuple(after)
            if after not in number:
                number[after] = len(order)
                order.append(after)
            row.append(number[after])
        table.append(row)
    marks = [frozenset(t.marks[s] for t, s in zip(chain, states, strict=True)) - {None} for states in order]
    return table, marks
