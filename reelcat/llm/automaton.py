"""One deterministic automaton for many rules, compiled from their regexes.

Each rule's regex becomes a nondeterministic automaton; subset construction over
all rules together gives states that hold, for every rule, its threads in order of
preference (leftmost match, then as a backtracking matcher would choose).  States
are minimised and laid out as one transition array over bytes.  A rule whose match
ends is reported with the transition and starts anew, so the matches of each rule
come out leftmost and without overlap in one pass over the bytes of all rules.

Rules may use literals, classes, groups, alternatives and greedy repeats, over
ASCII.  A match must end where its last possible end is reached (no rule may look
further and then give up); others are refused when compiled.
"""

from __future__ import annotations

import re._parser as parser
from dataclasses import dataclass
from re import IGNORECASE

import numpy as np

MATCH = -1
ENDS = 1 << 24


@dataclass(frozen=True)
class Rule:
    """``least``: least length in bytes of a match without its ``head`` (a regex for what stands before the value)."""

    kind: str
    regex: str
    least: int = 1
    head: str = ""


class Threads:
    """A regex as a nondeterministic automaton; backwards if ``reverse``."""

    def __init__(self, regex: str, reverse: bool = False):
        self.takes: list[frozenset[int] | None] = []  # the bytes a state takes; None: it only leads on
        self.to: list[list[int]] = []  # in order of preference
        self.reverse = reverse
        tree = parser.parse(regex)
        self.start = self._build(tree, MATCH, bool(tree.state.flags & IGNORECASE))

    def _state(self, takes, to) -> int:
        self.takes.append(takes)
        self.to.append(to)
        return len(self.to) - 1

    def _build(self, items, after: int, fold: bool) -> int:
        for op, what in list(items) if self.reverse else reversed(list(items)):
            after = self._one(str(op), what, after, fold)
        return after

    def _one(self, op: str, what, after: int, fold: bool) -> int:
        if op == "LITERAL":
            return self._bytes({what}, after, fold)
        if op == "IN":
            chars: set[int] = set()
            for kind, x in what:
                if str(kind) == "RANGE":
                    chars.update(range(x[0], x[1] + 1))
                elif str(kind) == "LITERAL":
                    chars.add(x)
                else:
                    raise ValueError(f"not supported in a class: {kind}")
            return self._bytes(chars, after, fold)
        if op == "SUBPATTERN":
            return self._build(what[3], after, (fold or bool(what[1] & IGNORECASE)) and not what[2] & IGNORECASE)
        if op == "BRANCH":
            return self._state(None, [self._build(x, after, fold) for x in what[1]])
        if op == "MAX_REPEAT":
            least, most, inner = what
            if most == parser.MAXREPEAT:
                loop = self._state(None, [])
                self.to[loop] += [self._build(inner, loop, fold), after]
                after = loop
            else:
                for _ in range(most - least):
                    after = self._state(None, [self._build(inner, after, fold), after])
            for _ in range(least):
                after = self._build(inner, after, fold)
            return after
        raise ValueError(f"not supported: {op}")

    def _bytes(self, chars: set[int], after: int, fold: bool) -> int:
        if fold:
            chars = chars | {x ^ 32 for x in chars if chr(x).isascii() and chr(x).isalpha()}
        if max(chars) > 127:
            raise ValueError("rules are over ASCII")
        return self._state(frozenset(chars), [after])

    def closure(self, states) -> tuple[int, ...]:
        """States that take a byte, or MATCH, in order; nothing is preferred less than a match."""
        out, seen, stack = [], set(), list(reversed(list(states)))
        while stack:
            s = stack.pop()
            if s in seen:
                continue
            seen.add(s)
            if s == MATCH:
                out.append(s)
                break
            if self.takes[s] is None:
                stack.extend(reversed(self.to[s]))
            else:
                out.append(s)
        return tuple(out)

    def step(self, states, byte: int) -> list[int]:
        return [self.to[s][0] for s in states if s != MATCH and byte in self.takes[s]]

    def farthest(self, data, at: int, stop: int) -> int | None:
        """The farthest end of a match that begins at ``at`` (to the left if reversed, not beyond ``stop``)."""
        states = self.closure_all([self.start])
        best = at if MATCH in states else None
        while states and at != stop:
            byte = data[at - 1] if self.reverse else data[at]
            at += -1 if self.reverse else 1
            states = self.closure_all(self.step(states, byte))
            if MATCH in states:
                best = at
        return best

    def closure_all(self, states) -> frozenset[int]:
        """As closure, of all threads."""
        seen, stack = set(), list(states)
        while stack:
            s = stack.pop()
            if s not in seen:
                seen.add(s)
                if s != MATCH and self.takes[s] is None:
                    stack.extend(self.to[s])
        return frozenset(s for s in seen if s == MATCH or self.takes[s] is not None)


def _advance(rule: Threads, state: tuple, byte: int) -> tuple[tuple, bool]:
    """(threads, has matched) after a byte, and whether the match ended before that byte."""
    threads, matched = state
    after = rule.closure(rule.step(threads, byte))
    if matched and not after:
        return _advance(rule, (rule.closure([rule.start]), False), byte)[0], True
    if matched and MATCH not in after:
        raise ValueError("a rule goes on after its match and may still fail")
    if MATCH in after:
        return (after, True), False
    begin = rule.closure([rule.start])
    return (tuple(dict.fromkeys(after + begin)), False), False


def minimised(to: np.ndarray, out: np.ndarray) -> np.ndarray:
    """The class of each state: equal outputs and equivalent successors."""
    group = np.zeros(len(to), np.int64)
    while True:
        told = np.hstack([group[:, None], group[to], out])
        _, after = np.unique(told, axis=0, return_inverse=True)
        after = after.reshape(-1)
        if after.max() == group.max():
            return after
        group = after


class Automaton:
    """``table[state << 8 | byte]``: next state, plus ENDS if matches end before that byte; ``ends`` has their rules as bits."""

    def __init__(self, rules: list[Rule]):
        nets = [Threads(r.regex) for r in rules]
        if any(MATCH in n.closure([n.start]) for n in nets):
            raise ValueError("a rule matches nothing at all")
        sets = [t for n in nets for t in n.takes if t]
        alike: dict[tuple, int] = {}
        of_byte = np.array([alike.setdefault(tuple(b in s for s in sets), len(alike)) for b in range(256)])
        sample = [int(np.flatnonzero(of_byte == k)[0]) for k in range(len(alike))]
        first = tuple((n.closure([n.start]), False) for n in nets)
        number, order, to, out = {first: 0}, [first], [], []
        for state in order:
            row, said = [], []
            for byte in sample:
                moved = [_advance(n, s, byte) for n, s in zip(nets, state)]
                after = tuple(m[0] for m in moved)
                if after not in number:
                    number[after] = len(order)
                    order.append(after)
                row.append(number[after])
                said.append(sum(m[1] << k for k, m in enumerate(moved)))
            to.append(row)
            out.append(said)
        to, out = np.array(to), np.array(out)
        group = minimised(to, out)
        _, keep = np.unique(group, return_index=True)
        renumber = np.argsort(np.argsort(np.where(np.arange(len(keep)) == group[0], -1, np.arange(len(keep)))))
        small_to, small_out = np.empty((len(keep), to.shape[1]), np.int64), np.empty((len(keep), to.shape[1]), np.int64)
        small_to[renumber], small_out[renumber] = renumber[group[to[keep]]], out[keep]
        self.n_states = len(keep)
        self.ends = small_out[:, of_byte].reshape(-1)
        self.table = (small_to[:, of_byte].reshape(-1) + np.where(self.ends > 0, ENDS, 0)).astype(np.int32)
        #: bytes after which every state is the first one
        self.resets = np.flatnonzero((small_to == 0).all(axis=0)[of_byte])
        if not len(self.resets):
            raise ValueError("no byte ends all rules")

    def scan(self, data: np.ndarray, lane: int = 2048) -> tuple[np.ndarray, np.ndarray]:
        """(position before which matches end, rules as bits), in order; ``data`` ends with a reset byte.

        The bytes are cut behind reset bytes into lanes of about equal length, which
        go through the transition array side by side.
        """
        is_reset = np.zeros(256, bool)
        is_reset[self.resets] = True
        cuts = np.flatnonzero(is_reset[data]) + 1
        ends = np.unique(cuts[np.searchsorted(cuts, np.arange(lane, len(data) + lane, lane).clip(max=len(data)))])
        starts = np.concatenate([[0], ends[:-1]])
        order = np.argsort(starts - ends, kind="stable")
        starts, long = starts[order], (ends - starts)[order]
        state = np.zeros(len(starts), np.int32)
        at, said = [], []
        active = np.searchsorted(-long, -np.arange(int(long[0]) if len(long) else 0), side="left")
        for t, m in enumerate(active.tolist()):
            place = starts[:m] + t
            key = (state[:m] << 8) | data[place]
            after = self.table[key]
            if after.max() >= ENDS:
                found = np.flatnonzero(after >= ENDS)
                at.append(place[found])
                said.append(self.ends[key[found]])
                after &= ENDS - 1
            state[:m] = after
        if not at:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at, said = np.concatenate(at), np.concatenate(said)
        order = np.argsort(at, kind="stable")
        return at[order], said[order]
