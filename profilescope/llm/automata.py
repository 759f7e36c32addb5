"""Minimised acceptors of word lists, and the pairs that a one-edit transducer between two of them accepts."""

from __future__ import annotations

from collections.abc import Iterator

Pair = tuple[int, int]


class Acceptor:
    """The minimal deterministic acyclic automaton of sorted distinct words, which also numbers them.

    Built word by word (Daciuk et al., "Incremental construction of minimal acyclic finite-state automata", 2000): what
    the next word shares no more is frozen, and states with equal endings become one. States are numbered so that arcs
    lead to lower numbers; ``root`` has the highest. A word's number is its place in the list, the sum of the
    offsets of the arcs on its path.
    """

    def __init__(self, words: list[str]) -> None:
        self.final: list[bool] = []
        self.arcs: list[dict[str, tuple[int, int]]] = []  # by character: state, offset
        self.size: list[int] = []  # words from each state
        known: dict[tuple, int] = {}
        path: list[list] = [[False, []]]  # of the last word: final, arcs as (character, state)
        last = ""

        def freeze(down_to: int) -> None:
            while len(path) > down_to + 1:
                final, arcs = path.pop()
                path[-1][1].append((last[len(path) - 1], self._state(known, final, arcs)))

        for word in words:
            shared, end = 0, min(len(last), len(word))
            while shared < end and last[shared] == word[shared]:
                shared += 1
            freeze(shared)
            path.extend([False, []] for _ in range(len(word) - shared))
            path[-1][0] = True
            last = word
        freeze(0)
        self.root = self._state({}, *path[0])

    def _state(self, known: dict[tuple, int], final: bool, arcs: list[tuple[str, int]]) -> int:
        key = (final, tuple(arcs))
        if (state := known.get(key)) is None:
            state = known[key] = len(self.final)
            offset, numbered = int(final), {}
            for character, target in arcs:
                numbered[character] = (target, offset)
                offset += self.size[target]
            self.final.append(final), self.arcs.append(numbered), self.size.append(offset)
        return state

    def reached(self) -> list[list[int]]:
        """For each state the numbers that paths from the root to it add up to."""
        starts: list[list[int]] = [[] for _ in self.final]
        starts[self.root].append(0)
        for state in range(self.root, -1, -1):
            for target, offset in self.arcs[state].values():
                starts[target].extend([x + offset for x in starts[state]])
        return starts


class OneEdit:
    """An acceptor composed with the one-edit transducer and the acceptor again.

    The transducer copies characters in its first state, replaces one or leaves one out on the way to the second, and
    copies again there. (Inserting is leaving out, seen from the other word.) The composition's states are (state,
    edited, state). Unedited, both sides have read the same word and are in the same state; edited, they accept what
    both states accept, which is looked up by pairs of states once.
    """

    def __init__(self, acceptor: Acceptor) -> None:
        self.a = acceptor
        self._common: dict[Pair, list[Pair]] = {}

    def common(self, left: int, right: int) -> list[Pair]:
        """Numbers, counted from either state, of the endings that both accept: the edited states."""
        a, known, open_ = self.a, self._common, [(left, right)]
        while open_:
            pair = open_[-1]
            if pair in known:
                open_.pop()
                continue
            p, q = pair
            if p == q:
                known[pair] = [(i, i) for i in range(a.size[p])]
                continue
            p_arcs, q_arcs = a.arcs[p], a.arcs[q]
            shared = [c for c in p_arcs if c in q_arcs]
            missing = [x for c in shared if (x := (p_arcs[c][0], q_arcs[c][0])) not in known]
            if missing:
                open_.extend(missing)
                continue
            found = [(0, 0)] if a.final[p] and a.final[q] else []
            for c in shared:
                (p_to, p_off), (q_to, q_off) = p_arcs[c], q_arcs[c]
                found += [(p_off + i, q_off + j) for i, j in known[p_to, q_to]]
            known[pair] = found
        return known[left, right]

    def edits(self, state: int) -> Iterator[Pair]:
        """Pairs of endings accepted from (state, unedited, state) whose first difference is right here."""
        a = self.a
        arcs = list(a.arcs[state].items())
        for n, (c, (target, offset)) in enumerate(arcs):
            for _, (other, other_offset) in arcs[n + 1 :]:  # replace
                for i, j in self.common(target, other):
                    yield offset + i, other_offset + j
            if a.final[state] and a.final[target]:  # leave out the last one
                yield offset, 0
            for d, (other, other_offset) in arcs:  # leave out, so that the next one differs from it
                if d != c and (after := a.arcs[target].get(d)):
                    for i, j in self.common(after[0], other):
                        yield offset + after[1] + i, other_offset + j

    def pairs(self) -> Iterator[Pair]:
        """Every pair of words one edit apart, once, as their numbers."""
        for state, starts in enumerate(self.a.reached()):
            here = list(self.edits(state))
            for start in starts if here else ():
                for i, j in here:
                    yield start + i, start + j
