"""Weighted acyclic automata over words: phrases as paths, counts as the weights of their last arcs."""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator, Sequence
from itertools import repeat

Phrase = tuple[bytes, ...]
#: (word, weight, state): an arc with a weight ends a phrase; weight 0 is a prefix only.
Arc = tuple[bytes, int, int]


def _close(path: list[list[Arc]], depth: int, states: list[tuple[Arc, ...]], known: dict[tuple[Arc, ...], int]) -> None:
    """Close the open states below ``depth``, each as a new state or as an earlier one with the same arcs."""
    while len(path) > depth + 1:
        arcs = tuple(path.pop())
        state = known.get(arcs)
        if state is None:
            state = known[arcs] = len(states)
            states.append(arcs)
        word, weight, _ = path[-1][-1]
        path[-1][-1] = (word, weight, state)


class CountAutomaton:
    """A minimal acyclic automaton whose arcs count the phrases that end with them.

    It is built from sorted phrases, one at a time: when a phrase leaves the path of the
    one before, the states behind the fork are closed, and a closed state with the same arcs as an
    earlier one is that state. State 0 is the common end without arcs; the last state
    is the start.
    """

    def __init__(self, states: list[tuple[Arc, ...]] | None = None) -> None:
        self.states = states or [()]

    @classmethod
    def build(cls, counted: Iterable[tuple[Phrase, int]]) -> CountAutomaton:
        """From distinct phrases of one word or more, in ascending order of their words."""
        return cls.build_runs((phrase[:-1], phrase[-1:], (count,)) for phrase, count in counted)

    @classmethod
    def build_runs(cls, runs: Iterable[tuple[Phrase, Sequence[bytes], Sequence[int]]]) -> CountAutomaton:
        """The same from runs: neighbours that differ in their last words only, as (words before, last words, counts)."""
        states: list[tuple[Arc, ...]] = [()]
        known: dict[tuple[Arc, ...], int] = {(): 0}
        # The open path: arcs of each open state; the last arc of each leads to the next open state.
        path: list[list[Arc]] = [[]]
        before: Phrase = ()
        for prefix, words, counts in runs:
            same = 0
            for a, b in zip(before, prefix):
                if a != b:
                    break
                same += 1
            _close(path, same, states, known)
            for word in prefix[same:]:
                path[-1].append((word, 0, 0))
                path.append([])
            path[-1] += zip(words, counts, repeat(0))
            path.append([])
            before = (*prefix, words[-1])
        _close(path, 0, states, known)
        states.append(tuple(path[0]))
        return cls(states)

    def items(self) -> Iterator[tuple[Phrase, int]]:
        """All phrases with a weight, in order."""
        todo: list[tuple[Phrase, int, int]] = [((), 0, len(self.states) - 1)]
        while todo:
            phrase, weight, state = todo.pop()
            if weight:
                yield phrase, weight
            todo += [((*phrase, word), w, s) for word, w, s in reversed(self.states[state])]

    @classmethod
    def union(cls, sums: dict[Phrase, int], least: int = 1) -> CountAutomaton:
        """Of what ``add_to`` has summed: phrases of ``least`` or more."""
        return cls.build(sorted((p, w) for p, w in sums.items() if w >= least))

    def add_to(self, sums: dict[Phrase, int]) -> None:
        """Add the weights of this automaton to those of others."""
        states, held = self.states, sums.get
        todo: list[tuple[Phrase, int]] = [((), len(states) - 1)]
        while todo:
            before, state = todo.pop()
            for word, weight, following in states[state]:
                phrase = (*before, word)
                if weight:
                    sums[phrase] = held(phrase, 0) + weight
                if following:
                    todo.append((phrase, following))

    def compose(self, wanted: CountAutomaton) -> Iterator[tuple[Phrase, int]]:
        """Phrases of both, in order, with the weights of this one: both are walked side by side."""
        todo: list[tuple[Phrase, int, int, int]] = [((), 0, len(self.states) - 1, len(wanted.states) - 1)]
        while todo:
            phrase, weight, mine, other = todo.pop()
            if weight:
                yield phrase, weight
            arcs = {word: (w, s) for word, w, s in self.states[mine]}
            for word, asked, state in reversed(wanted.states[other]):
                if word in arcs:
                    weight, next_state = arcs[word]
                    todo.append(((*phrase, word), weight if asked else 0, next_state, state))

    def to_bytes(self) -> bytes:
        return pickle.dumps(self.states, protocol=5)

    @classmethod
    def from_bytes(cls, data: bytes) -> CountAutomaton:
        return cls(pickle.loads(data))
