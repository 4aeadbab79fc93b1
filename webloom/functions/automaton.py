"""Which of many strings stand in which of many texts: one Aho-Corasick automaton as arrays, run over a whole batch.

A batch of texts is laid end to end and cut into blocks that overlap by the
longest string; all blocks take a step at once, so that the work is one array
operation for each place in a block, whatever the number of strings and of texts.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

try:  # the parsed form of an expression; without it every expression is tried on every text
    from re import _constants as _op
    from re import _parser
except ImportError:
    _op = _parser = None

BLOCK = 1024
#: Bytes of text that are held as states at a time; a longer text is taken in pieces of this size.
SLICE = 4_000_000
#: The letters outside ASCII that an expression without case takes for k, s and i.
FOLDED = {"\u212a": "k", "\u017f": "s", "\u0130": "i", "\u0131": "i"}
_GAP = 0xFF  # in no text in UTF-8


def required_strings(pattern: str, least: int = 2) -> tuple[str, ...]:
    """Lower-case ASCII strings of which every match of pattern, in any case, holds one; none if none can be named.

    Of the parts that each match must hold, the one whose shortest string is longest
    is taken. Strings shorter than least are not worth a look and count as none.
    """
    if _parser is None:
        return ()
    found = _best(_parser.parse(pattern))
    return tuple(sorted(found)) if found and min(map(len, found)) >= least else ()


def _best(parts) -> set[str]:
    every: list[set[str]] = []
    run = ""
    for op, value in [*parts, (None, None)]:
        if op is _op.LITERAL and value < 128:
            run += chr(value).lower()
            continue
        if run:
            every.append({run})
            run = ""
        if op is _op.SUBPATTERN:
            every.append(_best(value[3]))
        elif op in (_op.MAX_REPEAT, _op.MIN_REPEAT) and value[0] > 0:
            every.append(_best(value[2]))
        elif op is _op.BRANCH:
            sides = [_best(side) for side in value[1]]
            every.append(set().union(*sides) if all(sides) else set())
    return max(every, key=lambda s: (min(map(len, s), default=0), -len(s)), default=set())


def folded(text: str) -> bytes:
    """text in UTF-8, with the letters of FOLDED as ASCII; A-Z are folded by the automaton itself."""
    data = text.encode("utf-8", "surrogatepass")
    if not text.isascii():
        for letter, plain in FOLDED.items():
            data = data.replace(letter.encode(), plain.encode())
    return data


class Automaton:
    """Strings (ASCII, found in any case) as tables: kind of each byte, next state by state and kind, strings by state."""

    def __init__(self, strings: Sequence[str]):
        self.strings = list(strings)
        words = [s.lower().encode("ascii") for s in self.strings]
        if not all(words):
            raise ValueError("an empty string stands in every text")
        letters = sorted(set(b"".join(words)))
        self.width = len(letters) + 1
        kind = np.zeros(256, np.int32)
        kind[letters] = np.arange(1, self.width)
        kind[65:91] = kind[97:123]
        self.kind = kind
        self.longest = max(map(len, words), default=0)
        # the tree of all strings, then what follows where the tree ends, level by level
        nodes: list[dict[int, int]] = [{}]
        own: list[list[int]] = [[]]
        for number, word in enumerate(words):
            at = 0
            for byte in word:
                if byte not in nodes[at]:
                    nodes[at][byte] = len(nodes)
                    nodes.append({})
                    own.append([])
                at = nodes[at][byte]
            own[at].append(number)
        step = np.zeros((len(nodes), self.width), np.int32)
        back = np.zeros(len(nodes), np.int64)
        level = [0]
        while level:
            after = []
            for node in level:
                step[node] = step[back[node]] if node else 0
                for byte, child in nodes[node].items():
                    back[child] = step[back[node], kind[byte]] if node else 0
                    own[child] = own[child] + own[back[child]]
                    step[node, kind[byte]] = child
                    after.append(child)
            level = after
        self.step = (step * self.width).ravel()
        self.ends = np.cumsum([0, *map(len, own)])
        self.found = np.array([n for each in own for n in each], np.int64)
        self.final = np.diff(self.ends) > 0

    def pairs(self, texts: Sequence[str]) -> np.ndarray:
        """(text, string) numbers, each pair once, in order: where a string stands in a text."""
        if not self.strings:
            return np.empty((0, 2), np.int64)
        out, held, size, first = [], [], 0, 0
        for n, text in enumerate(texts):
            held.append(folded(text))
            size += len(held[-1]) + 1
            if size >= SLICE or n == len(texts) - 1:
                out.append(self._slice(held, first))
                held, size, first = [], 0, n + 1
        keys = np.unique(np.concatenate(out)) if out else np.empty(0, np.int64)
        return np.stack(np.divmod(keys, len(self.strings)), axis=1)

    def _slice(self, held: list[bytes], first: int) -> np.ndarray:
        """text * strings + string for each pair, texts counted from first."""
        starts = np.cumsum([0, *[len(h) + 1 for h in held]])
        data = np.frombuffer(bytes([_GAP]).join(held), np.uint8)
        out = [np.empty(0, np.int64)]
        for begin in range(0, len(data), SLICE):
            begun = max(begin - self.longest, 0)
            at, state = self._run(data[begun : begin + SLICE])
            count = self.ends[state + 1] - self.ends[state]
            which = np.repeat(self.ends[state] - np.cumsum(count) + count, count) + np.arange(count.sum())
            text = np.searchsorted(starts, at + begun, side="right") - 1 + first
            out.append(np.unique(np.repeat(text, count) * len(self.strings) + self.found[which]))
        return np.concatenate(out)

    def _run(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, state) wherever a string ends in data; the blocks' overlaps give some of them twice."""
        lead = self.longest - 1
        blocks = -(-len(data) // BLOCK)
        whole = np.full(lead + blocks * BLOCK, _GAP, np.uint8)
        whole[lead : lead + len(data)] = data
        # a row a place, a column a block: block b reads from lead bytes before its own
        rows = np.lib.stride_tricks.as_strided(whole, (lead + BLOCK, blocks), (1, BLOCK))
        kinds = self.kind[rows]
        state = np.zeros(blocks, np.int32)
        states = np.empty((lead + BLOCK, blocks), np.int32)
        for i in range(lead + BLOCK):
            state = self.step[state + kinds[i]]
            states[i] = state
        states //= self.width
        place, block = np.nonzero(self.final[states])
        at = block * BLOCK + place - lead
        return at, states[place, block]
