"""Byte-pair encoding by dynamic programming over prefixes.

A merge-order BPE has a property that makes greedy merging unnecessary: the encoding of a string ends in exactly one
token that is *valid* there, meaning that it is in the vocabulary, and that it and the last token of the prefix before
it encode, as a pair, to themselves. So one pass that stores the length of each prefix's last token gives the
encoding of every prefix at once. An append carries on from the stored prefixes; an edit starts again at the edit and
ends as soon as the stored lengths agree again over the longest token's length.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Hashable
from itertools import accumulate

import ahocorasick


#: Pairs of tokens that are remembered.
PAIRS = 200_000


class Memo(dict):
    """Results by key, in two generations of bounded size; long keys aren't kept."""

    def __init__(self, make: Callable, limit: int, longest: int = 64):
        super().__init__()
        self.make, self.limit, self.longest, self.old = make, limit, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class PrefixBpe:
    """A vocabulary of tokens (bytes or str) with their merge order: the least is merged first.

    A state is the number of the last token of each prefix, from length 1 on; the numbers index `names`. Number 0
    stands for the start and for single symbols that the vocabulary lacks, which stay alone and never merge.
    """

    def __init__(self, order: dict[Hashable, float], remembered: int = 200_000):
        self.order = order
        self.names = [next(iter(order), "")[:0], *order]
        self.size = [1, *map(len, order)]
        self.longest = max(self.size)
        self.single, self.finder = {}, ahocorasick.Automaton()
        for k, name in enumerate(order, 1):
            if len(name) == 1:
                self.single[_symbols(name)] = k
            else:
                self.finder.add_word(_symbols(name), k)
        self.finder.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.left, self.right = array("i", bytes(4 * len(self.names))), array("i", bytes(4 * len(self.names)))
        self._find_merges()
        self.states: Memo = Memo(lambda text: self.extend(text, array("i")), remembered)

    def merged(self, text) -> list:
        """Plain BPE by merging, for short strings: of equal pairs the leftmost goes first."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            best, at = min((self.order.get(parts[i] + parts[i + 1], float("inf")), i) for i in range(len(parts) - 1))
            if best == float("inf"):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _find_merges(self) -> None:
        """Which two tokens each token is merged from: `left` and `right`. Single symbols have 0 there; tokens that
        merging doesn't give have -1, and are never valid."""
        order, left, right, number = self.order, self.left, self.right, {name: k for k, name in enumerate(self.names) if k}
        self.value = [float("-inf"), *order.values()]
        merges = sorted((name for name in order if len(name) > 1), key=order.get)
        #: Whether each merge has its own place, after those of its parts; else pairs are merged from scratch.
        self.in_turn = len({order[name] for name in merges}) == len(merges)
        done = [len(name) == 1 for name in self.names]
        for name in merges if self.in_turn else []:
            k = number[name]
            cuts = ((number.get(name[:cut], 0), number.get(name[cut:], 0)) for cut in range(1, len(name)))
            left[k], right[k] = next(((a, b) for a, b in cuts if done[a] and done[b] and self.stays(a, b, order[name])), (-1, -1))
            done[k] = True
            if left[k] < 0 and self.merged(name) == [name]:
                self.in_turn = False
                break

    def stays(self, first: int, second: int, ends: float = float("inf")) -> bool:
        """Whether a pair encodes to itself by the merges before `ends`, as merged() would tell: its own merges are
        undone, the last one first, and no two tokens that meet at the border on the way may be merged before one of
        them goes into its next merge."""
        left, right, value, order, names = self.left, self.right, self.value, self.order, self.names
        if not self.in_turn:
            return self.merged(names[first] + names[second]) == [x for x in (names[first], names[second]) if x]
        if left[second] < 0 or left[first] < 0:
            return False
        later = False
        while first:
            met = order.get(names[first] + names[second])
            # Of equal merges the leftmost goes first: the border before the one on its right.
            if met is not None and (met < ends or met == ends and later):
                return False
            if left[second] and (value[second] >= value[first] or not left[first]):
                ends, later, second = value[second], True, left[second]
            elif left[first]:
                ends, later, first = value[first], False, right[first]
            else:
                return True
        return True

    def extend(self, text, last, upto: int | None = None):
        """Carry on a state of a prefix of the text to its end, or to `upto`.

        The longer tokens that end at a place come from one automaton, longest first; if none of them is valid, the
        single symbol is.
        """
        text, single, size, pairs, add = _symbols(text), self.single, self.size, self.pairs, last.append
        count, stays = len(self.names), self.stays
        upto, done = len(text) if upto is None else upto, len(last)
        if len(self.finder):
            for end, token in self.finder.iter(text, max(0, done - self.longest), upto):
                if end >= done:
                    while done < end:
                        add(single.get(text[done], 0))
                        done += 1
                    start = end - size[token]
                    before = last[start] if start >= 0 else 0
                    valid = pairs.get(key := before * count + token)
                    if valid is None:
                        if len(pairs) >= PAIRS:
                            pairs.clear()
                        valid = pairs[key] = stays(before, token)
                    if valid:
                        add(token)
                        done += 1
        for symbol in text[done:upto]:
            add(single.get(symbol, 0))
        return last

    def edit(self, text, last: list[int], start: int, end: int, put) -> tuple:
        """Replace text[start:end]: the new text and its state, of which only what is near the edit is computed."""
        new, out = text[:start] + put + text[end:], last[:start]
        shift, upto = len(new) - len(text), start + len(put)
        while upto < len(new):
            upto = min(upto + self.longest, len(new))
            self.extend(new, out, upto)
            if upto - self.longest >= start + len(put) and out[upto - self.longest :] == last[upto - self.longest - shift : upto - shift]:
                break
        self.extend(new, out, upto)
        return new, out + last[len(out) - shift :]

    def tokens(self, last) -> list[int]:
        """The numbers of the tokens of the whole text of a state."""
        out, at, size = [], len(last), self.size
        while at:
            out.append(last[at - 1])
            at -= size[out[-1]]
        out.reverse()
        return out

    def counts(self, last) -> list[int]:
        """The number of tokens of each prefix, from the empty one on."""
        out = [0]
        for end, token in enumerate(last, 1):
            out.append(out[end - self.size[token]] + 1)
        return out


def _symbols(text) -> str:
    return text.decode("latin-1") if isinstance(text, bytes) else text


def ends(parts: list) -> list[int]:
    """Where each part ends."""
    return list(accumulate(map(len, parts)))
