"""Suffix arrays of many short texts at once, by linear grouping construction.

Phase one puts suffixes into groups by their Lyndon prefix. Groups start as first symbols and are
processed in descending order: each suffix of a group gets a pointer to the nearest earlier position
of a lower group (the previous smaller one), found by following pointers of higher groups; positions
pointed to by the same number of suffixes are split off their group and put behind it, since their
prefix now extends by that many copies of the group's. Phase two emits the groups in ascending order:
suffixes of one group share their Lyndon prefix, so they are ordered by what follows it, which lies in
a lower group and has its place already. Nothing is renamed and no step repeats on a reduced text.

The texts are lanes of one array: pointers never leave a lane, and each step works on the current group
of every lane, so its cost is that of the members, shared over lanes.
"""

from __future__ import annotations

import numpy as np


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ranges ``starts[k] .. starts[k] + sizes[k]`` after each other."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


class _Lanes:
    """Positions count from 1; position 0 and the last of the lane before stand for no pointer."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray):
        n = len(symbols)
        self.ends = np.cumsum(lengths) + 1
        self.bases = self.ends - lengths
        lane = np.repeat(np.arange(len(lengths)), lengths)
        order = np.argsort(lane * (int(symbols.max(initial=0)) + 1) + symbols, kind="stable")
        self.order = np.concatenate([[0], order + 1])
        self.place = np.empty(n + 1, np.int64)
        self.place[self.order] = np.arange(n + 1)
        new = np.ones(n + 1, bool)
        new[2:] = (symbols[order[1:]] != symbols[order[:-1]]) | (lane[order[1:]] != lane[order[:-1]])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, n + 1))
        self.size = np.zeros(n + 2, np.int64)
        self.size[starts] = sizes
        self.group = np.empty(n + 1, np.int64)
        self.group[self.order] = np.repeat(starts, sizes)
        self.group[0] = -1
        self.prefix = np.ones(n + 1, np.int64)  # length of the Lyndon prefix so far

    def form_groups(self) -> None:
        order, place, group, size, prefix = self.order, self.place, self.group, self.size, self.prefix
        pointer = np.zeros(len(group), np.int64)
        local = np.zeros(len(group), np.int64)
        marked = np.zeros(len(group), bool)
        base, end = self.bases.copy(), self.ends.copy()
        while len(end):
            start = group[order[end - 1]]
            sizes = end - start
            members = order[_ragged(start, sizes)]
            g = np.repeat(start, sizes)
            # previous smaller: over pointers of higher groups, then over members of the same group
            at = members - 1
            far = np.flatnonzero(group[at] > g)
            while len(far):
                at[far] = pointer[at[far]]
                far = far[group[at[far]] > g[far]]
            same = np.flatnonzero(group[at] == g)
            if len(same):
                local[members] = np.arange(len(members))
                up = np.arange(len(members))
                up[same] = local[at[same]]
                while True:
                    further = up[up]
                    if np.array_equal(further, up):
                        break
                    up = further
                at = at[up]
            pointer[members] = at
            inside = at >= np.repeat(base, sizes)
            if inside.any():
                self._split(at[inside], prefix[members[inside]], marked)
            live = start > base
            base, end = base[live], start[live]

    def _split(self, pointed: np.ndarray, lengths: np.ndarray, marked: np.ndarray) -> None:
        """Takes the positions pointed to out of their groups: by group, then by the number of pointers."""
        order, place, group, size = self.order, self.place, self.group, self.size
        by = np.argsort(pointed, kind="stable")
        pointed, lengths = pointed[by], lengths[by]
        first = np.flatnonzero(np.diff(pointed, prepend=-1))
        times = np.diff(np.append(first, len(pointed)))
        p = pointed[first]
        self.prefix[p] += times * lengths[first]
        old = group[p]
        by = np.lexsort((times, old))
        p, times, old = p[by], times[by], old[by]
        run = np.flatnonzero(np.diff(old, prepend=-1))
        moved = np.diff(np.append(run, len(p)))
        g = old[run]
        tail = g + size[g] - moved
        to = _ragged(tail, moved)
        now = place[p]
        holes = now[now < np.repeat(tail, moved)]
        if len(holes):
            marked[p] = True
            there = order[to]
            there = there[~marked[there]]
            marked[p] = False
            order[holes] = there
            place[there] = holes
        order[to] = p
        place[p] = to
        size[g] -= moved
        new = np.flatnonzero((np.diff(old, prepend=-1) != 0) | (np.diff(times, prepend=-1) != 0))
        sizes = np.diff(np.append(new, len(p)))
        size[to[new]] = sizes
        group[p] = np.repeat(to[new], sizes)

    def emit(self) -> None:
        order, place, group, prefix = self.order, self.place, self.group, self.prefix
        starts = np.unique(group[1:])
        sizes = self.size[starts]
        starts, sizes = starts[sizes > 1], sizes[sizes > 1]
        lane = np.searchsorted(self.bases, starts, side="right")
        turn = np.arange(len(starts)) - np.searchsorted(lane, lane)  # the group's number in its lane
        by = np.argsort(turn, kind="stable")
        starts, sizes, turn = starts[by], sizes[by], turn[by]
        cuts = np.flatnonzero(np.diff(turn, prepend=-1))
        for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(turn)).tolist()):
            slots = _ragged(starts[a:b], sizes[a:b])
            members = order[slots]
            g = group[members]
            after, copies = members + prefix[members], np.ones(len(members), np.int64)
            still = np.flatnonzero(group[after] == g)
            while len(still):  # what follows begins with the same prefix again
                after[still] += prefix[members[still]]
                copies[still] += 1
                still = still[group[after[still]] == g[still]]
            by = np.lexsort((place[after], copies, g))
            order[slots] = members[by]
            place[order[slots]] = slots


def suffix_order(symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of ``symbols``, a concatenation of lanes of ``lengths``, sorted by suffix within each
    lane. A lane must end with its smallest symbol, which it has once."""
    if not len(symbols):
        return np.zeros(0, np.int64)
    lanes = _Lanes(np.asarray(symbols, np.int64), np.asarray(lengths, np.int64))
    lanes.form_groups()
    lanes.emit()
    return lanes.order[1:] - 1
