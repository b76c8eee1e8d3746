"""Suffix arrays of many texts side by side, by linear grouping.

Suffixes are put in groups by the Lyndon word they start with. Groups are gone
through from the highest to the lowest: of each suffix in one, the nearest
earlier suffix in a lower group has a Lyndon word that goes on with the group's,
so it moves into a new group right above its own. A second pass goes upwards: a
suffix that has its final place hands the next free places of their groups to
the suffixes that it follows. No rank is ever renamed.

Numpy does one step of every text at a time, so texts should be of like length.
"""

from __future__ import annotations

import numpy as np

NONE = -1


class Texts:
    """Texts one behind the other; each ends with a symbol that is smaller than all
    its others and occurs once in it."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray) -> None:
        self.symbols = symbols
        self.lengths = np.asarray(lengths, np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths


def suffix_array(texts: Texts) -> np.ndarray:
    """Places of the suffixes of every text, in order, text by text."""
    groups = Groups(texts)
    before = groups.split(texts)
    return groups.emit(texts, before)


class Groups:
    """Suffixes by group: ``order`` lists them, a group lies in one piece of it."""

    def __init__(self, texts: Texts) -> None:
        n = len(texts.symbols)
        text = np.repeat(np.arange(len(texts.lengths)), texts.lengths)
        value = text * (int(texts.symbols.max(initial=0)) + 1) + texts.symbols
        self.order = np.argsort(value, kind="stable")
        self.place = np.empty(n, np.int64)
        self.place[self.order] = np.arange(n)
        told = value[self.order]
        new = np.append(True, told[1:] != told[:-1])[:n]
        heads = np.flatnonzero(new)
        # A text may come to twice as many groups as it has suffixes.
        self.first = np.zeros(2 * n, np.int64)
        self.size = np.zeros(2 * n, np.int64)
        rank = np.cumsum(new) - 1
        name = rank - rank[texts.starts][text] + 2 * texts.starts[text] if n else rank
        self.group = np.empty(n, np.int64)
        self.group[self.order] = name
        self.first[name[heads]] = heads
        self.size[name[heads]] = np.diff(np.append(heads, n))
        self.fresh = name[texts.starts + texts.lengths - 1] + 1 if n else np.zeros(0, np.int64)

    def split(self, texts: Texts) -> np.ndarray:
        """Refines the groups; returns the previous smaller suffix of each, or NONE."""
        order, place, group, first, size = self.order, self.place, self.group, self.first, self.size
        before = np.arange(-1, len(order) - 1)
        before[texts.starts] = NONE
        above = np.zeros(len(first), np.int64)
        made = np.full(len(first), NONE)  # while which group was gone through
        fresh, low = self.fresh.copy(), texts.starts.copy()
        # Of the group gone through: its name, first place and end, and where we are.
        end = texts.starts + texts.lengths
        now, floor = self.enter(end)
        at = floor.copy()
        suffix = order[at]
        back = before[suffix]
        while len(at):
            # Step back over suffixes of this group or higher ones.
            higher = back >= 0
            higher &= first[group[back]] >= floor
            back[higher] = before[back[higher]]
            done = np.flatnonzero(~higher)
            before[suffix[done]] = back[done]
            up = done[back[done] >= 0]
            if len(up):
                moved, by = back[up], now[up]
                old = group[moved]
                last_place = first[old] + size[old] - 1
                last, hole = order[last_place], place[moved]
                order[hole], place[last] = last, hole
                order[last_place], place[moved] = moved, last_place
                size[old] -= 1
                new = above[old]
                first_time = made[old] != by
                ways = up[first_time]
                new[first_time] = fresh[ways]
                fresh[ways] += 1
                above[old], made[old] = new, by
                first[new] = last_place
                size[new] += 1
                group[moved] = new
            at[done] += 1
            over = done[at[done] == end[done]]
            if len(over):
                end[over] = floor[over]
                left = end > low
                if not left.all():
                    over = over[left[over]]
                    renumbered = np.cumsum(left) - 1
                    done, over = renumbered[done[left[done]]], renumbered[over]
                    at, low, suffix, now, floor, back, fresh, end = (
                        x[left] for x in (at, low, suffix, now, floor, back, fresh, end)
                    )
                now[over], floor[over] = self.enter(end[over])
                at[over] = floor[over]
            suffix[done] = order[at[done]]
            back[done] = before[suffix[done]]
        return before

    def enter(self, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Name and first place of the group that ends before each place. Suffixes of
        a group are gone through in the order of the text, so steps back stay short."""
        name = self.group[self.order[end - 1]]
        start = self.first[name]
        several = np.flatnonzero(self.size[name] > 1)
        if len(several):
            count = self.size[name[several]]
            owner = np.repeat(np.arange(len(several)), count)
            inside = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            places = start[several][owner] + inside
            found = self.order[places]
            # Texts lie apart, but not in the order of lanes.
            lane = owner * len(self.order)
            found = np.sort(lane + found) - lane
            self.order[places], self.place[found] = found, places
        return name, start

    def emit(self, texts: Texts, before: np.ndarray) -> np.ndarray:
        """The order of all suffixes, from the groups and previous smaller suffixes."""
        n = len(self.order)
        result = np.full(n, NONE)
        free, group = self.first.copy(), self.group
        placed = np.zeros(n + 1, bool)
        placed[NONE] = True
        at, high = texts.starts.copy(), texts.starts + texts.lengths
        result[at] = high - 1
        placed[high - 1] = True
        left_of = np.arange(-1, n - 1)
        left_of[texts.starts] = NONE
        back = left_of[result[at]]
        while len(at):
            idle = placed[back]
            busy = np.flatnonzero(~idle)
            if len(busy):
                suffix = back[busy]
                slot = free[group[suffix]]
                result[slot] = suffix
                free[group[suffix]] = slot + 1
                placed[suffix] = True
                back[busy] = before[suffix]
            done = np.flatnonzero(idle)
            at[done] += 1
            left = at < high
            if not left.all():
                at, high, back = at[left], high[left], back[left]
                done = np.flatnonzero(idle[left])
            if len(done):
                back[done] = left_of[result[at[done]]]
        return result
