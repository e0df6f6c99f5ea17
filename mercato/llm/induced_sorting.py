"""Suffix arrays of many small strings at once, by induced sorting, and their permuted common prefixes.

The linear method classifies each suffix as smaller (S) or larger (L) than the
one that begins a place later, sorts the substrings between leftmost S suffixes
by induction, names them, sorts the string of names in the same way where names
repeat, and induces all other suffixes from those. Its two scans go place by
place, so Python does each step for all strings of a batch together: the strings
are columns of a matrix, and a step is one row. Columns are ordered by length, so
that a row holds those strings only that reach it.

A string here is a row of pieces. Numbers stand for the bytes: ``END`` closes a
string, ``MARK`` a piece, byte ``b`` is ``b + 2``.

The permuted common prefix of a place is how much its suffix shares with the one
before it in the array. It is compared only where the bytes before the two
differ, or a piece begins; elsewhere it is one less than at the place before.
"""

from __future__ import annotations

import numpy as np

END, MARK = 0, 1
_I = np.int64


def _next_smaller_type(text: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether each place of each column is of type S; rows behind a string's end are not."""
    rows, _ = text.shape
    rising = np.zeros(text.shape, bool)
    rising[:-1] = text[:-1] < text[1:]
    differs = np.ones(text.shape, bool)
    differs[:-1] = text[:-1] != text[1:]
    ends = lengths - 1
    differs[ends, np.arange(len(lengths))] = True
    rising[ends, np.arange(len(lengths))] = True
    # Of a stretch of equal numbers all are of the type of its last.
    place = np.where(differs, np.arange(rows, dtype=np.int32)[:, None], np.int32(rows - 1))
    decides = np.minimum.accumulate(place[::-1], axis=0)[::-1]
    inside = np.arange(rows)[:, None] < lengths
    return np.take_along_axis(rising, decides.astype(_I), axis=0) & inside


class _Level:
    """One level of the recursion: the strings' columns, their buckets and the two scans."""

    def __init__(self, text: np.ndarray, lengths: np.ndarray) -> None:
        self.text, self.lengths = text, lengths
        self.rows, self.columns = text.shape
        columns = np.arange(self.columns)
        inside = np.arange(self.rows)[:, None] < lengths
        small = _next_smaller_type(text, lengths)
        self.leftmost = small.copy()
        self.leftmost[0] = False
        self.leftmost[1:] &= ~small[:-1]
        # A bucket's number is its letter's row in a matrix with the same columns.
        bucket = text.astype(_I) * self.columns + columns
        self.letters = int(text.max(initial=0)) + 1
        counts = np.bincount(bucket[inside], minlength=self.letters * self.columns).reshape(self.letters, -1)
        ends = np.cumsum(counts, axis=0)
        self.heads = ((ends - counts) * self.columns + columns).ravel()
        self.tails = ((ends - 1) * self.columns + columns).ravel()
        self.bucket = bucket.ravel()
        # The bucket of the suffix a place before, if it is of the type that a scan looks for, or -1.
        # The last entry stands for slots that hold no suffix yet.
        size = self.rows * self.columns
        before_large, before_small = np.full(size + 1, -1, _I), np.full(size + 1, -1, _I)
        later = inside[1:]
        large = ~small[:-1] & later
        before_large[self.columns : -1] = np.where(large, bucket[:-1], -1).ravel()
        before_small[self.columns : -1] = np.where(small[:-1] & later, bucket[:-1], -1).ravel()
        self.before_large, self.before_small = before_large, before_small
        #: How many strings reach each row.
        self.reach = np.searchsorted(-lengths, -np.arange(self.rows), side="left").tolist()

    def induced(self, ordered: np.ndarray) -> np.ndarray:
        """All suffixes in order, from the leftmost S ones in the given order (by column, then rank)."""
        step = self.columns
        array = np.full(self.rows * step, self.rows * step, _I)
        bucket = self.bucket[ordered]
        last = np.ones(len(bucket), bool)
        last[:-1] = bucket[1:] != bucket[:-1]
        ends = np.flatnonzero(last)
        behind = ends[np.searchsorted(ends, np.arange(len(bucket)))] - np.arange(len(bucket))
        array[self.tails[bucket] - behind * step] = ordered
        free, before = self.heads.copy(), self.before_large
        for row, width in enumerate(self.reach):
            found = array[row * step : row * step + width]
            into = before[found]
            chosen = (into >= 0).nonzero()[0]
            if len(chosen):
                into = into[chosen]
                slot = free[into]
                array[slot] = found[chosen] - step
                free[into] = slot + step
        free, before = self.tails.copy(), self.before_small
        for row in range(self.rows - 1, -1, -1):
            found = array[row * step : row * step + self.reach[row]]
            into = before[found]
            chosen = (into >= 0).nonzero()[0]
            if len(chosen):
                into = into[chosen]
                slot = free[into]
                array[slot] = found[chosen] - step
                free[into] = slot - step
        return array.reshape(self.rows, step)

    def by_column(self, array: np.ndarray) -> np.ndarray:
        """The leftmost S suffixes of an array, column by column."""
        flat = array.T.ravel()
        flat = flat[flat < self.rows * self.columns]
        return flat[self.leftmost.ravel()[flat]]


def suffix_arrays(text: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each column its suffixes in order, as flat places (row * columns + column).

    ``text`` has a string in each column, closed by the only 0 in it; columns
    are ordered by falling length. Slots behind a string's length hold the
    number of all places.
    """
    level = _Level(text, lengths)
    step = level.columns
    rows, column = np.nonzero(level.leftmost.T)[::-1]
    places = rows * step + column  # column by column, in the order of the text
    rough = level.by_column(level.induced(places[np.argsort(level.bucket[places] + column * level.bucket.max(initial=0) * 2, kind="stable")]))
    # Substrings reach up to the next leftmost S place; equal ones get one name.
    following = np.append(places[1:], 0)
    following[np.append(column[1:] != column[:-1], True)] = -1
    reach = np.zeros(level.rows * step, _I)
    reach[places] = np.where(following >= 0, (following - places) // step, 0)
    left, right = rough[:-1], rough[1:]
    same = (left % step == right % step) & (reach[left] == reach[right])
    flat = level.text.ravel()
    open_ = np.flatnonzero(same)
    ahead = 0
    while len(open_):
        a, b = left[open_], right[open_]
        equal = flat[a + ahead * step] == flat[b + ahead * step]
        same[open_[~equal]] = False
        ahead += 1
        open_ = open_[equal & (reach[a] >= ahead)]
    fresh = np.append(True, ~same)
    columns = rough % step
    first = np.append(True, columns[1:] != columns[:-1])
    name = np.cumsum(fresh)
    name -= np.maximum.accumulate(np.where(first, name, 0))
    counts = np.bincount(columns, minlength=step)
    highest = np.zeros(step, _I)
    np.maximum.at(highest, columns, name)
    unclear = np.flatnonzero(highest + 1 < counts)
    ordered = rough
    if len(unclear):
        names = np.zeros(level.rows * step, _I)
        names[rough] = name
        # The strings of names that repeat some name, longest first.
        unclear = unclear[np.argsort(-counts[unclear], kind="stable")]
        deep = np.zeros((counts[unclear].max(), len(unclear)), np.int32)
        place_of = np.full(step, -1)
        place_of[unclear] = np.arange(len(unclear))
        starts = np.cumsum(counts) - counts
        mine = place_of[column] >= 0
        number = np.arange(len(places)) - starts[column]
        deep[number[mine], place_of[column[mine]]] = names[places[mine]]
        sorted_ = suffix_arrays(deep, counts[unclear])
        ordered = rough.copy()
        rank = np.arange(len(rough)) - starts[columns]
        theirs = place_of[columns] >= 0
        found = sorted_[rank[theirs], place_of[columns[theirs]]] // len(unclear)
        ordered[theirs] = places[starts[columns[theirs]] + found]
    return level.induced(ordered)


def joined(groups: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """A column of numbers for each group of pieces, and the columns' lengths; longest groups first."""
    lengths = np.array([sum(map(len, pieces)) + len(pieces) + 1 for pieces in groups], _I)
    text = np.zeros((int(lengths.max()), len(groups)), np.int32)
    for place, pieces in enumerate(groups):
        at = 0
        for piece in pieces:
            text[at : at + len(piece), place] = np.frombuffer(piece, np.uint8)
            text[at : at + len(piece), place] += 2
            text[at + len(piece), place] = MARK
            at += len(piece) + 1
    return text, lengths


def common_prefixes(text: np.ndarray, lengths: np.ndarray, arrays: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place, string after string: its predecessor in the array, and how far the two are equal.

    Equal means within a piece; predecessor -1: none.
    """
    rows, step = text.shape
    flat = arrays.T[np.arange(rows) < lengths[:, None]]
    first = np.cumsum(lengths) - lengths
    place = first[flat % step] + flat // step
    before = np.full(lengths.sum(), -1, _I)
    before[place[1:]] = place[:-1]
    before[place[first]] = -1
    line = text.T[np.arange(rows) < lengths[:, None]]
    size = len(line)
    left = np.append(END, line[:-1])
    there = np.maximum(before, 0)
    compared = (left != left[there]) | (left <= MARK)
    compared[first] = True
    result = np.zeros(size, _I)
    open_ = np.flatnonzero(compared & (before >= 0))
    ahead = 0
    while len(open_):
        here = line[open_ + ahead]
        open_ = open_[(here == line[before[open_] + ahead]) & (here > MARK)]
        ahead += 1
        result[open_] = ahead
    since = np.maximum.accumulate(np.where(compared, np.arange(size), 0))
    return before, np.maximum(result[since] - (np.arange(size) - since), 0)


def repeated_places(groups: list[list[bytes]], width: int) -> list[list[np.ndarray]]:
    """For each piece of each group: the places where a string of ``width`` begins that the group holds again."""
    order = sorted(range(len(groups)), key=lambda i: -sum(map(len, groups[i])) - len(groups[i]))
    ranked = [groups[i] for i in order]
    text, lengths = joined(ranked)
    before, shared = common_prefixes(text, lengths, suffix_arrays(text, lengths))
    found = np.flatnonzero(shared >= width)
    marked = np.zeros(len(before), bool)
    marked[found] = True
    marked[before[found]] = True
    results: list[list[np.ndarray]] = [[] for _ in groups]
    at = 0
    for place, pieces in zip(order, ranked):
        for piece in pieces:
            results[place].append(np.flatnonzero(marked[at : at + len(piece)]))
            at += len(piece) + 1
        at += 1
    return results
