"""Periodic runs of words, caught online by catchers on dyadic blocks, and texts without their repeats.

A run is a longest stretch of consecutive words with smallest period ``q`` (words
``q`` apart are identical) that holds at least three periods and
``least_length`` words.

``SquareCatchers`` takes words as they are appended. On level ``k`` each
completed block of ``B = 2**k`` words, at a multiple of ``B``, has a catcher for
squares that begin with the block and have a period of ``B`` to ``2B - 1``: when a
word is appended, the suffix of ``B`` words that it ends is compared with the
block, by a fingerprint that grows out of the two halves' fingerprints of the
level below. Every word is compared with one block on each level, so appending
``n`` words costs ``O(n log n)``. A run of three periods has a square that begins
with a block, since the first period holds the start of one; so no run is
missed. A square reported is compared word by word, merged into the run of its
period that covers it, or becomes a new one, which grows to the left at once and
to the right as words are appended. Squares of a power (``abab`` twice) have a
period that isn't the smallest and are left to the run of the smallest.

The words appended in one call are compared as arrays; one call for each word
reports the same runs. A level keeps its last ``4B`` fingerprints only, so the
catchers take memory in proportion to the words.

Defined results: a null, empty or blank text has no words, no runs and an empty
collapsed text; a null key is carried along; rows that repeat are judged one by
one; no row is dropped; other columns are not read.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Callable
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from mercato.llm.common import arrow_map, only

LEAST_LENGTH = 24
LEAST_PERIODS = 3

RUN_TYPE = T.ArrayType(
    T.StructType([T.StructField(name, T.LongType()) for name in ("start", "length", "period")])
)


class Run(NamedTuple):
    start: int
    length: int
    period: int


def _mixed(values: np.ndarray) -> np.ndarray:
    """64 bits that look random, one to one with the values."""
    values = values * np.uint64(0x9E3779B97F4A7C15)
    values ^= values >> np.uint64(32)
    values *= np.uint64(0xD6E8FEB86659FD93)
    values ^= values >> np.uint64(29)
    return values


def _equal_words(words: np.ndarray, low: int, high: int, period: int) -> int:
    """How many i from ``low`` on, below ``high``, have words[i] == words[i + period], up to the first that hasn't."""
    at, step = low, 64
    while at < high:
        end = min(at + step, high)
        differs = words[at:end] != words[at + period : end + period]
        first = int(differs.argmax())
        if differs[first]:
            return at + first - low
        at, step = end, step * 4
    return high - low


def _equal_words_before(words: np.ndarray, high: int, period: int) -> int:
    """The same to the left: how many i below ``high``, downwards."""
    at, step = high, 64
    while at > 0:
        low = max(at - step, 0)
        differs = (words[low:at] != words[low + period : at + period])[::-1]
        first = int(differs.argmax())
        if differs[first]:
            return high - at + first
        at, step = low, step * 4
    return high


def _is_power(words: np.ndarray, start: int, period: int) -> bool:
    """Whether the period's words are themselves a repetition."""
    rest, factor = period, 2
    factors = set()
    while factor * factor <= rest:
        while rest % factor == 0:
            factors.add(factor)
            rest //= factor
        factor += 1
    if rest > 1:
        factors.add(rest)
    root = words[start : start + period]
    return any(np.array_equal(root[period // f :], root[: period - period // f]) for f in factors)


class SquareCatchers:
    """Runs of three periods or more in a sequence of words, given as numbers and appended bit by bit."""

    def __init__(self) -> None:
        self.words = np.empty(0, np.int64)
        # On each level: the number of the first fingerprint kept, and those kept.
        self._levels: list[tuple[int, np.ndarray]] = []
        # Each run is [start, end, period]; those that may still grow are open.
        self._runs: list[list[int]] = []
        self._open: list[list[int]] = []
        self._newest: dict[int, list[int]] = {}
        # For each word, how far the farthest run that covers it goes, and its period.
        self._reach = np.empty(0, np.int64)
        self._period = np.empty(0, np.int64)

    def append(self, words: np.ndarray, longest: int | None = None) -> None:
        """Take more words; no run may be longer than ``longest`` words, if given."""
        before = len(self.words)
        self.words = np.concatenate([self.words, np.asarray(words, np.int64)])
        grown = np.zeros(len(self.words) - before, np.int64)
        self._reach = np.concatenate([self._reach, grown])
        self._period = np.concatenate([self._period, grown + 1])
        self._advance()
        first = before
        prints = _mixed(self.words[before:].astype(np.uint64))
        for level in itertools.count():
            block = 1 << level
            if block > len(self.words) or longest is not None and LEAST_PERIODS * block > longest:
                break
            if level == len(self._levels):
                self._levels.append((first, np.empty(0, np.uint64)))
            kept_from, kept = self._levels[level]
            prints = np.concatenate([kept, prints[max(0, kept_from + len(kept) - first) :]])
            self._catch(block, before, kept_from, prints)
            keep_from = max(kept_from, len(self.words) - 4 * block)
            self._levels[level] = (keep_from, prints[keep_from - kept_from :].copy())
            # Fingerprints of the next level that end within the new words, or all of a new level.
            first = max(0, before - 2 * block + 1) if level + 1 < len(self._levels) else 0
            first = max(first, kept_from)
            halves = prints[first - kept_from :]
            odd = _mixed(np.array([level + 1], np.uint64))[0] | np.uint64(1)
            prints = halves[:-block] * odd + halves[block:] if len(halves) > block else halves[:0]

    def _advance(self) -> None:
        """Let the open runs grow over the new words."""
        still = []
        for run in self._open:
            start, end, period = run
            run[1] = end + _equal_words(self.words, end - period, len(self.words) - period, period)
            self._cover(run)
            if run[1] == len(self.words):
                still.append(run)
        self._open = still

    def _catch(self, block: int, before: int, first: int, prints: np.ndarray) -> None:
        """Compare the suffixes that end in the new words with their catchers' blocks."""
        total = len(self.words)
        low = max(first, before - 4 * block + 2)
        low += -low % block
        grid = prints[low - first :]
        rows = -(-len(grid) // block)
        if rows < 2:
            return
        grid = np.concatenate([grid, np.zeros(rows * block - len(grid), np.uint64)]).reshape(rows, block)
        row, shift = np.nonzero(grid[1:] == grid[:-1, :1])
        starts, periods = low + row * block, block + shift
        ends = starts + 2 * periods
        new = (ends <= total) & (ends > before)
        starts, periods = starts[new], periods[new]
        # The period's last words, too: a square, but for fingerprints that are equal by chance.
        tail = starts + periods - block - first
        new = prints[tail] == prints[tail + periods]
        new &= (self._reach[starts] < starts + 2 * periods) | (periods % self._period[starts] != 0)
        starts, periods = starts[new], periods[new]
        for at in np.lexsort((starts, periods)):
            self._report(int(starts[at]), int(periods[at]))

    def _report(self, start: int, period: int) -> None:
        """Merge a square into the run that covers it, or begin one."""
        known = self._newest.get(period)
        if known and start + 2 * period <= known[1]:
            return
        same = _equal_words(self.words, start, len(self.words) - period, period)
        if same < period or _is_power(self.words, start, period):
            return
        run = [start - _equal_words_before(self.words, start, period), start + same + period, period]
        self._runs.append(run)
        self._newest[period] = run
        self._cover(run)
        if run[1] == len(self.words):
            self._open.append(run)

    def _cover(self, run: list[int]) -> None:
        start, end, period = run
        reach = self._reach[start:end]
        farther = reach < end
        reach[farther] = end
        self._period[start:end][farther] = period

    def runs(self, least_length: int = LEAST_LENGTH) -> list[Run]:
        """The runs of the words so far, by start, then period."""
        found = [
            Run(start, end - start, period)
            for start, end, period in self._runs
            if end - start >= max(least_length, LEAST_PERIODS * period)
        ]
        return sorted(found, key=lambda run: (run.start, run.period))


def runs_of(texts: list[list], least_length: int = LEAST_LENGTH) -> list[list[Run]]:
    """The runs of each text's words; the texts pass through one set of catchers, kept apart by marks."""
    numbers: dict[Any, int] = defaultdict(itertools.count().__next__)
    pieces, offsets, at = [], [], 0
    for place, words in enumerate(texts):
        offsets.append(at)
        pieces.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
        pieces.append(np.array([-1 - place], np.int64))
        at += len(words) + 1
    catchers = SquareCatchers()
    if pieces:
        catchers.append(np.concatenate(pieces), max(map(len, texts)))
    found: list[list[Run]] = [[] for _ in texts]
    for run in catchers.runs(least_length):
        place = int(np.searchsorted(offsets, run.start, side="right")) - 1
        found[place].append(run._replace(start=run.start - offsets[place]))
    return found


def without_repeats(words: list, runs: list[Run]) -> list:
    """The words but for those that a run holds after its first period."""
    if not runs:
        return words
    drop = np.zeros(len(words) + 1, np.int32)
    for run in runs:
        drop[run.start + run.period] += 1
        drop[run.start + run.length] -= 1
    gone = np.cumsum(drop) > 0
    return [word for word, out in zip(words, gone.tolist()) if not out]


def find_runs(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    least_length: int = LEAST_LENGTH,
    rewrite: Callable[[Any, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """Key, ``n_words``, ``runs`` and ``collapsed`` (the words left, joined by a space) of every row.

    Words are what stands between spaces, tabs, line and form feeds, in the
    whole text. ``rewrite``, given a key and its words, may return other words
    to be searched in their place.
    """
    source = only(docs, key, text)
    schema = T.StructType(
        [
            T.StructField(key, source.schema[key].dataType),
            T.StructField("n_words", T.LongType()),
            T.StructField("runs", RUN_TYPE),
            T.StructField("collapsed", T.StringType()),
        ]
    )

    def start():
        def work(batch):
            # split() of bytes parts at the six ASCII white-space characters, and at no others.
            texts = [(content or b"").split() for content in batch.column(1).cast(pa.binary()).to_pylist()]
            if rewrite:
                texts = [rewrite(name, words) for name, words in zip(batch.column(0).to_pylist(), texts)]
            found = runs_of(texts, least_length)
            left = [b" ".join(without_repeats(words, runs)) for words, runs in zip(texts, found)]
            return {
                key: batch.column(0),
                "n_words": [len(words) for words in texts],
                "runs": [[run._asdict() for run in runs] for runs in found],
                "collapsed": pa.array(left, pa.binary()).cast(pa.string(), safe=False),
            }

        return work

    return arrow_map(source, start, schema)
