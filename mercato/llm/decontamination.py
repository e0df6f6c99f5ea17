"""Benchmark decontamination with a generalised suffix automaton.

The automaton holds every run of words of every benchmark item, words as
integers. A document's words are streamed through it; after each word the
state and length tell the longest run that ends there and occurs in an item.
A window (13 words, or the whole of a shorter item) occurs where that length
reaches it. Words inside occurrences are hit; spans of hit words that exceed
a length or a coverage limit can be removed.

The benchmark is read in blocks of a bounded number of words. Each block is one
pass over the documents, whose results are written before the next block is read,
so a task holds one block's automaton and the driver the words of two blocks at
most; the usual benchmark is one block.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercato.llm.common import arrow_map, only
from mercato.operators.durable import OwnedTables

WINDOW = 13
#: Benchmark words whose automaton is held at once; about 1 KB a word.
BLOCK_WORDS = 200_000
_LETTERS = bytes(
    value if value >= 0x80 or chr(value).isalnum() else 0x20 for value in range(256)
)
_WORD = re.compile(rb"[^ ]+")


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased, as UTF-8."""
    return (text or "").encode().lower().translate(_LETTERS).split()


class SuffixAutomaton:
    """Generalised suffix automaton of rows of words.

    A state stands for runs of words that end at the same places; ``link`` leads
    to the longest shorter run with more places, ``length`` is the longest run.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW) -> None:
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        ends: dict[int, set[str]] = {}
        whole: dict[int, set[str]] = {}
        for name, words in items:
            state = 0
            for position, word in enumerate(words, 1):
                state = self._extend(state, word)
                if position >= window:
                    ends.setdefault(state, set()).add(name)
            if 0 < len(words) < window:
                whole.setdefault(state, set()).add(name)
        self._settle(ends, whole)
        #: Adjacent words of items: no window of two or more words holds another pair.
        self.pairs = {pair for _, words in items for pair in zip(words, words[1:])}
        self.shortest = min([window, *(len(words) for _, words in items if words)])

    def _extend(self, last: int, word: bytes) -> int:
        """State of ``last``'s longest run with ``word`` added."""
        if word in self.next[last]:
            found = self.next[last][word]
            if self.length[found] == self.length[last] + 1:
                return found
            return self._split(last, found, word)
        state = self._add(self.length[last] + 1, {}, 0)
        at = last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = state
            at = self.link[at]
        if at >= 0:
            found = self.next[at][word]
            if self.length[found] != self.length[at] + 1:
                found = self._split(at, found, word)
            self.link[state] = found
        return state

    def _split(self, at: int, found: int, word: bytes) -> int:
        """Give the runs of ``found`` that are as short as from ``at`` a state of their own."""
        copy = self._add(self.length[at] + 1, dict(self.next[found]), self.link[found])
        self.link[found] = copy
        while at >= 0 and self.next[at].get(word) == found:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def _add(self, length: int, edges: dict[bytes, int], link: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _settle(self, ends: dict[int, set[str]], whole: dict[int, set[str]]) -> None:
        """Carry the items of long windows up to the states that hold them, of short ones down."""
        by_length = sorted(range(1, len(self.link)), key=self.length.__getitem__)
        for state in reversed(by_length):
            parent = self.link[state]
            if state in ends and self.length[parent] >= self.window:
                ends.setdefault(parent, set()).update(ends[state])
        #: Items with a window that ends a run of this state.
        self.items: dict[int, tuple[str, ...]] = {s: tuple(sorted(v)) for s, v in ends.items()}
        #: Short items that end a run of this state: pairs of length and names.
        self.short: dict[int, tuple[tuple[int, tuple[str, ...]], ...]] = {}
        for state in by_length:
            found = self.short.get(self.link[state], ())
            if state in whole:
                found = ((self.length[state], tuple(sorted(whole[state]))), *found)
            if found:
                self.short[state] = found

    def stream(self, words: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """After each word with a match: place, state and length of the longest one."""
        state = length = 0
        following, link, longest = self.next, self.link, self.length
        for place, word in enumerate(words):
            while state and word not in following[state]:
                state = link[state]
                length = longest[state]
            state = following[state].get(word, 0)
            if state:
                length += 1
                yield place, state, length
            else:
                length = 0

    def candidates(self, words: list[bytes]) -> list[tuple[int, int]]:
        """Stretches that may hold a window: every adjacent pair in them is one of an item."""
        if self.shortest < 2:
            return [(0, len(words))]
        pairs = self.pairs
        known = bytes([pair in pairs for pair in zip(words, words[1:])])
        least = self.shortest - 1
        return [
            (run.start(), run.end() + 1)
            for run in re.finditer(rb"\x01{%d,}" % least, known)
        ]

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans of hit words, in order and apart from one another, and the items found."""
        spans: list[list[int]] = []
        found: set[str] = set()
        window, items, short = self.window, self.items, self.short
        for low, high in self.candidates(words):
            for place, state, length in self.stream(words[low:high]):
                reach = 0
                if length >= window:
                    reach = window
                    # Of this state's ancestors, the one whose runs include the window itself.
                    while self.length[self.link[state]] >= window:
                        state = self.link[state]
                    found.update(items.get(state, ()))
                for size, names in short.get(state, ()):
                    if size <= length:
                        reach = max(reach, size)
                        found.update(names)
                if reach:
                    start, end = low + place + 1 - reach, low + place + 1
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append([start, end])
        return [(start, end) for start, end in spans], found


def blocks_of(benchmark: DataFrame, item: str, text: str, block_words: int) -> Iterator[list]:
    """The items with words, in blocks of about ``block_words`` words.

    The items come to the driver one block at a time.
    """
    source = only(benchmark, item, text).where(F.col(text).isNotNull() & F.col(item).isNotNull())
    block, size = [], 0
    for name, content in source.select(F.col(item).cast("string"), text).toLocalIterator():
        words = words_of(content)
        if not words:
            continue
        block.append((name, words))
        size += len(words)
        if size >= block_words:
            yield block
            block, size = [], 0
    if block:
        yield block


MATCH = [
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.ArrayType(T.IntegerType()))),
    T.StructField("items", T.ArrayType(T.StringType())),
]


def _matched(docs: DataFrame, key: str, text: str, block: list, window: int) -> DataFrame:
    def start():
        automaton = SuffixAutomaton(block, window)

        def work(batch):
            counts, spans, names = [], [], []
            for content in batch.column(1).to_pylist():
                words = words_of(content)
                hit, found = automaton.hits(words) if words else ([], set())
                counts.append(len(words))
                spans.append(hit)
                names.append(sorted(found))
            return {key: batch.column(0), "n_words": counts, "spans": spans, "items": names}

        return work

    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), *MATCH])
    return arrow_map(docs, start, schema)


def _spare(names: list[str], wanted: str) -> str:
    while wanted in names:
        wanted += "_"
    return wanted


def _join_spans(spans: list) -> list[list[int]]:
    out: list[list[int]] = []
    for start, end in sorted(map(tuple, spans)):
        if out and out[-1][1] >= start:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


@dataclass(frozen=True)
class Limits:
    """When a document counts as contaminated, and which spans are removed.

    ``coverage``: hit words times this number reach the document's words.
    ``span_words``: a span of this many words or more is removed by itself.
    """

    coverage: int = 20
    span_words: int = WINDOW


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    limits: Limits = Limits(),
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Matches of every document with every benchmark item.

    Returns the key, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``,
    ``contaminated`` and ``spans`` (first word and the word behind the last).
    A null text has no words. Items that are null or without words match
    nothing; an empty benchmark leaves every document clean. Equal rows give
    equal results. Every row has a result of its own, also where keys repeat or are
    null: with several blocks the rows are numbered, and written once so that
    the numbers last.
    """
    source = only(docs, key, text)
    blocks = blocks_of(benchmark, item, item_text, block_words)
    block, second = next(blocks, []), next(blocks, None)
    if second is None:
        found = _matched(source, key, text, block, window)
    else:
        row = _spare([key, text], "row")
        tables = OwnedTables(docs.sparkSession, "decontamination")
        numbered = tables.write(source.withColumn(row, F.monotonically_increasing_id()), "rows")
        # Each block's matches are written before the next block comes to the driver.
        merged = None
        for number, block in enumerate(itertools.chain([block, second], blocks)):
            part = tables.write(_matched(only(numbered, row, text), row, text, block, window), f"block-{number}")
            merged = merged.unionByName(part) if merged else part
        merged = merged.groupBy(row).agg(
            F.max("n_words").alias("n_words"),
            F.flatten(F.collect_list("spans")).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        )
        found = only(numbered, row, key).join(merged, row).drop(row)

    coverage = limits.coverage
    fields = [
        T.StructField(key, source.schema[key].dataType),
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("n_items", T.LongType()),
        T.StructField("items_sha256", T.StringType()),
        T.StructField("contaminated", T.BooleanType()),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.IntegerType()))),
    ]

    def start():
        def work(batch):
            counts = batch.column(1).to_pylist()
            spans = [_join_spans(row) for row in batch.column(2).to_pylist()]
            hit = [sum(end - start for start, end in row) for row in spans]
            names = batch.column(3).to_pylist()
            return {
                key: batch.column(0),
                "n_words": counts,
                "n_hit": hit,
                "n_items": [len(row) for row in names],
                "items_sha256": [hashlib.sha256(",".join(row).encode()).hexdigest() for row in names],
                "contaminated": [h > 0 and coverage * h >= n for h, n in zip(hit, counts, strict=True)],
                "spans": spans,
            }

        return work

    return arrow_map(found, start, T.StructType(fields), rows=4096)


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``spans`` and what stands between them."""
    raw = text.encode()
    places = [(m.start(), m.end()) for m in _WORD.finditer(raw.lower().translate(_LETTERS))]
    out, at = [], 0
    for start, end in spans:
        out.append(raw[at : places[start][0]])
        at = places[end - 1][1]
    out.append(raw[at:])
    return b"".join(out).decode()


def remove_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    limits: Limits = Limits(),
    block_words: int = BLOCK_WORDS,
    drop: bool = True,
) -> DataFrame:
    """The documents with their columns, contaminated ones dropped or cut.

    With ``drop`` a contaminated document goes; without it the document stays
    and loses its spans of ``limits.span_words`` hit words or more. Documents
    that keep below the coverage limit are left as they are. Null texts stay.
    """
    columns, schema, coverage = docs.columns, docs.schema, limits.coverage
    at = columns.index(text)
    # The coverage limit needs the hits of all blocks; each block adds its spans to a spare column.
    spare = _spare(columns, "spans")
    spans_type = T.ArrayType(T.ArrayType(T.IntegerType()))
    wide = T.StructType([*schema.fields, T.StructField(spare, spans_type)])

    def matching(block, last):
        def start():
            automaton = SuffixAutomaton(block, window)

            def work(batch):
                texts = batch.column(at).to_pylist()
                found = [
                    (before or []) + [list(span) for span in automaton.hits(words_of(content))[0]]
                    for content, before in zip(texts, batch.column(len(columns)).to_pylist(), strict=True)
                ]
                if not last:
                    return {name: batch.column(i) for i, name in enumerate(columns)} | {spare: found}
                keep = []
                for i, spans in enumerate(map(_join_spans, found)):
                    hit = sum(end - start for start, end in spans)
                    bad = hit > 0 and coverage * hit >= len(words_of(texts[i]))
                    if bad and not drop:
                        texts[i] = cut_spans(texts[i], [s for s in spans if s[1] - s[0] >= limits.span_words])
                    if not (bad and drop):
                        keep.append(i)
                out = {name: batch.column(i).take(_index(keep)) for i, name in enumerate(columns)}
                out[text] = [texts[i] for i in keep]
                return out

            return work

        return start

    current = docs.withColumn(spare, F.lit(None).cast(spans_type))
    tables = OwnedTables(docs.sparkSession, "decontamination")
    blocks = blocks_of(benchmark, item, item_text, block_words)
    block, number = next(blocks, None), 0
    if block is None:
        return docs
    for following in blocks:
        # Written between the passes, so that a task holds one block's automaton, and the driver two blocks' words.
        current = tables.write(arrow_map(current, matching(block, False), wide), f"pass-{number}")
        if number:
            tables.drop(f"pass-{number - 1}")
        block, number = following, number + 1
    return arrow_map(current, matching(block, True), schema)


def _index(chosen: list[int]):
    import pyarrow as pa

    return pa.array(chosen, type=pa.int64())
