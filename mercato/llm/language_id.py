"""Language identification with error-correcting output codes.

Every learned language has a codeword; each bit is predicted by a binary
classifier over hashed character n-grams of one to three letters, which weighs
an n-gram by how much oftener it is seen in languages whose bit is one than in
those whose bit is zero. Decoding adds a logistic loss of every bit, weighted
by how far the bit's two classes of languages lie apart, and takes the codeword of
least loss; a small distance to the second flags the row as ambiguous.

The n-gram counts come from all labelled rows: tasks count, Spark adds up by
language and n-gram slot, and the driver receives one number for each language
and slot, a bounded table.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercato.llm.common import arrow_map, importable, only, remainder, worker_cache, small_batches

#: Slots for hashed n-grams, a power of two.
SLOT_BITS = 14
SLOTS = 1 << SLOT_BITS
UNKNOWN = "und"
#: Codewords are all two-way splits of the languages up to this number, else pseudo-random rows.
EXHAUSTIVE = 5
#: Turns a mean log ratio for each n-gram into the margin of the logistic loss.
MARGIN_SCALE = 12.0
#: Below this distance between the two best codewords a row is ambiguous.
AMBIGUOUS = 0.15
_LETTER = re.compile(r"[^\W\d_]")
_PIECE = 1 << 20


@worker_cache(maxsize=1)
def _folded() -> np.ndarray:
    """By code point: the lower-case letter, or 0 for what is no letter."""
    table = np.zeros(0x110000, np.uint32)
    for code in range(0x323B0):
        letter = chr(code)
        if letter.isalpha():
            lower = letter.lower()
            table[code] = ord(lower[0])
    return table


def letters_of(text: str) -> np.ndarray:
    """Lower-case letters of the whole text as numbers, other runs as one 0, a 0 at both ends."""
    raw = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    codes = np.zeros(len(raw) + 2, np.uint32)
    codes[1:-1] = _folded()[raw]
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    return codes[keep]


def slot_counts(text: str) -> np.ndarray:
    """How often each slot's n-grams occur in the text."""
    codes = letters_of(text)
    counts = np.zeros(SLOTS, np.int64)
    # In pieces that overlap by two, so that memory stays bounded on very long texts.
    for low in range(0, len(codes), _PIECE):
        part = codes[low : low + _PIECE + 2]
        body = min(len(part), _PIECE)
        one = part * np.uint32(2654435761)
        counts += np.bincount(one[:body][part[:body] != 0] >> (32 - SLOT_BITS), minlength=SLOTS)
        two = (one[:-1] ^ (one[1:] >> np.uint32(7))) * np.uint32(2246822519)
        counts += np.bincount(two[:body] >> (32 - SLOT_BITS), minlength=SLOTS)
        three = (two[:-1] ^ (one[2:] >> np.uint32(5))) * np.uint32(3266489917)
        counts += np.bincount(three[:body] >> (32 - SLOT_BITS), minlength=SLOTS)
    return counts


def codewords(languages: int) -> np.ndarray:
    """One row of +1 and -1 for each language; no two bits split the languages alike."""
    if languages == 1:
        return np.ones((1, 1))
    if languages <= EXHAUSTIVE:
        rest = range(1, languages)
        bits = [
            [1.0] + [1.0 if i in chosen else -1.0 for i in rest]
            for size in range(languages - 1)
            for chosen in combinations(rest, size)
        ]
        return np.array(bits).T
    # Walsh rows in a larger order: any two differ in half the bits.
    size = 1 << int(np.ceil(np.log2(languages + 1)))
    walsh = np.ones((1, 1))
    while len(walsh) < size:
        walsh = np.block([[walsh, walsh], [walsh, -walsh]])
    words = walsh[1 : languages + 1]
    return words[:, [i for i in range(size) if abs(words[:, i].sum()) < languages]]


@dataclass
class LanguageModel:
    """Languages, codewords, and of each bit the weights of the slots and its share in the loss."""

    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray
    shares: np.ndarray

    def margins(self, text: str) -> np.ndarray:
        counts = slot_counts(text)
        return counts @ self.weights / max(counts.sum(), 1) * MARGIN_SCALE

    def decide(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score from 0 to 1, and whether the decision is ambiguous."""
        if not self.languages or text is None or not _LETTER.search(text):
            return UNKNOWN, 0.0, True
        loss = np.logaddexp(0, -self.codes * self.margins(text)) @ self.shares
        order = np.argsort(loss, kind="stable")
        chance = np.exp(loss[order[0]] - loss)
        gap = 1.0 if len(loss) == 1 else float(loss[order[1]] - loss[order[0]])
        return self.languages[order[0]], float(1 / chance.sum()), gap < AMBIGUOUS


def _count_slots(rows: DataFrame, text: str, label: str) -> DataFrame:
    """n-gram counts by language and slot, plus one row a language of the documents."""
    schema = T.StructType(
        [
            T.StructField("label", T.StringType()),
            T.StructField("slot", T.IntegerType()),
            T.StructField("hits", T.LongType()),
        ]
    )

    def run(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if name not in totals:
                    totals[name] = np.zeros(SLOTS, np.int64)
                totals[name] += slot_counts(content.as_py())
        for name, counts in totals.items():
            slots = np.flatnonzero(counts)
            yield _record(name, slots, counts[slots])

    importable(rows.sparkSession)
    small_batches(rows.sparkSession)
    counted = only(rows, label, text).mapInArrow(run, schema)
    return counted.groupBy("label", "slot").agg(F.sum("hits").alias("hits"))


def _record(name: str, slots: np.ndarray, counts: np.ndarray):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays(
        [pa.array([name] * len(slots), pa.string()), pa.array(slots, pa.int32()), pa.array(counts, pa.int64())],
        ["label", "slot", "hits"],
    )


def fit(rows: DataFrame, text: str = "text", label: str = "lang") -> LanguageModel:
    """Learn from the rows that have a text with a letter and a label.

    Without any such row the model knows no language and answers ``und``.
    """
    usable = rows.where(F.col(f"`{label}`").isNotNull() & F.col(f"`{text}`").isNotNull())
    table = _count_slots(usable, text, label).toPandas()
    languages = sorted(table["label"].unique())
    counts = np.zeros((len(languages), SLOTS))
    place = {name: i for i, name in enumerate(languages)}
    counts[table["label"].map(place).to_numpy(int), table["slot"].to_numpy(int)] = table["hits"]
    codes = codewords(len(languages)) if languages else np.zeros((0, 0))
    if len(languages) < 2:
        return LanguageModel(languages, codes, np.zeros((SLOTS, codes.shape[1])), np.ones(codes.shape[1]))
    # Languages count alike, however many rows they have.
    chances = (counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * SLOTS)
    weights, shares = [], []
    for bit in codes.T:
        ratio = np.log(chances[bit > 0].mean(0)) - np.log(chances[bit < 0].mean(0))
        margin = chances @ ratio
        # A bit whose classes lie far apart for each n-gram decides more surely.
        shares.append(max(float((margin * bit).min()), 1e-3))
        weights.append(ratio)
    shares = np.array(shares) / np.sum(shares)
    return LanguageModel(languages, codes, np.array(weights).T.astype(np.float32), shares)


def identify(docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, ``lang_pred``, ``score`` and ``ambiguous`` of every whole text.

    A text that is null or has no letter is ``und`` with score 0 and counts as
    ambiguous. Equal texts get equal answers; ties go to the language first in
    alphabetical order.
    """
    source = only(docs, key, text)
    schema = T.StructType(
        [
            T.StructField(key, source.schema[key].dataType),
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("ambiguous", T.BooleanType()),
        ]
    )

    def start():
        def work(batch):
            found = [model.decide(content) for content in batch.column(1).to_pylist()]
            return {
                key: batch.column(0),
                "lang_pred": [row[0] for row in found],
                "score": [row[1] for row in found],
                "ambiguous": [row[2] for row in found],
            }

        return work

    return arrow_map(source, start, schema)


def keep_identified(
    docs: DataFrame, model: LanguageModel, text: str = "text", languages: set[str] | None = None
) -> DataFrame:
    """Rows, with their columns, whose language is known (and in ``languages``, if given).

    Rows whose text is null or has no letter go. An ambiguous row stays: it is
    in one of the learned languages, only the choice between two is unsure.
    """
    at = docs.columns.index(text)
    names = docs.columns

    def start():
        import pyarrow as pa

        def work(batch):
            found = [model.decide(content)[0] for content in batch.column(at).to_pylist()]
            keep = [name != UNKNOWN and (languages is None or name in languages) for name in found]
            chosen = batch.filter(pa.array(keep, pa.bool_()))
            return {name: chosen.column(i) for i, name in enumerate(names)}

        return work

    return arrow_map(docs, start, docs.schema)


def held_out(key: Column | str, divisor: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves ``fold``; a null id is not held out."""
    return F.coalesce(remainder(key, divisor) == fold, F.lit(False))
