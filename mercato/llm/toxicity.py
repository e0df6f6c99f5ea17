"""Toxicity by weak supervision.

1. From a bounded sample of labelled rows come the terms (words and word
   beginnings) that are much more frequent in toxic texts.
2. Voters: each lexicon voter holds a share of the terms of one kind and votes
   toxic where it finds one; presence voters want several terms; pattern voters
   look at shouting and repeated words; one voter says clean where no term is.
   Every voter may abstain.
3. A generative label model estimates, by expectation and maximisation, how often
   each voter votes what in toxic and in clean texts. Votes that agree more
   than the classes explain are correlated, and such voters share their weight.
4. A linear classifier learns the posterior labels from the terms in the text
   and is scaled so that its scores are chances.

Only the sample and the model pass the driver; every text is scored whole, in tasks.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercato.llm.common import arrow_map, only

#: Labelled rows the model is fitted on at most, in the mean (a share of the rows by hash).
TRAIN_ROWS = 6_000
SLOT_BITS = 21
SLOTS = 1 << SLOT_BITS
#: Word beginnings of these lengths are terms too.
BEGINNINGS = (3, 4, 5, 6)
KINDS = len(BEGINNINGS) + 1
#: A term seen this often in a text is a feature of its own.
LEVELS = (1, 2, 4)
#: Slots are numbered by term, kind (8 places) and level (4 places).
STEP = 32
#: Terms the classifier may use.
CLASSIFIER_TERMS = 4_096
#: With few labelled rows it uses one term for so many of them, but so many terms at least.
ROWS_PER_TERM, LEAST_TERMS = 2, 32
#: Lexicon voters of each kind and level hold its strongest terms: so many the first, and so on.
SHARES = (16, 64)
VOTERS = KINDS * len(LEVELS) * len(SHARES)
#: Voters whose votes agree less than this beyond the classes count as independent.
LEAST_CORRELATION = 0.1
CACHED_WORDS = 300_000
#: Marks what isn't part of a word; bytes from 0x80 on belong to letters of other alphabets.
_LETTERS = bytes(v if v >= 0x80 or chr(v).isalpha() else 0x20 for v in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_LETTERS).split()


def terms_of(word: bytes) -> tuple[int, ...]:
    """Slots, at the lowest level, of the word itself and of its beginnings."""
    letters = word.decode("utf-8", "replace")
    terms = [word] + [letters[:length].encode() for length in BEGINNINGS if len(letters) > length]
    return tuple(zlib.crc32(term) % (SLOTS // STEP) * STEP + kind * 4 for kind, term in enumerate(terms))


def slots_of(words: Iterable[tuple[bytes, int]], known: Callable[[bytes], tuple[int, ...]]) -> set[int]:
    """Slots of a text's terms at all levels that they reach, from words and how often each stands."""
    seen: dict[int, int] = {}
    for word, times in words:
        for slot in known(word):
            seen[slot] = seen.get(slot, 0) + times
    return {slot + level for slot, times in seen.items() for level, least in enumerate(LEVELS) if times >= least}


def shapes_of(text: str | None, words: list[bytes]) -> tuple[float, float]:
    """Share of capitals among letters, and of repeats among words."""
    if not words:
        return 0.0, 0.0
    capitals = sum(map(str.isupper, text or ""))
    return capitals / max(sum(map(len, words)), 1), 1 - len(set(words)) / len(words)


def sample(docs: DataFrame, labels: DataFrame, keep, key: str, text: str, label: str, rows: int) -> DataFrame:
    """Labelled rows that ``keep`` admits, about ``rows`` of them, with slots and shapes."""
    marked = only(labels, key, label).where(F.col(label).isNotNull())
    marked = marked.where(F.lit(True) if keep is None else keep).groupBy(key).agg(F.max(label).alias(label))
    total = marked.count()
    share = 1.0 if total <= rows else rows / total
    chosen = marked.where(F.pmod(F.xxhash64(F.col(key), F.lit(5)), F.lit(1 << 20)) < int(share * (1 << 20)))
    source = only(docs, key, text).where(F.col(text).isNotNull()).join(F.broadcast(chosen), key).select(
        label, text, F.xxhash64(key).alias("row")
    )
    schema = T.StructType(
        [
            T.StructField("toxic", T.IntegerType()),
            T.StructField("slots", T.BinaryType()),  # sorted numbers of 32 bits
            T.StructField("capitals", T.DoubleType()),
            T.StructField("repeats", T.DoubleType()),
            T.StructField("row", T.LongType()),
        ]
    )

    def start():
        known = lru_cache(CACHED_WORDS)(terms_of)

        def work(batch):
            texts = batch.column(1).to_pylist()
            words = [words_of(t) for t in texts]
            shapes = [shapes_of(t, w) for t, w in zip(texts, words, strict=True)]
            return {
                "toxic": [int(v) for v in batch.column(0).to_pylist()],
                "slots": [np.array(sorted(slots_of(Counter(w).items(), known)), np.int32).tobytes() for w in words],
                "capitals": [s[0] for s in shapes],
                "repeats": [s[1] for s in shapes],
                "row": batch.column(2),
            }

        return work

    return arrow_map(source, start, schema)


@dataclass
class LabelModel:
    """Chances of the votes -1, 0, 1 by class, the share of toxic rows, and the voters' weights."""

    votes: np.ndarray  # voter, class, vote + 1
    prior: float
    weights: np.ndarray
    correlation: np.ndarray = field(repr=False)

    def posterior(self, ballot: np.ndarray) -> np.ndarray:
        rows = np.arange(ballot.shape[1])
        log = np.log(self.votes)
        ratio = log[rows, 1, ballot + 1] - log[rows, 0, ballot + 1]
        return 1 / (1 + np.exp(-(np.log(self.prior / (1 - self.prior)) + ratio @ self.weights).clip(-30, 30)))


def fit_label_model(ballot: np.ndarray, prior: float, rounds: int = 25) -> LabelModel:
    """Expectation and maximisation from a majority start; correlated voters share weight.

    The share of toxic rows, ``prior``, is known from the labels and stays.
    """
    count = ballot.shape[1]
    prior = min(max(prior, 0.01), 0.99)
    # To begin with, the rows with the most toxic votes are as many as the share says.
    votes_for = ballot.sum(1)
    bound = max(np.quantile(votes_for, 1 - prior), 1)
    chance = np.where(votes_for >= bound, 0.9, 0.05)
    weights, correlation = np.ones(count), np.zeros((count, count))
    model = None
    for step in range(rounds):
        votes = np.empty((count, 2, 3))
        for side, share in enumerate((1 - chance, chance)):
            for vote in range(3):
                votes[:, side, vote] = ((ballot + 1 == vote) * share[:, None]).sum(0) + 0.5
        votes /= votes.sum(2, keepdims=True)
        # What is left of the votes once each class's mean is taken off.
        means = [(ballot * s[:, None]).sum(0) / max(s.sum(), 1e-9) for s in (1 - chance, chance)]
        rest = ballot - ((1 - chance)[:, None] * means[0] + chance[:, None] * means[1])
        spread = np.sqrt((rest**2).mean(0)) + 1e-9
        correlation = (rest.T @ rest) / len(ballot) / np.outer(spread, spread)
        np.fill_diagonal(correlation, 0)
        weights = 1 / (1 + np.where(correlation > LEAST_CORRELATION, correlation, 0).sum(1))
        model = LabelModel(votes, prior, weights, correlation)
        chance = model.posterior(ballot)
    return model


@dataclass
class ToxicityModel:
    """A weight for each slot in use, the bias, and the scaling to chances."""

    slots: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def scorer(self):
        """A function from a text to its score, with a bounded store of words."""
        by_slot = dict(zip(self.slots.tolist(), self.weights.tolist(), strict=True))
        bases = {slot - slot % 4 for slot in by_slot}
        known = lru_cache(CACHED_WORDS)(lambda word: tuple(s for s in terms_of(word) if s in bases))

        def score(text: str | None) -> float:
            counted = ((word, n) for word, n in Counter(words_of(text)).items() if known(word))
            used = [slot for slot in slots_of(counted, known) if slot in by_slot]
            raw = self.bias + sum(by_slot[s] for s in sorted(used))
            return float(1 / (1 + np.exp(-np.clip(self.slope * raw + self.shift, -30, 30))))

        return score


class Lexicon:
    """Terms that mark toxic texts, dealt to voters by kind."""

    def __init__(self, positive: np.ndarray, negative: np.ndarray, toxic: int, clean: int) -> None:
        gain = np.log((positive + 0.5) / (toxic + 1)) - np.log((negative + 0.5) / (clean + 1))
        # How far the toxic rows with a term exceed their expected number, in standard deviations.
        expected = (positive + negative) * toxic / max(toxic + clean, 1)
        surprise = (positive - expected) / np.sqrt(expected + 1)
        strong = np.flatnonzero((positive >= 3) & (gain > 1.5) & (surprise > 4))
        strong = strong[np.argsort(-surprise[strong], kind="stable")]
        self.voter_of: dict[int, int] = {}
        shares = np.repeat(np.arange(len(SHARES)), SHARES)
        for kind in range(KINDS):
            for level in range(len(LEVELS)):
                own = strong[(strong % STEP // 4 == kind) & (strong % 4 == level)][: sum(SHARES)]
                first = (kind * len(LEVELS) + level) * len(SHARES)
                self.voter_of.update({int(s): int(first + v) for s, v in zip(own, shares, strict=False)})

    def ballot(self, slots: list[np.ndarray], capitals: np.ndarray, repeats: np.ndarray) -> np.ndarray:
        votes = np.zeros((len(slots), VOTERS + 4), np.int8)
        for row, found in enumerate(slots):
            held = [self.voter_of[s] for s in found.tolist() if s in self.voter_of]
            votes[row, held] = 1
            votes[row, VOTERS] = 1 if len(held) >= 6 else 0
            votes[row, VOTERS + 1] = 0 if held else -1
            votes[row, VOTERS + 2] = -1 if capitals[row] > 0.5 and not held else 0
            votes[row, VOTERS + 3] = -1 if repeats[row] > 0.6 and not held else 0
        return votes


def _logistic(x_rows, x_columns, targets, size, penalty, rounds=300):
    """Weights and bias of a penalised logistic regression on sparse 0/1 features."""
    weights, bias = np.zeros(size), 0.0
    count = len(targets)
    moment, second, moments_b = np.zeros(size), np.zeros(size), [0.0, 0.0]
    for step in range(1, rounds + 1):
        raw = bias + np.bincount(x_rows, weights[x_columns], minlength=count)
        off = 1 / (1 + np.exp(-np.clip(raw, -30, 30))) - targets
        grad = np.bincount(x_columns, off[x_rows], minlength=size) / count + penalty * weights
        grad_b = off.mean()
        moment = 0.9 * moment + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        moments_b = [0.9 * moments_b[0] + 0.1 * grad_b, 0.999 * moments_b[1] + 0.001 * grad_b**2]
        a, b = 1 - 0.9**step, 1 - 0.999**step
        weights -= 0.05 * (moment / a) / (np.sqrt(second / b) + 1e-8)
        bias -= 0.05 * (moments_b[0] / a) / (np.sqrt(moments_b[1] / b) + 1e-8)
    return weights, bias


def fit(
    docs: DataFrame,
    labels: DataFrame,
    keep: Column | None = None,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    rows: int = TRAIN_ROWS,
) -> ToxicityModel:
    """Learn from labelled rows that ``keep``, a condition on the key, admits.

    About ``rows`` of them at most are used. Rows with a null text or label
    teach nothing; of contradicting labels for a key the higher one counts.
    With no toxic or no clean row, all scores are that share.
    """
    table = sample(docs, labels, keep, key, text, label, rows).toArrow()
    table = table.sort_by("row")  # rows arrive in any order; sums should not
    truth = table["toxic"].to_numpy().astype(int)
    if not len(truth) or truth.min() == truth.max():
        share = float(truth.mean()) if len(truth) else 0.0
        return ToxicityModel(np.zeros(0, int), np.zeros(0), float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    slots = [np.frombuffer(s.as_py(), np.int32) for s in table["slots"]]
    flat = np.concatenate(slots)
    owner = np.repeat(np.arange(len(slots), dtype=np.int32), [len(s) for s in slots])
    everything = np.bincount(flat, minlength=SLOTS)
    positive = np.bincount(flat[truth[owner] == 1], minlength=SLOTS)
    toxic = int(truth.sum())
    lexicon = Lexicon(positive, everything - positive, toxic, len(truth) - toxic)
    ballot = lexicon.ballot(slots, table["capitals"].to_numpy(), table["repeats"].to_numpy())
    soft = fit_label_model(ballot, toxic / len(truth)).posterior(ballot)

    # Terms that the posterior labels set apart the most.
    with_term = np.bincount(flat, soft[owner], minlength=SLOTS)
    expected = everything * soft.mean()
    apart = np.where(everything >= 3, (with_term - expected) ** 2 / (expected + 1), 0)
    most = min(CLASSIFIER_TERMS, max(LEAST_TERMS, len(truth) // ROWS_PER_TERM))
    used = np.sort(np.argsort(-apart, kind="stable")[:most])
    used = used[apart[used] > 0]
    column = np.full(SLOTS, -1)
    column[used] = np.arange(len(used))
    inside = column[flat] >= 0
    x_rows, x_columns = owner[inside], column[flat[inside]]
    weights, bias = _logistic(x_rows, x_columns, soft, len(used), 1e-4)
    raw = bias + np.bincount(x_rows, weights[x_columns], minlength=len(truth))
    slope, shift = _scale(raw, truth)
    return ToxicityModel(used, weights, float(bias), slope, shift)


def _scale(raw: np.ndarray, truth: np.ndarray) -> tuple[float, float]:
    """Slope and shift that turn raw sums into chances of the labels."""
    slope, shift = 1.0, 0.0
    for _ in range(200):
        chance = 1 / (1 + np.exp(-np.clip(slope * raw + shift, -30, 30)))
        off, curve = chance - truth, chance * (1 - chance) + 1e-6
        # Rows that the sums part without error would drive the slope up for ever; the penalty holds it.
        gradient = np.array([(off * raw).mean() + 0.01 * (slope - 1), off.mean() + 0.01 * shift])
        hessian = np.array(
            [[(curve * raw * raw).mean() + 0.01, (curve * raw).mean()], [(curve * raw).mean(), curve.mean() + 0.01]]
        )
        step = np.clip(np.linalg.solve(hessian, gradient), -0.5, 0.5)
        slope, shift = slope - step[0], shift - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(max(slope, 1e-3)), float(shift)


def score_documents(
    docs: DataFrame, model: ToxicityModel, key: str = "doc_id", text: str = "text", bound: float = 0.3
) -> DataFrame:
    """Key, ``score`` and ``predicted`` (1 from ``bound`` on) of every whole text.

    A null or empty text has no terms and gets the score of the bias alone.
    Equal texts get equal scores. Other columns are not read.
    """
    source = only(docs, key, text)
    schema = T.StructType(
        [
            T.StructField(key, source.schema[key].dataType),
            T.StructField("score", T.DoubleType()),
            T.StructField("predicted", T.IntegerType()),
        ]
    )

    def start():
        score = model.scorer()

        def work(batch):
            scores = [score(content) for content in batch.column(1).to_pylist()]
            return {key: batch.column(0), "score": scores, "predicted": [int(s >= bound) for s in scores]}

        return work

    return arrow_map(source, start, schema)
