"""Main text of HTML pages by a linear-chain conditional random field.

A page is the sequence of its leaf blocks. Each block has features from its
ancestors (element names, words of class, id and role) and from its text (length,
links, punctuation, place); each pair of neighbours has one for the two labels.
The weights are trained on labelled pages by maximum likelihood with
forward and backward sums; Viterbi decoding finds the most likely
labels of a page, and the blocks labelled as article are its text.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from mercato.llm.common import arrow_map, only
from mercato.llm.html_blocks import Block, blocks_of, plain
from mercato.llm.labelled_pages import labelled_pages

FEATURE_BITS = 13
FEATURES = 1 << FEATURE_BITS
#: Labelled pages the query's model is trained on.
TRAIN_PAGES = 800
MARKS = (".", "?", ";", "。")


@lru_cache(maxsize=50_000)
def _slot(name: str) -> int:
    return zlib.crc32(name.encode()) % FEATURES


def features_of(block: Block, place: int, count: int) -> list[int]:
    """Slots of a block's features; each counts once."""
    text = block.text
    length = len(text)
    names = {"bias", f"own:{block.tags[-1] if block.tags else ''}"}
    names.update(f"in:{tag}" for tag in block.tags)
    names.update(f"mark:{mark}" for mark in block.marks)
    if not block.marks:
        names.add("no-mark")
    names.add(f"length:{min(length.bit_length(), 11)}")
    names.add(f"links:{min(int(4 * block.link_chars / max(length, 1)), 4)}")
    names.add(f"stops:{min(sum(map(text.count, MARKS)), 3)}")
    names.add(f"first:{min(place, 2)}")
    names.add(f"last:{min(count - 1 - place, 2)}")
    if "©" in text:
        names.add("copyright")
    return [_slot(name) for name in names]


@dataclass
class BlockModel:
    """Weights of the features for both labels, and of the steps between labels."""

    weights: np.ndarray  # feature, label
    steps: np.ndarray  # label before, label

    def labels(self, blocks: list[Block]) -> list[int]:
        """Most likely labels by Viterbi; of equal ones the label 0 wins."""
        if not blocks:
            return []
        count = len(blocks)
        own = [self.weights[features_of(b, i, count)].sum(0) for i, b in enumerate(blocks)]
        (s00, s01), (s10, s11) = self.steps.tolist()
        zero, one = own[0].tolist()
        back: list[tuple[int, int]] = []
        for block in own[1:]:
            add0, add1 = block.tolist()
            from0 = 1 if one + s10 > zero + s00 else 0
            from1 = 1 if one + s11 > zero + s01 else 0
            back.append((from0, from1))
            zero, one = (
                (one + s10 if from0 else zero + s00) + add0,
                (one + s11 if from1 else zero + s01) + add1,
            )
        label = 1 if one > zero else 0
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]

    def extract(self, page: str | None) -> str:
        blocks = blocks_of(page)
        chosen = [plain(b.text) for b, label in zip(blocks, self.labels(blocks), strict=True) if label]
        return "\n\n".join(text for text in chosen if text)


def train(pages: list[tuple[list[list[int]], list[int]]], rounds: int = 200, penalty: float = 1e-4) -> BlockModel:
    """Maximum likelihood over pages given as features and labels of their blocks."""
    pages = [page for page in pages if page[1]]
    weights, steps = np.zeros((FEATURES, 2)), np.zeros((2, 2))
    if not pages:
        return BlockModel(weights, steps)
    longest, count = max(len(labels) for _, labels in pages), len(pages)
    lengths = np.array([len(labels) for _, labels in pages])
    there = np.arange(longest)[None, :] < lengths[:, None]
    truth = np.zeros((count, longest), int)
    owner, slot = [], []
    for p, (features, labels) in enumerate(pages):
        truth[p, : len(labels)] = labels
        for t, some in enumerate(features):
            owner.extend([p * longest + t] * len(some))
            slot.extend(some)
    owner, slot = np.array(owner), np.array(slot)
    hit = np.eye(2)[truth] * there[:, :, None]
    both = there[:, 1:]
    seen_steps = np.einsum("pta,ptb->ab", hit[:, :-1], hit[:, 1:] * both[:, :, None])
    moments = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(steps), np.zeros_like(steps)]
    for step in range(1, rounds + 1):
        own = np.stack(
            [np.bincount(owner, weights[slot, label], minlength=count * longest) for label in (0, 1)], -1
        ).reshape(count, longest, 2)
        forward, backward = np.zeros_like(own), np.zeros_like(own)
        forward[:, 0] = own[:, 0]
        for t in range(1, longest):
            reach = np.logaddexp(*(forward[:, t - 1, a, None] + steps[a] for a in (0, 1))) + own[:, t]
            forward[:, t] = np.where(there[:, t, None], reach, forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            ahead = own[:, t + 1] + backward[:, t + 1]
            reach = np.logaddexp(*(ahead[:, b, None] + steps[:, b] for b in (0, 1)))
            backward[:, t] = np.where(there[:, t + 1, None], reach, 0)
        whole = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        single = np.exp(forward + backward - whole[:, None, None]) * there[:, :, None]
        pair = np.exp(
            forward[:, :-1, :, None] + steps + (own + backward)[:, 1:, None, :] - whole[:, None, None, None]
        ) * both[:, :, None, None]
        off = (single - hit).reshape(-1, 2)
        grad = np.stack([np.bincount(slot, off[owner, label], minlength=FEATURES) for label in (0, 1)], -1) / count
        grad += penalty * weights
        grad_steps = (pair.sum((0, 1)) - seen_steps) / count + penalty * steps
        for k, (value, slope) in enumerate(((weights, grad), (steps, grad_steps))):
            first, second = moments[2 * k], moments[2 * k + 1]
            first *= 0.9
            first += 0.1 * slope
            second *= 0.99
            second += 0.01 * slope**2
            value -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return BlockModel(weights, steps)


def examples(pages: list[tuple[str, list[tuple[str, int]]]]) -> list[tuple[list[list[int]], list[int]]]:
    """Features and labels of labelled pages; a block takes the label of the text it begins with."""
    out = []
    for page, labelled in pages:
        blocks = blocks_of(page)
        waiting = [(plain(text), label) for text, label in labelled if plain(text)]
        labels, at = [], 0
        for block in blocks:
            text = plain(block.text)
            while at < len(waiting) and not text.startswith(waiting[at][0]):
                at += 1
            if at == len(waiting):
                break
            labels.append(waiting[at][1])
            at += 1
        blocks = blocks[: len(labels)]
        out.append(([features_of(b, i, len(blocks)) for i, b in enumerate(blocks)], labels))
    return out


@lru_cache(maxsize=2)
def trained_model(pages: int = TRAIN_PAGES) -> BlockModel:
    return train(examples(labelled_pages(pages)))


def extract_pages(
    pages: DataFrame,
    model: BlockModel | None = None,
    key: str = "page_id",
    url: str = "url",
    page: str = "html",
) -> DataFrame:
    """Key, URL, ``text`` and ``n_chars`` of every row, from the whole page.

    Blocks of the article come in page order with an empty line between them.
    A null, empty or article-free page has the empty text. Equal pages get equal
    texts; other columns are not read.
    """
    model = model or trained_model()
    source = only(pages, key, url, page)
    schema = T.StructType(
        [
            T.StructField(key, source.schema[key].dataType),
            T.StructField(url, source.schema[url].dataType),
            T.StructField("text", T.StringType()),
            T.StructField("n_chars", T.LongType()),
        ]
    )

    def start():
        def work(batch):
            texts = [model.extract(content) for content in batch.column(2).to_pylist()]
            return {key: batch.column(0), url: batch.column(1), "text": texts, "n_chars": [len(t) for t in texts]}

        return work

    return arrow_map(source, start, schema, rows=64)
