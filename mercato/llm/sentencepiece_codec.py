"""SentencePiece encoding and decoding for merge-type vocabularies.

A text becomes a row of symbols, at first one per character, with ``▁`` for a
space and one ``▁`` put in front. An agenda holds every adjacent pair whose
joined text is in the vocabulary, ordered by score and then by place; the best
pair is merged, its new neighbours join the agenda, until the agenda is empty.
Symbols outside the vocabulary are spelled in byte pieces.

Where no piece has a ``▁`` behind another character, no merge crosses from one
run of ``▁`` plus word to the next, so these chunks are encoded one by one and
kept in a bounded store. Every chunk that enters the store is compared with the
sentencepiece library, a batch at a time; a difference is an error.
"""

from __future__ import annotations

import hashlib
import heapq
import re

import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from mercato.llm.common import arrow_map, kept, only

SPACE = "▁"
#: Chunks in each of the two generations of a worker's store, about 250 bytes each.
STORE_SIZE = 200_000
#: Longer chunks are encoded each time, so that the store's memory is bounded.
STORED_LENGTH = 64

#: Chunks up to this length have a plain list as agenda, longer ones a heap.
FLAT_LENGTH = 32
NONE = float("inf")

_CHUNK = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class PieceVocabulary:
    """Pieces, scores and byte pieces of a model file, and the agenda over them."""

    def __init__(self, path: str) -> None:
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        count = self.library.get_piece_size()
        self.pieces = [self.library.id_to_piece(i) for i in range(count)]
        self.bytes_at: dict[int, int] = {}
        self.cost: dict[str, float] = {}  # minus the score
        self.id_of: dict[str, int] = {}
        self.control = {i for i in range(count) if self.library.is_control(i)}
        for i, piece in enumerate(self.pieces):
            if self.library.is_byte(i):
                self.bytes_at[i] = int(piece[3:-1], 16)
            elif not (i in self.control or self.library.is_unknown(i) or self.library.is_unused(i)):
                self.cost[piece] = -self.library.get_score(i)
                self.id_of[piece] = i
        self.byte_ids = {value: i for i, value in self.bytes_at.items()}
        self.end_id = self.library.eos_id()
        if any(SPACE in piece.lstrip(SPACE) for piece in self.id_of):
            raise ValueError("the vocabulary has pieces that reach over a word's start")
        if len(self.byte_ids) != 256:
            raise ValueError("the vocabulary has no byte pieces")

    def encode_chunk(self, chunk: str) -> list[int]:
        """Ids of one chunk, by merging the best adjacent pair until none is left."""
        if len(chunk) <= FLAT_LENGTH:
            return self.spell(self._merge_flat(chunk))
        return self.spell(self._merge_heap(chunk))

    def _merge_flat(self, chunk: str) -> list[str]:
        """The agenda of a short chunk is a plain list of scores, one for each adjacent pair."""
        cost = self.cost.get
        symbols = list(chunk)
        agenda = [cost(a + b, NONE) for a, b in zip(symbols, symbols[1:])]
        while agenda:
            best = min(agenda)
            if best == NONE:
                break
            at = agenda.index(best)  # the leftmost of equal scores
            joined = symbols[at] = symbols[at] + symbols.pop(at + 1)
            del agenda[at]
            if at < len(agenda):
                agenda[at] = cost(joined + symbols[at + 1], NONE)
            if at:
                agenda[at - 1] = cost(symbols[at - 1] + joined, NONE)
        return symbols

    def _merge_heap(self, chunk: str) -> list[str]:
        """The agenda of a long chunk is a heap; entries that merges have overtaken are skipped."""
        cost = self.cost
        symbols: list[str | None] = list(chunk)
        size = len(symbols)
        after = list(range(1, size + 1))
        before = list(range(-1, size - 1))
        agenda = []

        def propose(left: int, right: int) -> None:
            joined = symbols[left] + symbols[right]
            if joined in cost:
                heapq.heappush(agenda, (cost[joined], left, joined))

        for left in range(size - 1):
            propose(left, left + 1)
        while agenda:
            _, left, joined = heapq.heappop(agenda)
            right = after[left]
            if symbols[left] is None or right >= size or symbols[left] + symbols[right] != joined:
                continue
            symbols[left], symbols[right] = joined, None
            follower = after[left] = after[right]
            if follower < size:
                before[follower] = left
                propose(left, follower)
            if before[left] >= 0:
                propose(before[left], left)
        return [symbol for symbol in symbols if symbol is not None]

    def spell(self, symbols: list[str]) -> list[int]:
        """Ids of symbols; one that is no piece becomes byte pieces."""
        ids: list[int] = []
        for symbol in symbols:
            found = self.id_of.get(symbol)
            if found is None:
                ids.extend(self.byte_ids[value] for value in symbol.encode())
            else:
                ids.append(found)
        return ids

    def decode_pieces(self, ids: list[int]) -> str:
        """Text of ids, runs of byte pieces read as UTF-8; control pieces have no text."""
        parts: list[bytes] = []
        for i in ids:
            if i in self.bytes_at:
                parts.append(bytes((self.bytes_at[i],)))
            elif i not in self.control:
                parts.append(self.pieces[i].encode())
        return b"".join(parts).decode("utf-8", "replace").replace(SPACE, " ")

    def decode(self, ids: list[int]) -> str:
        """Text of a whole row of ids: the space put in front goes."""
        return self.decode_pieces(ids).removeprefix(" ")

    def check(self, chunks: list[str], encoded: list[list[int]]) -> None:
        """Compare chunks, given without their first ``▁``, with the library, which puts it there."""
        asked = [i for i, chunk in enumerate(chunks) if chunk]
        expected = self.library.encode([chunks[i] for i in asked], num_threads=1)
        for i, ids in zip(asked, expected, strict=True):
            if ids != encoded[i]:
                raise ValueError(f"encoding differs from the library on {chunks[i][:80]!r}")


def chunks_of(text: str) -> list[str]:
    """The chunks of a text with its spaces escaped and one ``▁`` in front.

    Every chunk begins with ``▁``, which is left out here.
    """
    if not text:
        return []
    if SPACE not in text and "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")  # single spaces only: each word has its own mark
    return [chunk[1:] for chunk in _CHUNK.findall(SPACE + text.replace(" ", SPACE))]


def vocabulary(path: str) -> PieceVocabulary:
    return PieceVocabulary(path)


class Codec:
    """Encodes and decodes texts through a bounded store of chunks.

    The store has two generations: when the young one is full it becomes the
    old one, and chunks found in the old one are taken over.
    """

    def __init__(self, path: str) -> None:
        self.vocabulary = vocabulary(path)
        self.young: dict[str, str] = {}
        self.old: dict[str, str] = {}
        #: Chunks whose decoded text isn't the chunk itself with spaces for marks.
        self.altered: dict[str, str] = {}

    def learn(self, chunks: list[str]) -> dict[str, str]:
        """Decimal ids of chunks, checked against the library; decodes them as well."""
        encode, decode = self.vocabulary.encode_chunk, self.vocabulary.decode_pieces
        encoded = [encode(SPACE + chunk) for chunk in chunks]
        self.vocabulary.check(chunks, encoded)
        for chunk, ids in zip(chunks, encoded, strict=True):
            text = decode(ids)
            if text != " " + chunk.replace(SPACE, " "):
                self.altered[chunk] = text
        return {chunk: " ".join(map(str, ids)) for chunk, ids in zip(chunks, encoded, strict=True)}

    def rows(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """Number of ids, ids as text and decoded text of each text."""
        if len(self.young) > STORE_SIZE:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        split = [chunks_of(text or "") for text in texts]
        spelled = [list(map(young.get, chunks)) for chunks in split]
        unknown = [i for i, ids in enumerate(spelled) if None in ids]
        asked = {
            chunk
            for i in unknown
            for chunk, ids in zip(split[i], spelled[i], strict=True)
            if ids is None
        }
        known = {chunk: old[chunk] for chunk in asked if chunk in old}
        known |= self.learn([chunk for chunk in asked if chunk not in known])
        for i in unknown:
            spelled[i] = [
                known[chunk] if ids is None else ids
                for chunk, ids in zip(split[i], spelled[i], strict=True)
            ]
        young.update((chunk, ids) for chunk, ids in known.items() if len(chunk) <= STORED_LENGTH)
        end = str(self.vocabulary.end_id)
        out = []
        for chunks, row in zip(split, spelled, strict=True):
            row.append(end)
            ids = " ".join(row)
            if self.altered:
                text = "".join([self.altered.get(c) or " " + c.replace(SPACE, " ") for c in chunks])
                text = text.removeprefix(" ")
            else:
                text = " ".join(chunks).replace(SPACE, " ")
            out.append((ids.count(" ") + 1, ids, text))
        return out


def encode_documents(
    docs: DataFrame,
    model_path: str,
    key: str = "doc_id",
    text: str = "text",
    keep_ids: bool = False,
    keep_text: bool = False,
) -> DataFrame:
    """Encode every whole text, with an end id, and decode the ids again.

    Returns the key, ``n_tokens``, ``ids_sha256`` (of the decimal ids joined
    by one space) and ``decoded_sha256``; with ``keep_ids`` also ``ids``, with
    ``keep_text`` also ``decoded``. A null text counts as empty and has the
    end id alone. Repeated rows give repeated results, an empty table none;
    other columns are not read.
    """
    source = only(docs, key, text)
    fields = [
        T.StructField(key, source.schema[key].dataType),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]
    if keep_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    if keep_text:
        fields.append(T.StructField("decoded", T.StringType()))

    def start():
        # One codec for each worker process, kept while the worker does no other operator's work.
        codec = kept(model_path, lambda: Codec(model_path))

        def work(batch):
            rows = codec.rows(batch.column(1).to_pylist())
            out = {
                key: batch.column(0),
                "n_tokens": [row[0] for row in rows],
                "ids_sha256": [hashlib.sha256(row[1].encode()).hexdigest() for row in rows],
                "decoded_sha256": [hashlib.sha256(row[2].encode()).hexdigest() for row in rows],
            }
            if keep_ids:
                out["ids"] = [[int(i) for i in row[1].split(" ")] for row in rows]
            if keep_text:
                out["decoded"] = [row[2] for row in rows]
            return out

        return work

    return arrow_map(source, start, T.StructType(fields))
