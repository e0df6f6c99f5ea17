from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mercato.llm import induced_sorting as sa
from mercato.llm import suffix_dedup as s
from mercato.llm.queries import LLM_QUERIES


def brute(texts, width):
    """Kept bytes, removed bytes and spans by counting every string."""
    count = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    results = []
    for t in texts:
        gone = np.zeros(len(t) + 2, bool)
        for i in range(len(t) - width + 1):
            if count[t[i : i + width]] > 1:
                gone[i + 1 : i + 1 + width] = True
        kept = bytes(b for b, out in zip(t, gone[1:-1]) if not out)
        results.append((kept, int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum())))
    return results


@given(st.lists(st.lists(st.binary(max_size=24).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=4), min_size=1, max_size=6))
@settings(max_examples=250, deadline=None)
def test_suffix_arrays_and_common_prefixes(groups):
    groups.sort(key=lambda pieces: -sum(map(len, pieces)) - len(pieces))
    text, lengths = sa.joined(groups)
    arrays = sa.suffix_arrays(text, lengths)
    before, shared = sa.common_prefixes(text, lengths, arrays)
    base = 0
    for column, length in enumerate(lengths):
        line = text[:length, column].tolist()
        order = sorted(range(length), key=lambda i: line[i:])
        assert (arrays[:length, column] // text.shape[1]).tolist() == order
        assert before[base + order[0]] == -1
        for a, b in zip(order, order[1:]):
            same = 0
            while line[a + same] == line[b + same] and line[a + same] > sa.MARK:
                same += 1
            assert before[base + b] == base + a and shared[base + b] == same
        base += length


def test_powers_and_long_stretches_of_one_byte():
    groups = [[b"a" * 300 + b"b" + b"a" * 300], [b"ab" * 250, b"ba" * 10]]
    groups.sort(key=lambda pieces: -sum(map(len, pieces)) - len(pieces))
    text, lengths = sa.joined(groups)
    arrays = sa.suffix_arrays(text, lengths)
    for column, length in enumerate(lengths):
        line = text[:length, column].tolist()
        assert (arrays[:length, column] // text.shape[1]).tolist() == sorted(range(length), key=lambda i: line[i:])


def corpus(seed, letters=b"abcdefghij "):
    random.seed(seed)
    new = lambda n: bytes(random.choices(letters, k=n))
    passage, texts = new(90), [b"", new(7), new(300)]
    for _ in range(40):
        cut = random.randint(0, 60)
        texts.append(new(random.randint(0, 80)) + passage[cut : cut + random.randint(20, 90)] + new(random.randint(0, 50)))
    texts += [texts[5], texts[5], texts[2] + new(30), new(3) * 40, b"z" * 200, new(25) + b"z" * 60]
    edited = bytearray(texts[2])
    for _ in range(30):
        edited[random.randrange(300)] = ord("x")
        texts.append(bytes(edited))
    return texts


@pytest.mark.parametrize("limit", [16, 2])
def test_equals_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(s, "SHARD_PIECES", limit)
    monkeypatch.setattr(s, "PART_BYTES", 90)
    monkeypatch.setattr(s, "SORT_BYTES", 4000)
    for seed in (1, 2):
        texts = corpus(seed, b"ab" if seed == 2 else b"abcdefghij ")
        docs = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string")
        rows = s.remove_repeats(docs.repartition(5), rule=s.RepeatRule(width=32, anchor=10)).collect()
        assert len(rows) == len(texts)
        want = brute(texts, 32)
        for r in rows:
            got = (bytes(r.kept), sum(x.end - x.begin for x in r.spans), len(r.spans))
            assert got == want[r.doc_id], (seed, r.doc_id)


def test_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    texts = [(d.text or "").encode() for d in docs]
    rows = {r.doc_id: r for r in LLM_QUERIES["op11_suffix_dedup"](spark, sf_dir).collect()}
    assert len(rows) == len(docs) and sum(r.n_removed for r in rows.values()) > 10_000
    for doc, text, (kept, removed, spans) in zip(docs, texts, brute(texts, 400)):
        r = rows[doc.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(text), removed, spans)
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()


def test_odd_rows(spark, odd_docs, no_docs, odd_texts):
    rows = s.remove_repeats(odd_docs).collect()
    assert len(rows) == odd_docs.count() and set(odd_docs.columns) <= {*rows[0].asDict()} | {"kept"}
    by_id = {r.doc_id: r for r in rows}
    assert by_id[0].kept is None and by_id[0].spans == [] and by_id[1].kept == b""
    assert [tuple(x) for x in by_id[8].spans] == [(0, len(odd_texts[8]))] and by_id[8].kept == b""
    # The passage is shorter than a repeat has to be.
    assert bytes(by_id[5].kept).decode() == odd_texts[5] and None in by_id
    assert s.remove_repeats(no_docs).count() == 0
    # A cut may part a character.
    texts = ["é" * 300 + "a", "x" + "é" * 300]
    pair = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: bytes(r.kept) for r in s.remove_repeats(pair).collect()} == {0: b"a", 1: b"x"}
