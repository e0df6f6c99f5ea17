from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from mercato.llm import periodic_runs as p
from mercato.llm.queries import LLM_QUERIES


def brute_runs(words, least_length=24):
    """All periods tried at all places; a stretch counts for its smallest period."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least_length, 3 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((start, end - start, q) for (start, end), q in found.items())


def plain(runs):
    return [tuple(run) for run in runs]


@given(st.lists(st.integers(0, 2), max_size=90), st.integers(1, 8))
@settings(max_examples=300, deadline=None)
def test_few_letters_equal_brute_force(words, least):
    assert plain(p.runs_of([words], least)[0]) == brute_runs(words, least)


@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=7), st.integers(1, 9)), max_size=9))
@settings(max_examples=200, deadline=None)
def test_powers_and_their_borders_equal_brute_force(parts):
    words = [w for root, times in parts for w in root * times]
    assert plain(p.runs_of([words])[0]) == brute_runs(words)
    assert plain(p.runs_of([words], 3)[0]) == brute_runs(words, 3)


def test_word_by_word_reports_the_same_runs():
    random.seed(5)
    for _ in range(40):
        words = [w for _ in range(6) for w in [random.randrange(4) for _ in range(random.randint(1, 9))] * random.randint(1, 7)]
        one, many, whole = p.SquareCatchers(), p.SquareCatchers(), p.SquareCatchers()
        for w in words:
            one.append([w])
        at = 0
        while at < len(words):
            step = random.randint(1, 17)
            many.append(words[at : at + step])
            at += step
        whole.append(words)
        assert one.runs(3) == many.runs(3) == whole.runs(3) == [p.Run(*r) for r in brute_runs(words, 3)]
        assert all(len(kept) <= 4 << level for level, (_, kept) in enumerate(one._levels))


def test_texts_do_not_meet_and_long_periods_are_found():
    words = [str(i) for i in range(5000)]
    texts = [["a"] * 23, ["a"] * 24, [], words * 3 + words[:17], ["x"] + words[:9] * 3]
    assert [plain(runs) for runs in p.runs_of(texts)] == [
        [], [(0, 24, 1)], [], [(0, 15017, 5000)], [(1, 27, 9)]
    ]
    assert p.runs_of([]) == []


def test_collapsed_words():
    words = "x a b a b a b a b a b a b a b a b a b a b a b a b y".split()
    (runs,) = p.runs_of([words])
    assert plain(runs) == [(1, 24, 2)] and p.without_repeats(words, runs) == ["x", "a", "b", "y"]


def test_long_texts_of_one_word_are_quick():
    catchers = p.SquareCatchers()
    catchers.append(np.zeros(400_000, np.int64))
    assert plain(catchers.runs()) == [(0, 400_000, 1)]
    catchers.append(np.tile(np.arange(1000), 200))
    assert plain(catchers.runs()) == [(0, 400_001, 1), (400_000, 200_000, 1000)]


def digests(words):
    runs = brute_runs(words)
    gone = {i for start, length, q in runs for i in range(start + q, start + length)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return len(runs), *best, milli, *(hashlib.sha256(x.encode()).hexdigest() for x in (listed, kept))


def test_query_equals_brute_force(spark, sf_dir):
    import re

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    rows = {r.doc_id: r for r in LLM_QUERIES["op13_periodic_runs"](spark, sf_dir).collect()}
    assert len(rows) == len(docs)
    found = 0
    for doc in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", doc.text or "")
        if len(words) > 1500:
            continue
        h, n = zlib.crc32(str(doc.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            period = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % period] for i in range(a, n)]
        row = rows[doc.doc_id]
        assert tuple(row[c] for c in (
            "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"
        )) == digests(words), doc.doc_id
        found += row.n_runs
    assert found > 5


def test_odd_rows(spark, odd_texts, odd_docs, no_docs):
    rows = p.find_runs(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by_id = {r.doc_id: r for r in rows}
    assert [(by_id[i].n_words, by_id[i].runs, by_id[i].collapsed) for i in (0, 1, 2)] == [(0, [], "")] * 3
    assert by_id[8].n_words == 48_000 and plain(by_id[8].runs) == [(0, 48_000, 16)]
    assert len(by_id[8].collapsed.split()) == 16
    assert None in by_id and by_id[9].collapsed == odd_texts[9]
    assert p.find_runs(no_docs).count() == 0
    # Only the six ASCII white-space characters part words.
    strange = spark.createDataFrame([(1, "a\x1c\x85b　c\x0bd\x0ce")], "doc_id long, text string")
    assert p.find_runs(strange).first().n_words == 3
