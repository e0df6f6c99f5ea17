"""The join against all pairs on small inputs."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pytest

from mercato.llm import ngram_join as join
from mercato.llm.common import ROWS_SENT, ROWS_SENT_KEY, small_batches
from mercato.llm.queries import LLM_QUERIES


def by_brute_force(rows, width=4, percent=85):
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        count = max(len(words) - width + 1, 1) if words else 0
        sets.append({tuple(words[i : i + width]) for i in range(count)})
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[root(i)] = root(j)
    groups = {}
    for i, (key, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(key)
    names = {g: min((k for k in keys if k is not None), default=None) for g, keys in groups.items()}
    return sorted((repr(key), len(s), names[root(i)]) for i, ((key, _), s) in enumerate(zip(rows, sets)))


def result(frame):
    return sorted((repr(r[0]), r[1], r[2]) for r in frame.collect())


def copies(seed: int, groups: int, size: int) -> list[tuple[int, str]]:
    """Groups of near copies at all distances around the bound, with shared passages."""
    pick = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    shared = pick.choices(words, k=40)
    rows = []
    for _ in range(groups):
        base = pick.choices(words, k=pick.randint(3, 120))
        if pick.random() < 0.5:
            base += shared
        for _ in range(pick.randint(1, size)):
            text = list(base)
            for _ in range(pick.randint(0, 5)):
                text[pick.randrange(len(text))] = pick.choice(words)
            if pick.random() < 0.3:
                text = text[: pick.randint(len(text) // 2, len(text))]
            rows.append((len(rows), " ".join(text)))
    return rows


@pytest.mark.parametrize("classes", [(8, 256), (1, 3), (1, 1)])
def test_equals_all_pairs(spark, classes, monkeypatch):
    monkeypatch.setattr(join, "HOT_SETS", 4)
    rows = copies(3, 25, 14)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = join.near_duplicates(docs, rule=join.JoinRule(classes=classes))
    assert result(found) == by_brute_force(rows)


def test_one_large_group_of_near_copies(spark):
    pick = random.Random(5)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(300):
        text = list(base)
        for _ in range(pick.randint(0, 8)):
            text[pick.randrange(150)] = f"x{pick.randrange(10**6)}"
        rows.append((i, " ".join(text)))
    found = join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert result(found) == by_brute_force(rows)


def test_odd_rows(odd_docs, odd_texts, no_docs):
    rows = [*enumerate(odd_texts), (None, "the same null id"), (5, odd_texts[5])]
    assert result(join.near_duplicates(odd_docs)) == by_brute_force(rows)
    assert join.near_duplicates(no_docs).count() == 0
    kept = join.keep_one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=lambda i: (i is None, i or 0))
    # 6 and 7 are copies of 5 (case does not count); the repeated row 5 stays with its kept key.
    assert ids == [0, 1, 2, 3, 4, 5, 5, 8, 9, None]


def test_whole_table_against_sql(spark, sf_dir, duck):
    from mercato.llm.sql import NGRAM_JOIN

    assert result(LLM_QUERIES["op3_ngram_join"](spark, sf_dir)) == sorted(
        (repr(a), b, c) for a, b, c in duck.execute(NGRAM_JOIN).fetchall()
    )


def test_combinations_of_linked_sets_meet():
    """Random linked sets share a combination, whatever the classes of their tokens."""
    pick = random.Random(11)
    rule = join.JoinRule(classes=(2, 5))
    for _ in range(400):
        size = pick.randint(6, 200)
        x = set(range(size))
        y = set(x)
        while True:
            change = set(y)
            change.discard(pick.choice(sorted(change)))
            if pick.random() < 0.5:
                change.add(1000 + len(change) + pick.randrange(1000))
            if 100 * len(x & change) < 85 * len(x | change):
                break
            y = change
        if x == y:
            continue
        seen = {t: pick.randint(2, 9) for t in x | y}
        keys = []
        for some in (x, y):
            # Tokens of the other set only, or of none, may be unknown to others.
            shared = sorted((seen[t], int(join._mix(np.array([t], np.uint64))[0] >> np.uint64(1))) for t in some & (x & y))
            keys.append(set(join.combination_keys(len(some), [t for _, t in shared], [s for s, _ in shared], rule)))
        assert keys[0] & keys[1], (len(x), len(y), len(x & y))


def test_packing_round_trip():
    pick = np.random.default_rng(1)
    values = np.sort(pick.integers(0, 2**63, 500, dtype=np.uint64) * np.uint64(2))
    size, raw = join._pack(values)
    assert (join._unpack(raw, len(values), size) == values).all()
    ids = pick.integers(-(2**62), 2**62, 40)
    owners = pick.integers(0, 40, 500).astype(np.uint32)
    count, raw = join._pack_owners(owners, ids)
    assert (join._unpack_owners(raw, count) == ids[owners]).all()


def test_hashes_follow_words():
    text = "Ab  cdé ab\tCDé " + "x" * 200
    hashes = join.word_hashes(text)
    assert len(hashes) == 5 and hashes[0] == hashes[2] and hashes[1] == hashes[3]
    assert len({*join.word_hashes("a b ab ba aab " * 3)}) == 5


def test_a_task_frees_its_parts_before_it_sorts():
    pick = np.random.default_rng(2)
    tracemalloc.start()
    parts = [(pick.integers(0, 99, 50_000), pick.integers(0, 9999, 50_000, dtype=np.uint64)) for _ in range(8)]
    pairs = {pair for owners, tokens in parts for pair in zip(tokens.tolist(), owners.tolist())}
    tracemalloc.reset_peak()
    before = tracemalloc.get_traced_memory()[0] - 16 * 400_000
    owners, tokens = join._distinct_pairs(parts)
    peak = tracemalloc.get_traced_memory()[1] - before
    tracemalloc.stop()
    assert list(zip(tokens.tolist(), owners.tolist())) == sorted(pairs)
    assert peak < 45 * 400_000


def test_workers_get_few_rows_at_once(spark):
    def most(batches):
        import pyarrow as pa

        yield pa.RecordBatch.from_pydict({"n": [max((batch.num_rows for batch in batches), default=0)]})

    before = spark.conf.get(ROWS_SENT_KEY)
    try:
        spark.conf.set(ROWS_SENT_KEY, "10000")
        docs = spark.range(3 * ROWS_SENT, numPartitions=1).selectExpr("id doc_id", "concat('text ', id) text")
        assert join.keep_one_of_each(docs).count() == 3 * ROWS_SENT
        assert docs.mapInArrow(most, "n long").first()[0] == ROWS_SENT
        for own, then in (("100", "100"), ("0", str(ROWS_SENT))):
            spark.conf.set(ROWS_SENT_KEY, own)
            small_batches(spark)
            assert spark.conf.get(ROWS_SENT_KEY) == then
    finally:
        spark.conf.set(ROWS_SENT_KEY, before)
