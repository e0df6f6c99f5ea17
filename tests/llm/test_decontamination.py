from __future__ import annotations

import random

import pytest

from mercato.llm import decontamination as d
from mercato.llm.queries import LLM_QUERIES


def by_brute_force(items, words, window):
    hit, found = set(), set()
    for name, item in items:
        size = min(window, len(item))
        if not size:
            continue
        windows = {tuple(item[i : i + size]) for i in range(len(item) - size + 1)}
        for i in range(len(words) - size + 1):
            if tuple(words[i : i + size]) in windows:
                hit.update(range(i, i + size))
                found.add(name)
    return hit, found


def test_automaton_equals_brute_force():
    pick = random.Random(3)
    for _ in range(1500):
        window = pick.choice([3, 4, 5, 13])
        letters = [b"a", b"b", b"c"][: pick.choice([2, 3])]
        items = [
            (str(i), pick.choices(letters, k=pick.choice([1, 2, 3, 5, 8, 20]))) for i in range(pick.randint(0, 5))
        ]
        if pick.random() < 0.6:
            items = [item for item in items if len(item[1]) > 1]
        words = pick.choices([*letters, b"z"], k=pick.randint(1, 40))
        spans, found = d.SuffixAutomaton(items, window).hits(words)
        hit = {place for start, end in spans for place in range(start, end)}
        assert (hit, found) == by_brute_force(items, words, window)
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_whole_table_against_sql(spark, sf_dir, duck):
    from mercato.llm.sql import DECONTAMINATION

    found = LLM_QUERIES["op9_decontamination"](spark, sf_dir)
    want = duck.execute(f"SELECT {', '.join(found.columns)} FROM ({DECONTAMINATION})").fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert any(row[-1] for row in want)


def test_several_blocks_give_the_same(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    whole = d.find_contamination(docs, items)
    parts = d.find_contamination(docs, items, block_words=100)
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, parts.collect()))
    kept = d.remove_contamination(docs, items, block_words=100)
    assert kept.schema == docs.schema
    clean = whole.where("NOT contaminated").select("doc_id").collect()
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in clean)


def test_odd_rows(spark, odd_docs, odd_texts, no_docs):
    passage = odd_texts[5]
    items = spark.createDataFrame(
        [(1, passage), (1, passage), (2, None), (3, ""), (4, "One"), (None, "null id")], "item_id long, text string"
    )
    found = {r.doc_id: r for r in d.find_contamination(odd_docs, items).collect()}
    assert found[0].n_words == 0 and not found[0].contaminated
    # The one-word item is hit by the word itself, and in no other text.
    assert (found[3].n_hit, found[3].n_items, found[3].contaminated) == (1, 1, True)
    assert (found[4].n_hit, found[4].n_words) == (1, 3)
    assert found[5].n_hit == found[5].n_words == found[7].n_hit == 16
    assert found[8].n_hit == found[8].n_words == 48_000 and found[8].n_items == 1
    assert d.find_contamination(no_docs, items).count() == 0
    none = items.limit(0)
    assert not any(r.contaminated for r in d.find_contamination(odd_docs, none).collect())
    assert d.remove_contamination(odd_docs, none).count() == odd_docs.count()
    kept = d.remove_contamination(odd_docs, items)
    assert kept.columns == odd_docs.columns
    assert {r.doc_id for r in kept.collect()} == {0, 1, 2, 9, None}


def test_cut_keeps_the_rest(spark):
    item = " ".join(f"i{n}" for n in range(15))
    docs = spark.createDataFrame([(1, f"before it, {item.upper()}! after")], "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert d.remove_contamination(docs, items, drop=False).first().text == "before it, ! after"


@pytest.mark.parametrize(("text", "words"), [("AÄb-c9", [b"a\xc3\x84b", b"c9"]), (None, []), ("...", [])])
def test_words(text, words):
    assert d.words_of(text) == words


def test_odd_rows_with_several_blocks(spark, odd_docs, odd_texts):
    """Repeated and null ids keep a result for each row."""
    rows = [(i, f"item {i} of some {'more ' * 40}words") for i in range(6)] + [(6, odd_texts[5]), (7, "One")]
    items = spark.createDataFrame(rows, "item_id long, text string")
    docs = odd_docs.unionByName(odd_docs.where("doc_id = 5").withColumn("doc_id", d.F.lit(None).cast("long")))
    whole = d.find_contamination(docs, items).collect()
    parts = d.find_contamination(docs, items, block_words=100).collect()
    assert len(parts) == docs.count()
    assert sorted(map(repr, parts)) == sorted(map(repr, whole))
    for drop in (True, False):
        whole = d.remove_contamination(docs, items, drop=drop).collect()
        parts = d.remove_contamination(docs, items, drop=drop, block_words=100).collect()
        assert sorted(map(repr, parts)) == sorted(map(repr, whole))
