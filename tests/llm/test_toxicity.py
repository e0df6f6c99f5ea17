from __future__ import annotations

import zlib

import numpy as np

from mercato.llm import toxicity as x
from mercato.llm.queries import LLM_QUERIES


def test_held_out_rows(spark, larger_dir):
    rows = LLM_QUERIES["op10_toxicity"](spark, larger_dir).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{larger_dir}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    caught = [p for p, t in held if t == 1]
    wrong = [p for p, t in held if t == 0]
    assert sum(caught) >= 0.6 * len(caught) and sum(wrong) <= 0.06 * len(wrong)


def test_label_model_finds_good_and_copied_voters():
    pick = np.random.default_rng(1)
    truth = (pick.random(4000) < 0.2).astype(int)

    def voter(hit, false):
        return np.where(pick.random(4000) < np.where(truth == 1, hit, false), 1, 0)

    good = [voter(0.8, 0.02), voter(0.7, 0.03), voter(0.75, 0.02)]
    bad = voter(0.3, 0.25)
    ballot = np.stack([*good, bad, bad, np.where(sum(good) == 0, -1, 0)], 1).astype(np.int8)
    model = x.fit_label_model(ballot, 0.2)
    assert model.correlation[3, 4] > 0.9 and model.weights[3] < 0.6
    votes = model.votes
    assert votes[0, 1, 2] > 0.6 and votes[0, 0, 2] < 0.1
    chance = model.posterior(ballot)
    assert ((chance > 0.5) == truth).mean() > 0.93


def test_levels_count_occurrences():
    slots = x.slots_of([(b"abcd", 2), (b"abce", 2)], x.terms_of)
    assert len([s for s in slots if s % 4 == 2]) == 1  # the common beginning stands four times
    assert len([s for s in slots if s % 4 == 1]) == 3


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame(
        [(5, 1), (5, 0), (8, 0), (4, None), (None, 1), (99, 1)], "doc_id long, toxic int"
    )
    model = x.fit(odd_docs, labels)
    rows = {r.doc_id: r for r in x.score_documents(odd_docs, model).collect()}
    assert len(rows) == 11 and rows[0].score == rows[1].score and 0 <= rows[8].score <= 1
    assert rows[5].score == rows[6].score
    none = x.fit(no_docs, labels.limit(0))
    assert all(r.predicted == 0 for r in x.score_documents(odd_docs, none).collect())
    only_toxic = x.fit(odd_docs, labels.where("toxic = 1"))
    assert all(r.predicted == 1 for r in x.score_documents(odd_docs, only_toxic).collect())
    assert x.score_documents(no_docs, model).count() == 0
