from __future__ import annotations

import zlib

import numpy as np

from mercato.llm import language_id as l
from mercato.llm.queries import LLM_QUERIES


def test_held_out_accuracy(spark, larger_dir):
    found = LLM_QUERIES["op8_language_id"](spark, larger_dir)
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{larger_dir}/documents.parquet").select("doc_id", "lang").collect()}
    rows = found.collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    right = [r.lang_pred == truth[r.doc_id] for r in held]
    assert len(held) > 100 and sum(right) / len(right) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_learns_from_all_rows_like_a_plain_count(spark):
    rows = [(1, "aaa bbb ab", "x"), (2, "aab", "x"), (3, "ccc dd", "y"), (4, None, "x"), (5, "cd", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = l.fit(docs.repartition(3))
    assert model.languages == ["x", "y"]
    counts = {"x": l.slot_counts("aaa bbb ab") + l.slot_counts("aab"), "y": l.slot_counts("ccc dd")}
    chance = {k: (v + 0.5) / (v.sum() + 0.5 * l.SLOTS) for k, v in counts.items()}
    want = np.log(chance["x"]) - np.log(chance["y"])
    assert np.allclose(model.weights[:, 0], want * model.codes[0, 0], atol=1e-5)
    assert model.decide("aabb")[0] == "x" and model.decide("ccd")[0] == "y"


def test_codewords_differ_everywhere():
    for count in (2, 3, 4, 5, 9, 30):
        codes = l.codewords(count)
        assert codes.shape[0] == count and set(np.unique(codes)) <= {-1.0, 1.0}
        least = min((codes[i] != codes[j]).sum() for i in range(count) for j in range(i))
        assert least >= max(1, codes.shape[1] // 4)
        assert all(abs(bit.sum()) < count for bit in codes.T)


def test_long_texts_count_in_pieces(monkeypatch):
    text = "Abc déf, ghi " * 500
    whole = l.slot_counts(text)
    monkeypatch.setattr(l, "_PIECE", 100)
    assert (l.slot_counts(text) == whole).all()


def test_odd_rows(odd_docs, no_docs, spark):
    model = l.fit(odd_docs)
    found = {r.doc_id: r for r in l.identify(odd_docs, model).collect()}
    assert [found[i].lang_pred for i in (0, 1, 2)] == ["und"] * 3 and found[0].score == 0 and found[0].ambiguous
    assert found[8].lang_pred == "en"
    kept = l.keep_identified(odd_docs, model)
    assert kept.schema == odd_docs.schema and {0, 1, 2}.isdisjoint(r.doc_id for r in kept.collect())
    nothing = l.fit(no_docs)
    assert nothing.languages == [] and nothing.decide("some text") == ("und", 0.0, True)
    assert l.identify(no_docs, model).count() == 0
