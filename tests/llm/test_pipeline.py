"""The stages, each against a plain version on its own input."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import public_tokenizers
import sentencepiece

import __spark_entry__ as contract
import corpus_pipeline
from mercato.llm import decontamination, pii
from mercato.llm.queries import LLM_QUERIES, LLM_SQL, SURROGATE_KEY


def rows_of(frame):
    return {r.doc_id: r for r in frame.collect()}


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, frames = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, frames[-1], sf_dir).write.parquet(str(tmp_path / name))
        frames.append(spark.read.parquet(str(tmp_path / name)))
    assert all(sorted(f.columns) == sorted(columns) for f in frames[:-1])
    raw, spoken, single, clean, safe, final = map(rows_of, frames)

    assert set(spoken) == {i for i, r in raw.items() if any(c.isalpha() for c in r.text or "")}
    assert all(spoken[i] == raw[i] for i in spoken)

    # Links by all pairs that share a shingle; the least id of each group stays.
    where, sets = defaultdict(set), {}
    for i, r in spoken.items():
        words = r.text.encode().lower().split()
        sets[i] = {tuple(words[k : k + 4]) for k in range(max(len(words) - 3, 1))}
        for token in sets[i]:
            where[token].add(i)
    name = {i: i for i in sets}

    def root(i):
        while name[i] != i:
            i = name[i]
        return i

    for i, tokens in sets.items():
        for j in set().union(*(where[t] for t in tokens)):
            if j < i and 100 * len(tokens & sets[j]) >= 85 * len(tokens | sets[j]):
                a, b = sorted((root(i), root(j)))
                name[b] = a
    assert set(single) == {root(i) for i in sets} and len(single) < len(spoken)

    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    windows = [(str(r.item_id), decontamination.words_of(r.text)) for r in items]
    shown = set()
    for _, words in windows:
        size = min(13, len(words))
        shown.update(tuple(words[i : i + size]) for i in range(len(words) - size + 1) if words)
    for i, r in single.items():
        words = decontamination.words_of(r.text)
        hit = set()
        for size in {len(w) for w in shown}:
            for k in range(len(words) - size + 1):
                if tuple(words[k : k + size]) in shown:
                    hit.update(range(k, k + size))
        assert (i not in clean) == (len(hit) > 0 and 20 * len(hit) >= len(words))

    assert set(safe) == set(clean)
    for i, r in clean.items():
        found = pii.entities_of(r.text)
        assert (safe[i].text == r.text) == (not found)
        assert safe[i].n_chars == len(safe[i].text)
        for start, end, *_ in found:
            assert r.text[start:end] not in safe[i].text

    library = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    assert set(final) == set(safe)
    for i, r in final.items():
        ids = library.encode(safe[i].text, add_eos=True)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(tuple, final.values()))


def test_odd_documents(spark, sf_dir, odd_texts):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(odd_texts)]
    rows += [(None, None, None, None, None), rows[5]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for frame in (docs, docs.limit(0)):
        current = frame
        for _, stage in corpus_pipeline.STAGES[:-1]:
            current = stage(spark, current, sf_dir)
            assert current.columns == docs.columns
        last = corpus_pipeline.STAGES[-1][1](spark, current, sf_dir)
        assert (last.count() > 0) == (frame is docs)


def test_all_queries_are_registered():
    names = contract.queries()
    assert {f"op{n}" for n in range(1, 14)} == {name.split("_")[0] for name in LLM_QUERIES}
    assert set(LLM_QUERIES) | {"pipeline"} <= set(names)
    assert set(LLM_SQL) <= set(contract.oracle_sql()) and "pipeline" not in contract.oracle_sql()
    assert SURROGATE_KEY
