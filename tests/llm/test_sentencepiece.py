from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from mercato.llm import sentencepiece_codec as codec
from mercato.llm.queries import LLM_QUERIES

PATH = str(public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def expected(library, key, text):
    ids = library.encode(text or "", add_eos=True)
    return key, len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids))


def test_equals_the_library_on_random_texts(library):
    pick = random.Random(2)
    letters = " ▁\n\tá\x00é中\U0001f600</s>theTHE0123-="
    texts = ["".join(pick.choices(letters, k=pick.randint(0, 80))) for _ in range(1500)]
    texts += ["the" * 2000, " " * 50, "a " * 500, "\n".join(["x  y"] * 40)]
    for (count, ids, text), source in zip(codec.Codec(PATH).rows(texts), texts):
        want = library.encode(source, add_eos=True)
        assert ids == " ".join(map(str, want)) and count == len(want), source
        assert text == library.decode(want)


def test_decodes_its_own_ids(library):
    words = codec.vocabulary(PATH)
    for text in ("a  b", " x", "", "é中\U0001f600", "end </s>"):
        ids = library.encode(text, add_eos=True)
        assert words.decode(ids) == library.decode(ids)


def test_both_agendas_agree():
    words = codec.vocabulary(PATH)
    pick = random.Random(4)
    for _ in range(300):
        chunk = codec.SPACE + "".join(pick.choices("thearingsod", k=pick.randint(1, 30)))
        assert words._merge_flat(chunk) == words._merge_heap(chunk)


def test_store_stays_bounded(library, monkeypatch):
    monkeypatch.setattr(codec, "STORE_SIZE", 50)
    own = codec.Codec(PATH)
    for low in range(0, 2000, 20):
        own.rows([" ".join(f"w{i}" for i in range(low, low + 40))])
        assert len(own.young) <= 50 + 40 and len(own.old) <= 50 + 40


def test_a_wrong_encoding_is_found():
    words = codec.vocabulary(PATH)
    with pytest.raises(ValueError):
        words.check(["the"], [[1, 2, 3]])


def test_whole_table(spark, sf_dir, library, duck):
    rows = duck.execute("SELECT doc_id, text FROM documents").fetchall()
    found = LLM_QUERIES["op4_sentencepiece"](spark, sf_dir).collect()
    assert sorted(map(tuple, found)) == sorted(expected(library, *row) for row in rows)


def test_odd_rows(odd_docs, odd_texts, no_docs, library):
    rows = [*enumerate(odd_texts), (None, "the same null id"), (5, odd_texts[5])]
    found = codec.encode_documents(odd_docs, PATH, keep_ids=True, keep_text=True).collect()
    assert sorted(map(repr, (tuple(r)[:4] for r in found))) == sorted(map(repr, (expected(library, *r) for r in rows)))
    assert all(library.decode(r.ids) == r.decoded for r in found)
    assert codec.encode_documents(no_docs, PATH).count() == 0
