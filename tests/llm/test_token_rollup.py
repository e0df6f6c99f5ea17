from __future__ import annotations

import base64
import random
from collections import Counter

import public_tokenizers
import pytest
import tiktoken

from mercato.llm import token_rollup as r
from mercato.llm.queries import LLM_QUERIES, TOKENIZER


def changes(spark, rows):
    return spark.createDataFrame(
        rows, "operation string, doc_id long, source string, lang string, tokenizer string, tokens long, place long"
    )


def totals(rollup):
    return {(x.source, x.lang, x.tokenizer): (x.documents, x.tokens) for x in rollup.totals().collect()}


def test_random_changes_equal_a_plain_dictionary(spark, tmp_path):
    pick = random.Random(6)
    rollup = r.TokenRollup(spark, str(tmp_path / "rollup"))
    state: dict = {}
    assert totals(rollup) == {}
    for batch in range(4):
        rows = []
        for place in range(30):
            rows.append(
                (
                    pick.choice([r.INSERT, r.DELETE, r.REVISE]), pick.choice([None, *range(12)]), pick.choice(["a", "b", None]),
                    pick.choice(["en", None]), pick.choice(["v1", "v2"]), pick.choice([None, 0, 5, 9]), place,
                )
            )
        for operation, doc, source, lang, tokenizer, tokens, _ in rows:
            if operation == r.DELETE:
                state.pop((doc, tokenizer), None)
            else:
                state[doc, tokenizer] = (source, lang, tokens or 0)
        table = changes(spark, rows)
        assert rollup.apply(f"b{batch}", table)
        assert not rollup.apply(f"b{batch}", table)
        want: Counter = Counter()
        count: Counter = Counter()
        for (_, tokenizer), (source, lang, tokens) in state.items():
            want[source, lang, tokenizer] += tokens
            count[source, lang, tokenizer] += 1
        assert totals(rollup) == {key: (count[key], want[key]) for key in count}
    assert rollup.batches() == ["b0", "b1", "b2", "b3"]


def test_a_lost_attempt_leaves_no_trace(spark, tmp_path, monkeypatch):
    rollup = r.TokenRollup(spark, str(tmp_path / "rollup"))
    table = changes(spark, [(r.INSERT, 1, "a", "en", "v1", 7, 0), (r.INSERT, 1, "a", "en", "v1", 7, 0)])
    with monkeypatch.context() as patch:
        patch.setattr(rollup, "_commit", lambda *_: (_ for _ in ()).throw(RuntimeError("driver lost")))
        with pytest.raises(RuntimeError):
            rollup.apply("b", table)
    assert totals(rollup) == {}
    assert rollup.apply("b", table) and totals(rollup) == {("a", "en", "v1"): (1, 7)}
    assert rollup.apply("empty", table.limit(0)) and totals(rollup) == {("a", "en", "v1"): (1, 7)}
    # Two attempts at once: the second to commit finds the name taken.
    attempt = f"{rollup.folder}/attempts/late"
    table.write.parquet(f"{attempt}/ledger")
    assert not rollup._commit(attempt, "b") and rollup.batches() == ["b", "empty"]
    for name in ("", "a/b", "_x"):
        with pytest.raises(ValueError):
            rollup.apply(name, table)


def test_whole_table(spark, sf_dir, duck):
    with open(public_tokenizers.path(TOKENIZER), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    first: dict = {}
    rows = sorted(duck.execute("SELECT doc_id, source, lang, text FROM documents").fetchall())
    want: dict = {}
    for doc, source, lang, text in rows:
        if first.setdefault(text, doc) != doc and text is not None:
            continue
        kept = "\n".join(dict.fromkeys(text.split("\n")))
        documents, tokens = want.get((source, lang, TOKENIZER), (0, 0))
        want[source, lang, TOKENIZER] = (documents + 1, tokens + len(encoding.encode_ordinary(kept)))
    found = LLM_QUERIES["op7_token_rollup"](spark, sf_dir).collect()
    assert {(x.source, x.lang, x.tokenizer): (x.documents, x.tokens) for x in found} == want
    assert len(first) < len(rows)


def test_odd_texts_count(odd_docs, no_docs):
    path = str(public_tokenizers.path(TOKENIZER))
    counted = r.count_tokens(odd_docs, path, public_tokenizers.PATTERN, ("doc_id", "token"))
    rows = {x.doc_id: x.tokens for x in counted.collect()}
    assert rows[0] == rows[1] == 0 and rows[3] == 1 and rows[8] > 40_000
    assert r.count_tokens(no_docs, path, public_tokenizers.PATTERN, ("doc_id",)).count() == 0


def test_rivals_do_not_count_twice(spark, tmp_path, monkeypatch):
    """Two writers delete the same document at the same moment, and one id is delivered to both."""
    folder = str(tmp_path / "rollup")
    mine, rival = r.TokenRollup(spark, folder), r.TokenRollup(spark, folder)
    assert mine.apply("load", changes(spark, [(r.INSERT, doc, "a", "en", "v1", 10, 0) for doc in range(5)]))
    delete = changes(spark, [(r.DELETE, 1, None, None, "v1", None, 0)])
    attempt = mine._attempt

    def late(other, table):
        """The rival commits once after this writer's attempt is written."""
        waiting = [True]

        def run(*args):
            made = attempt(*args)
            if waiting:
                waiting.clear()
                assert rival.apply(other, table)
            return made

        return run

    monkeypatch.setattr(mine, "_attempt", late("rival", delete))
    assert mine.apply("own", delete)
    assert totals(mine) == {("a", "en", "v1"): (4, 40)} and mine.batches() == ["load", "own", "rival"]
    revise = changes(spark, [(r.REVISE, 2, "a", "en", "v1", 3, 0)])
    monkeypatch.setattr(mine, "_attempt", late("same", revise))
    assert not mine.apply("same", revise)
    assert totals(rival) == {("a", "en", "v1"): (4, 33)}
    # Each commit's files are the only ones left.
    named = {part["path"] for part in mine.store.manifest().tables["totals"].parts.values()}
    assert {path.name for path in (tmp_path / "rollup" / "totals").iterdir() if path.is_dir()} == named


def test_a_batch_reads_its_own_parts_only(spark, tmp_path, monkeypatch):
    rollup = r.TokenRollup(spark, str(tmp_path / "rollup"), parts=16)
    rollup.apply("load", changes(spark, [(r.INSERT, doc, "a", "en", "v1", 1, 0) for doc in range(2000)]))
    whole = len(rollup.ledger().inputFiles())
    read = []
    ledger = rollup.ledger
    monkeypatch.setattr(rollup, "ledger", lambda *args: read.append(ledger(*args)) or read[-1])
    # Another number of parts does not move a ledger that has batches.
    rollup.parts = 3
    rollup.apply("one", changes(spark, [(r.DELETE, 7, None, None, "v1", None, 0), (r.DELETE, 9999, None, None, "v1", None, 0)]))
    files = {file for frame in read for file in frame.inputFiles()}
    assert whole >= 16 and 1 <= len(files) <= 2 * -(-whole // 16)
    assert sum(frame.count() for frame in read) < 2000 / 4
    assert totals(rollup) == {("a", "en", "v1"): (1999, 1999)}
