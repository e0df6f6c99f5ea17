from __future__ import annotations

import re

from pyspark.sql import functions as F

from mercato.llm import quality_rules as q
from mercato.llm.queries import LLM_QUERIES
from mercato.llm.sql import QUALITY_RULES


def by_brute_force(text):
    text = text or ""
    words = [w for w in re.split("[ \t-\r]+", text) if w]
    lines = [line for line in text.split("\n") if re.search("[^ \t-\r]", line)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    twice = {w for w in windows if windows.count(w) > 1} if len(windows) < 5000 else set(windows)
    covered = {i + k for i, w in enumerate(windows) if w in twice for k in range(8)}
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)
    )


def test_whole_table_against_sql(spark, sf_dir, duck):
    found = LLM_QUERIES["op6_quality_rules"](spark, sf_dir)
    want = duck.execute(f"SELECT {', '.join(found.columns)} FROM ({QUALITY_RULES})").fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert len({row[-1] for row in want}) == 2


def test_odd_rows(odd_docs, odd_texts, no_docs, spark):
    found = {r.doc_id: r for r in q.judge(odd_docs, name_rule=True).collect()}
    for i, text in enumerate(odd_texts):
        assert tuple(found[i][m] for m in q.MEASURES) == by_brute_force(text), i
        assert found[i].base_failed and found[i].rejected_by == "base"
    assert q.judge(no_docs).count() == 0
    more = ["a b c d e f g h " * 3, "a a a a a a a a a a", "x\n\n x\nx\n x|#\x0by", "w " * 7, "1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8"]
    rows = spark.createDataFrame([(t,) for t in more], "text string")
    for r in q.judge(rows).collect():
        assert tuple(r[m] for m in q.MEASURES) == by_brute_force(r.text)


def test_the_order_changes_no_verdict(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [rule.name for rule in q.default_rules()]
    verdicts = []
    for order in (names, names[::-1]):
        monkeypatch.setattr(q, "cascade_order", lambda *a, order=order, **k: order)
        verdicts.append(sorted(map(tuple, q.judge(docs).select("doc_id", "kept").collect())))
    assert verdicts[0] == verdicts[1]


def test_order_prefers_rejections_for_their_cost(spark, monkeypatch):
    docs = spark.createDataFrame([("a " * n,) for n in range(1, 101)], "text string")
    rules = [
        q.Rule("rare", F.col("n_words") > 95),
        q.Rule("dear", F.col("n_words") > 20),
        q.Rule("cheap", F.col("n_words") > 40),
        q.Rule("inside", F.col("n_words") > 60),
    ]
    cost = iter([1.0, 9.0, 1.0, 1.0])
    monkeypatch.setattr(q, "_seconds", lambda *_: next(cost))
    # Once "cheap" has rejected, "rare" and "inside" find nothing more.
    assert q.cascade_order(docs, rules)[:2] == ["cheap", "dear"]


def test_costs_are_those_of_the_rules(spark, sf_dir, tmp_path):
    """Timed for real: what does nothing costs next to nothing, however long its job takes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text")
    q.measured(docs).drop("text").write.parquet(str(tmp_path / "sample"))
    table = spark.read.parquet(str(tmp_path / "sample"))
    slow = F.length(F.sha2(F.repeat("_text", 40), 512)) > 128
    empty = q._job_seconds(table, F.lit(False))
    dear, cheap = (q._seconds(table, rule, empty) for rule in (slow, F.col("n_words") > 5))
    assert dear > 5 * cheap
    # With like rejections the cheap one goes first, in whatever order they are given.
    hashed = F.length(F.sha2(F.repeat("_text", 40), 512)) > 0
    rules = [q.Rule("dear", hashed & (F.col("n_words") > 5)), q.Rule("cheap", F.col("n_words") > 5)]
    assert q.cascade_order(docs, rules)[0] == q.cascade_order(docs, rules[::-1])[0] == "cheap"


def test_main_path_is_native(spark, sf_dir):
    plan = LLM_QUERIES["op6_quality_rules"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)
