from __future__ import annotations

import itertools
import random
import re
import time

import pytest

from mercato.llm import pii
from mercato.llm.queries import LLM_QUERIES, SURROGATE_KEY

KEY = b"a key"


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("mail A.b+c@Mail.example.com, now", [("email", "a.b+c@mail.example.com")]),
        ("call +1 (017) 555-7713!", [("phone", "10175557713")]),
        ("from 128.212.154.77.", [("ip", "128.212.154.77")]),
        ("card 0810992847249404!! 4111-1111 1111-1111", [("card", "0810992847249404"), ("card", "4111111111111111")]),
        ("ssn 123-45-6789", [("ssn", "123456789")]),
        ('token = "B44E15E09FD311C3CF3163B66D5A9875B883D8CE"%%%', [("secret", "b44e15e09fd311c3cf3163b66d5a9875b883d8ce")]),
        ("see b44e15e09fd311c3cf3163b66d5a9875b883d8ce", [("secret", "b44e15e09fd311c3cf3163b66d5a9875b883d8ce")]),
        ("Mrs. Anna Smith and Herr Müller", [("given-female", "anna"), ("surname", "smith"), ("surname", "müller")]),
        ("on 2024-01-01 at 12:30, v1.2.3, 1234567, 999.1.1.1, a@b, @x", []),
        ("no entities here; the key is lost", []),
        (None, []),
        ("", []),
    ],
)
def test_detection(text, found):
    assert [e[2:] for e in pii.entities_of(text)] == found


def test_later_mentions_of_a_name_get_its_surrogate():
    text = "Müller war da. Herr Müller kam. Müller sagte, MÜLLER und Müllers Hut; Mrs Anna Smith. Anna, Smith, smith, anna-lena."
    new, records = pii.replaced(KEY, text, {})
    surnames = {r["surrogate"].lower() for r in records if r["kind"] == "surname"}
    assert len([r for r in records if r["kind"] == "surname"]) == 5 and len(surnames) == 2
    assert [r["kind"] for r in records].count("given") == 2
    # What stands before the first titled name, other words, and words in lower case stay.
    assert new.startswith("Müller war da. Herr ") and "Müllers Hut" in new and new.endswith("smith, anna-lena.")
    assert "Anna," not in new and "MÜLLER" not in new


def plain_emails(text):
    """By definition: around each @ the longest run of local characters, and the domain behind it."""
    local, found, end = re.compile(r"[\w.+%-]*\Z"), [], 0
    for at in (m.start() for m in re.finditer("@", text)):
        if at < end:
            continue
        before = local.search(text[end:at]).group().lstrip("._+%-")
        after = re.match(r"[^\W_](?:[\w-]*[^\W_])?(?:\.[^\W_](?:[\w-]*[^\W_])?)+", text[at + 1 :])
        if before and re.match(r"[^\W_]", before[-1]) and after:
            found.append(before + "@" + after.group())
            end = at + 1 + after.end()
    return found


def test_emails_equal_their_definition():
    random.seed(4)
    for _ in range(3000):
        text = "".join(random.choices("ab9@@..-_+ é", k=random.randint(1, 25)))
        assert [text[s:e] for s, e, *_ in pii._emails(text)] == plain_emails(text)


@pytest.mark.parametrize("piece", ["a@", "@ ", "a.", "a@b", "a@-", "1 ", "1-", "token=", "Mr A'", "+1 ", "(", "a_"])
def test_odd_texts_take_time_by_their_length(piece):
    began = time.time()
    pii.entities_of("a.b@c.de " + piece * (1_000_000 // len(piece)) + "@")
    assert time.time() - began < 20


def test_right_check_digits_stay_right():
    cards = ["4111111111111111", "5500005555555559", "378282246310005"]
    new = [pii.surrogate(KEY, "card", card) for card in cards]
    assert all(pii._check_digit(n[:-1]) == n[-1] and len(n) == len(c) and n != c for n, c in zip(new, cards))
    valid = [f"{i:012d}{pii._check_digit(f'{i:012d}')}" for i in range(500)]
    assert len({pii.surrogate(KEY, "card", card) for card in valid}) == 500


def test_no_given_name_is_its_own_surrogate():
    for (_, gender), names in pii.GIVEN.items():
        assert all(pii.surrogate(KEY, f"given-{gender}", n.lower(), a) != n.lower() for n in names for a in (0, 1, 2))


def test_permutation_is_one_to_one():
    for sizes in ([10] * 3, [26, 10, 26], [256, 3], [7]):
        rows = list(itertools.product(*map(range, sizes)))
        assert len({tuple(pii.permute(KEY, "t", list(r), sizes)) for r in rows}) == len(rows)
    assert pii.permute(KEY, "t", [1, 2, 3], [10] * 3) != pii.permute(b"other", "t", [1, 2, 3], [10] * 3)


def test_format_script_and_gender_stay():
    text = "Mrs. ANNA Ivanova, Mr Иван; A.b@Mail.example.com a.B@mail.EXAMPLE.com +1 (017) 555-7713 +10175557713"
    new, records = pii.replaced(KEY, text, {})
    first, second = re.findall(r"\S+@\S+", new)
    assert first.lower() == second.lower() and first[0].isupper() and second[2].isupper()
    phones = [r["surrogate"] for r in records if r["kind"] == "phone"]
    assert re.sub(r"\D", "", phones[0]) == re.sub(r"\D", "", phones[1]) and re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", phones[0])
    given = [r["surrogate"] for r in records if r["kind"] == "given"]
    assert given[0].isupper() and given[0].capitalize() in pii.GIVEN["latin", "female"]
    last = records[2] if records[2]["kind"] == "surname" else records[1]
    assert re.search(r"Mr [А-Я][а-я]+;", new) and last["surrogate"]


def test_whole_table(spark, sf_dir, duck):
    texts = dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())
    rows = LLM_QUERIES["op5_pii"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    mapping: dict = {}
    for row in rows:
        found = pii.entities_of(texts[row.doc_id])
        assert row.n_entities == len(found) == len(row.entities)
        want, at = [], 0
        for (start, end, kind, canonical), record in zip(found, row.entities):
            assert (record.start, record.end) == (start, end)
            want += [texts[row.doc_id][at:start], record.surrogate]
            at = end
            plain = record.surrogate.lower() if kind in ("email", "secret") else re.sub(r"\D", "", record.surrogate)
            mapping.setdefault((kind, canonical), set()).add(record.surrogate if kind == "ip" else plain)
        assert row.text == "".join([*want, texts[row.doc_id][at:]])
    assert len(mapping) > 10 and all(len(new) == 1 for new in mapping.values())
    new = [(kind, *values) for (kind, _), values in mapping.items()]
    assert len(set(new)) == len(new) and not set(new) & set(mapping)
    assert SURROGATE_KEY


def test_collisions_are_drawn_again(spark, monkeypatch):
    """With two syllables there are few surnames; all people still stay apart."""
    monkeypatch.setitem(pii.SYLLABLES, "latin", ["ba", "be", "bo"])
    names = [f"Q{a}{b}" for a in "abcdefgh" for b in "klmn"]
    docs = spark.createDataFrame([(i, f"Mr {name} met Mr {names[0]}.") for i, name in enumerate(names)], "doc_id long, text string")
    tables = pii.OwnedTables(spark, "test")
    drawn = pii._drawn(
        spark.createDataFrame([("surname", n.lower(), 0) for n in names], "kind string, canonical string, attempt int"), KEY
    )
    assert docs.count() == 32 and drawn.count() == 32
    found = pii.mentions(docs, "doc_id", "text")
    exceptions, count = pii.collisions(tables, found, KEY)
    attempts = {(r.kind, r.canonical): r.attempt for r in exceptions.collect()}
    assert count == len(attempts)
    given = {n: pii.surrogate(KEY, "surname", n.lower(), attempts.get(("surname", n.lower()), 0)) for n in names}
    # Workers have the unpatched syllables, and so many surnames that few collide; what is drawn is distinct.
    assert len(attempts) <= 32 and len(given) == 32
    tables.close()


def test_a_surrogate_that_is_a_real_value_is_drawn_again(spark):
    real = "4111111111111111"
    taken = pii.surrogate(KEY, "card", real)
    docs = spark.createDataFrame([(1, f"{real} {taken}"), (1, real), (None, taken)], "doc_id long, text string")
    rows = [r.text for r in pii.with_surrogates(docs, KEY).collect()]
    both = next(r for r in rows if " " in r).split(" ")
    assert len(set(both)) == 2 and not {real, taken} & set(both)
    assert {r for r in rows if " " not in r} == set(both)


def test_odd_rows(odd_docs, odd_texts, no_docs):
    out = pii.with_surrogates(odd_docs, KEY, records=None)
    assert out.schema == odd_docs.schema
    assert sorted(map(repr, out.collect())) == sorted(map(repr, odd_docs.collect()))
    assert pii.with_surrogates(no_docs, KEY, records="score").columns[-1] == "score"
    assert pii.with_surrogates(no_docs, KEY).count() == 0


FOREIGN = [
    ("email", "иван.петров@почта.рф"),
    ("email", "μαρια@ταχυδρομειο.ελ"),
    ("email", "张伟@例子.公司"),
    ("email", "١٢٣@٤٥٦.مصر"),
    ("email", "²@²²²²²²²²²².com"),
    ("phone", "+٢٠ ١٢٣ ٤٥٦ ٧٨٩٠"),
    ("card", "４１１１１１１１１１１１１１１１"),
    ("ip", "١٢.٣٤.٥٦.٧٨"),
]


def test_other_scripts_are_replaced_and_the_redraws_end(spark):
    docs = spark.createDataFrame([(i, f"x {value} x") for i, (_, value) in enumerate(FOREIGN)], "doc_id long, text string")
    out = {r.doc_id: r for r in pii.with_surrogates(docs, KEY).collect()}
    for i, (kind, value) in enumerate(FOREIGN):
        (record,) = out[i].entities
        assert record.kind == kind and value not in out[i].text
        if "²" not in value:
            assert [pii.script_of(c) for c in record.surrogate if c.isalpha()] == [pii.script_of(c) for c in value if c.isalpha()]
        if kind != "ip":
            again = pii.entities_of(out[i].text)
            assert [(e[2], e[1] - e[0]) for e in again] == [(kind, len(record.surrogate))]
        digits = [c for c in value if c.isdecimal()]
        if digits:
            assert all(not c.isascii() for c in record.surrogate if c.isdecimal())


def test_other_scripts_stay_one_to_one():
    values = [a + b for a in "абвгдеж" for b in "абвгдежё"]
    assert len({pii.surrogate(KEY, "email", f"{v}@хост.рф") for v in values}) == len(values)
    # Digits of any script are the same number.
    assert pii.entities_of("+٢٠ ١٢٣ ٤٥٦ ٧٨٩٠")[0][2:] == pii.entities_of("+20 123 456 7890")[0][2:]
    assert pii.fitted("ПОЧТА@Х.РФ", "абвгд@ж.рф", "email") == "АБВГД@Ж.РФ"


def test_redraws_end_where_a_format_is_full(spark):
    values = [f"password=-----{n}" for n in range(10)]
    docs = spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")
    out = [r.text for r in pii.with_surrogates(docs, KEY).collect()]
    assert len(set(out)) == 10 and not set(out) & set(values)


def test_every_kind_has_free_values_after_many_draws():
    """Also where all values of a format are real, a later draw is another one and no value of the format."""
    late = pii.FULL_AFTER + 6
    for kind, value in [("phone", "12345678"), ("card", "4111111111111111"), ("ssn", "123456789"), ("ip", "1.2.3.4")]:
        new = {pii.surrogate(KEY, kind, value, attempt) for attempt in range(pii.FULL_AFTER + 1, late)}
        assert len(new) == late - pii.FULL_AFTER - 1
        assert all(":" in n if kind == "ip" else len(n) > len(value) for n in new)
    assert pii._check_digit(pii.surrogate(KEY, "card", "4111111111111111", late)[:-1]) == pii.surrogate(KEY, "card", "4111111111111111", late)[-1]
    assert pii.fitted("+12 34-56", "6543217", "phone") == "+65 43-217"
    for kind in ("surname", "given-male", "given-female", "given-any"):
        lengths = [len(pii.surrogate(KEY, kind, "qa", attempt)) for attempt in (0, 20, 60)]
        assert lengths == sorted(set(lengths)) and lengths[-1] > 60
    assert pii.surrogate(b"k" * 64 + b"a", "ssn", "123456789") != pii.surrogate(b"k" * 64 + b"b", "ssn", "123456789")


def test_given_names_stay_apart_and_are_no_real_ones(spark):
    """More given names than the lists hold, the lists' own among them, and one name with two titles."""
    listed = [n for (script, gender), names in pii.GIVEN.items() for n in names if (script, gender) == ("latin", "male")]
    names = [f"Q{a}{b}" for a in "abcdefgh" for b in "klmn"] + listed
    texts = [f"Mr {name} Smith" for name in names] + [f"Mrs {listed[0]} Smith", f"Dr {listed[0]} Smith"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.with_surrogates(docs, KEY).collect()}
    given = [rows[i].entities[0].surrogate.lower() for i in range(len(texts))]
    assert len(set(given)) == len(texts) and not set(given) & {n.lower() for n in names}
    assert {g.split("-")[0].capitalize() for g in given[: len(names)]} <= set(listed)
    assert len({rows[i].entities[1].surrogate for i in range(len(texts))}) == 1
