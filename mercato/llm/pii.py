"""Personal data replaced by keyed surrogates of the same kind, format, script and gender.

Detected are e-mail addresses, telephone numbers, IPv4 addresses, card numbers (13 to
19 digits), social security numbers, secrets (quoted or labelled tokens,
long hexadecimal strings) and names behind a title, with every later mention of such a
name in the same document.

An entity's canonical form (digits alone, lower case) decides its surrogate, so
all mentions of one entity, however written, get the same one; the mention's
punctuation and case are put back. Numbers, addresses and secrets are permuted
character by character within their classes by a keyed Feistel network: for a
given format this is one to one, so distinct entities stay distinct. Letters
outside a-z are permuted within their script; digits of any script count as
their values and are put back in the mention's script. A card number whose check digit is
right gets a surrogate whose check digit is right. Given names come
from lists by script and gender, never the name itself, surnames from syllables; both grow
with each draw, as do other values after some draws, so there are always free ones.

A check over all distinct entities, given names among them, finds surrogates that equal
another's or that equal a real entity of the data; all but the first of each are drawn
again, until none is left. Only the exceptions are joined back to the documents.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercato.llm.common import arrow_map, importable, only, worker_cache
from mercato.operators.durable import OwnedTables

#: Letters with marks are permuted among themselves.
MARKED = "äöüßéèêëàâîïôûùçñáíóúåæøœãõìòýÿšžčćđłąęśźżńťďřěů"
DIGITS, LOWER, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"
ROUNDS = 6
#: Code points, a power of two, within which other letters of one script are permuted.
PAGE = 1 << 12
#: Draws after which e-mail addresses and secrets grow, as their format may have no free value.
GROWS_AFTER = 4
#: Draws after which numbers and addresses leave their format, as it may have no free value.
FULL_AFTER = 40

#: Titles by gender, and given names by script and gender.
TITLES = {
    "male": "Mr Herr Monsieur Señor Sr Don Господин".split(),
    "female": "Mrs Ms Miss Frau Madame Mademoiselle Mme Mlle Señora Sra Srta Doña Госпожа".split(),
    "any": "Dr Prof Dra".split(),
}
GIVEN = {
    ("latin", "male"): "Adrian Bruno Carl Daniel Emil Felix Hugo Ivan Julian Leon Martin Oscar Paul Simon Victor".split(),
    ("latin", "female"): "Alice Berta Clara Diana Emma Flora Helena Irene Julia Laura Maria Olivia Paula Sara Vera".split(),
    ("latin", "any"): "Alexis Andrea Charlie Dominique Jo Kim Robin Sasha".split(),
    ("cyrillic", "male"): "Алексей Борис Виктор Дмитрий Иван Олег Павел".split(),
    ("cyrillic", "female"): "Анна Вера Елена Ирина Мария Ольга Татьяна".split(),
    ("cyrillic", "any"): "Саша Женя Валя".split(),
}
SYLLABLES = {
    "latin": "ba be bo da de do fa fe fi ga go ha hel ka ke la le lin lo ma mer mi na ne no pa per ra ri ro sa sel ta tor va ver wal".split(),
    "cyrillic": "ба бе во га да до за ка ко ла ле ли ма ми на но па ра ро са та то".split(),
}
_TITLED = "|".join(sorted({t for titles in TITLES.values() for t in titles}, key=len, reverse=True))
_GENDER = {title: gender for gender, titles in TITLES.items() for title in titles}
_NAME = r"[^\W\d_][^\W\d_'’-]*(?:['’-][^\W\d_]+)*"

#: Whatever holds none of these has no entity.
_MAYBE = re.compile(rf"[\d@]|token|secret|password|key|\b(?:{_TITLED})\b", re.IGNORECASE)
_DOMAIN = re.compile(r"[^\W_](?:[\w-]*[^\W_])?(?:\.[^\W_](?:[\w-]*[^\W_])?)+")
_NUMBERS = re.compile(
    r"""
    (?P<ip>(?<![\w.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?![\w]|\.\d))
  | (?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))
  | (?P<phone>(?<![\w.])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\w)
      |(?<![\w.])\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}(?!\w)|(?<![\w.-])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\w-]))
  | (?P<card>(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-]))
    """,
    re.VERBOSE,
)
_SECRET = re.compile(
    r"(?:\b(?:api[_-]?key|access[_-]?key|token|secret|password|passwd|pwd)\b\s*[:=]\s*[\"']?)(?P<labelled>[A-Za-z0-9+/_=.-]{6,})"
    r"|(?<![A-Za-z0-9])(?P<long>(?=[A-Za-z]*\d)(?:[0-9a-f]{32,}|[0-9A-F]{32,})|AKIA[0-9A-Z]{16})(?![A-Za-z0-9])",
    re.IGNORECASE,
)
_WORD = re.compile(rf"(?<![^\W_]){_NAME}(?![^\W_])")
_PERSON = re.compile(rf"\b(?P<title>{_TITLED})\b\.?[ ](?P<first>{_NAME})(?:[ ](?P<last>{_NAME}))?")


def script_of(text: str) -> str:
    name = unicodedata.name(text[0], "LATIN")
    return "cyrillic" if name.startswith("CYRILLIC") else "latin"


def _cased(name: str) -> bool:
    return name[:1].isupper() or unicodedata.category(name[0]) == "Lo"


def _emails(text: str) -> list[tuple[int, int, str, str]]:
    """E-mail addresses around each ``@``; every character is looked at a few times only."""
    found, end = [], 0
    at = text.find("@")
    while at >= 0:
        low = at
        while low > end and (text[low - 1].isalnum() or text[low - 1] in "._+%-"):
            low -= 1
        while low < at and not text[low].isalnum():
            low += 1
        if low < at and text[at - 1].isalnum():
            domain = _DOMAIN.match(text, at + 1)
            if domain:
                end = domain.end()
                found.append((low, end, "email", text[low:end].lower()))
        at = text.find("@", max(at + 1, end))
    return found


def _check_digit(digits: str) -> str:
    """The last digit that makes a card number of ``digits`` and it right."""
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (2 - place % 2)
        total += value - 9 * (value > 9)
    return str(-total % 10)


def entities_of(text: str | None) -> list[tuple[int, int, str, str]]:
    """Start, end, kind and canonical form of the entities, in order, none overlapping."""
    if not text or not _MAYBE.search(text):
        return []
    found: list[tuple[int, int, str, str]] = []
    found += _emails(text)
    for match in _SECRET.finditer(text):
        group = "labelled" if match.group("labelled") else "long"
        if any(c.isdigit() for c in match.group(group)):
            value = match.group(group)
            canonical = value.lower() if set(value.lower()) <= set(HEX) else value
            found.append((match.start(group), match.end(group), "secret", canonical))
    for match in _NUMBERS.finditer(text):
        kind = match.lastgroup
        value = match.group()
        canonical = value if kind == "ip" else "".join(str(int(c)) for c in value if c.isdecimal())
        if kind == "phone" and not 8 <= len(canonical) <= 15:
            continue
        if kind == "ip":
            canonical = ".".join(str(int(part)) for part in value.split("."))
        found.append((match.start(), match.end(), kind, canonical))
    names: dict[str, str] = {}
    since = len(text)
    for match in _PERSON.finditer(text):
        first, last, gender = match.group("first"), match.group("last"), _GENDER[match.group("title")]
        if not _cased(first):
            continue
        since = min(since, match.end())
        if last and _cased(last):
            found.append((*match.span("first"), f"given-{gender}", first.lower()))
            found.append((*match.span("last"), "surname", last.lower()))
            names.setdefault(first.lower(), f"given-{gender}")
            names[last.lower()] = "surname"
        else:
            found.append((*match.span("first"), "surname", first.lower()))
            names[first.lower()] = "surname"
    if names:
        for match in _WORD.finditer(text, since):
            name = match.group()
            kind = names.get(name.lower())
            if kind and _cased(name):
                found.append((*match.span(), kind, name.lower()))
    # The earliest entity wins, of equal starts the longest, of those the one found first.
    found.sort(key=lambda e: (e[0], -e[1]))
    out: list[tuple[int, int, str, str]] = []
    for entity in found:
        if not out or entity[0] >= out[-1][1]:
            out.append(entity)
    return out


def _draw(key: bytes, *parts: object) -> bytes:
    data = "\x1f".join(map(str, parts)).encode()
    if len(key) > 64:  # the longest key of the hash
        key = hashlib.blake2b(key).digest()
    return hashlib.blake2b(data, key=key, digest_size=64).digest()


def _stream(key: bytes, count: int, *parts: object) -> list[int]:
    blocks = range(-(-count // 32))
    raw = b"".join(_draw(key, block, *parts) for block in blocks)
    return [int.from_bytes(raw[2 * i : 2 * i + 2], "little") for i in range(count)]


def permute(key: bytes, tweak: str, values: list[int], sizes: list[int]) -> list[int]:
    """One-to-one keyed mapping of rows of numbers below ``sizes``: a Feistel network on two halves."""
    values = list(values)
    left, right = range(0, len(values), 2), range(1, len(values), 2)
    for step in range(ROUNDS):
        change, source = (left, right) if step % 2 == 0 else (right, left)
        shifts = _stream(key, len(change), tweak, sizes, step, [values[i] for i in source])
        for i, shift in zip(change, shifts, strict=True):
            values[i] = (values[i] + shift) % sizes[i]
    return values


def _upper(letter: str) -> str:
    """The upper-case letter where it is one letter and leads back to this one."""
    upper = letter.upper()
    return upper if len(upper) == 1 and upper.lower() == letter else letter


def _class_of(letter: str) -> tuple[str, str, bool]:
    """Script, category, and whether the letter has an upper case."""
    return unicodedata.name(letter, "").split(" ")[0], unicodedata.category(letter), _upper(letter) != letter


@worker_cache(maxsize=256)
def _page(number: int) -> dict[tuple[str, str, bool], str]:
    """The letters and digits of a page of code points by class, without those of the fixed alphabets."""
    classes: dict[tuple[str, str, bool], list[str]] = {}
    for letter in map(chr, range(number * PAGE, (number + 1) * PAGE)):
        if letter.isalnum() and letter.lower() == letter and letter not in DIGITS + LOWER + MARKED:
            classes.setdefault(_class_of(letter), []).append(letter)
    return {name: "".join(letters) for name, letters in classes.items()}


@worker_cache(maxsize=20_000)
def _other(letter: str) -> tuple[str, str]:
    """Name and letters of the class of a letter outside the fixed alphabets; no letters where it has none."""
    if letter.isdecimal() and letter not in DIGITS:
        zero = ord(letter) - int(letter)
        return f"<{zero}>", "".join(chr(zero + i) for i in range(10))
    if not letter.isalnum() or letter.isascii() or letter in MARKED:
        return letter, ""
    number, name = ord(letter) // PAGE, _class_of(letter)
    letters = _page(number).get(name, "")
    return (f"<{number} {name}>", letters) if len(letters) > 1 and letter in letters else (letter, "")


def _letters(key: bytes, tweak: str, text: str, alphabets: list[str]) -> str:
    """``text`` with every character permuted in the first alphabet that has it, or in its class; others stay."""
    places, values, sets = [], [], []
    for i, letter in enumerate(text):
        alphabet = next((a for a in alphabets if letter in a), None) or _other(letter)[1]
        if alphabet:
            places.append(i)
            values.append(alphabet.index(letter))
            sets.append(alphabet)
    out = list(text)
    for i, value, alphabet in zip(
        places, permute(key, f"{tweak}|{_shape(text, alphabets)}", values, [len(a) for a in sets]), sets, strict=True
    ):
        out[i] = alphabet[value]
    return "".join(out)


def _shape(text: str, alphabets: list[str]) -> str:
    return "".join(next((str(n) for n, a in enumerate(alphabets) if c in a), None) or _other(c)[0] for c in text)


def _more(key: bytes, tweak: str, canonical: str, attempt: int) -> str:
    """Letters that a value gets after ``GROWS_AFTER`` draws, one more with each."""
    count = max(attempt - GROWS_AFTER, 0)
    return "".join(LOWER[n % len(LOWER)] for n in _stream(key, count, "more", tweak, canonical))


def _longer(key: bytes, tweak: str, canonical: str, attempt: int) -> str:
    """Digits that a number gets after ``FULL_AFTER`` draws, one more with each."""
    count = max(attempt - FULL_AFTER, 0)
    return "".join(DIGITS[n % len(DIGITS)] for n in _stream(key, count, "longer", tweak, canonical))


def _syllables(key: bytes, tweak: str, canonical: str, count: int) -> str:
    syllables = SYLLABLES[script_of(canonical)]
    return "".join(syllables[n % len(syllables)] for n in _stream(key, count, "syllables", tweak, canonical))


@worker_cache(maxsize=100_000)
def surrogate(key: bytes, kind: str, canonical: str, attempt: int = 0) -> str:
    """Canonical form of the replacement. ``attempt`` draws anew after a collision."""
    tweak = f"{kind}|{attempt}"
    if kind == "email":
        local, _, domain = canonical.rpartition("@")
        host, _, top = domain.rpartition(".")
        # Host names have a surrogate of their own, so that one host stays one.
        local = _letters(key, tweak, local, [LOWER, DIGITS, MARKED]) + _more(key, tweak, canonical, attempt)
        return f"{local}@{_letters(key, 'host', host, [LOWER, DIGITS, MARKED])}.{top}"
    if kind == "ip":
        if attempt > FULL_AFTER:  # an address of the next protocol, in its range for examples
            return ":".join(["2001", "db8", *(f"{n:x}" for n in _stream(key, 6, tweak, canonical))])
        value = [int(part) for part in canonical.split(".")]
        return ".".join(map(str, permute(key, tweak, value, [256] * 4)))
    if kind == "phone":
        # The leading one is the country's and stays, as does an exchange of fictional numbers.
        head = 1 if len(canonical) == 11 and canonical[0] == "1" else 0
        new = canonical[:head] + _letters(key, tweak, canonical[head:], [DIGITS])
        return new + _longer(key, tweak, canonical, attempt)
    if kind == "card" and _check_digit(canonical[:-1]) == canonical[-1]:
        body = _letters(key, f"{tweak}|checked", canonical[:-1], [DIGITS]) + _longer(key, tweak, canonical, attempt)
        return body + _check_digit(body)
    if kind in ("card", "ssn"):
        return _letters(key, tweak, canonical, [DIGITS]) + _longer(key, tweak, canonical, attempt)
    if kind == "secret":
        alphabets = [HEX] if set(canonical) <= set(HEX) else [LOWER, LOWER.upper(), DIGITS]
        return _letters(key, tweak, canonical, alphabets) + _more(key, tweak, canonical, attempt)
    if kind == "surname":
        return _syllables(key, tweak, canonical, 3 + attempt)
    names = [name for name in GIVEN[script_of(canonical), kind.removeprefix("given-")] if name.lower() != canonical]
    name = names[int.from_bytes(_draw(key, tweak, canonical)[:4], "little") % len(names)].lower()
    # The lists are short: from the first collision on a second name keeps people apart.
    return f"{name}-{_syllables(key, tweak, canonical, 1 + attempt)}" if attempt else name


def _digit(digit: str, like: str) -> str:
    """``digit`` in the script of the digit ``like``."""
    return chr(ord(like) - int(like) + int(digit))


def fitted(original: str, replacement: str, kind: str) -> str:
    """The replacement with the punctuation and case of the mention it stands for."""
    if kind in ("phone", "card", "ssn"):
        digits = iter(replacement)
        new = "".join(_digit(next(digits), c) if c.isdecimal() else c for c in original)
        like = next(c for c in reversed(original) if c.isdecimal())
        return new + "".join(_digit(d, like) for d in digits)
    if kind == "ip":
        return "".join(_digit(c, original[0]) if c.isdecimal() else c for c in replacement)
    if kind == "surname" or kind.startswith("given"):
        if original.isupper() and len(original) > 1:
            return replacement.upper()
        return "-".join(part[:1].upper() + part[1:] for part in replacement.split("-"))
    if kind == "secret" and not set(original.lower()) <= set(HEX):
        return replacement
    if original == original.upper():
        return "".join(map(_upper, replacement))
    if kind == "email" and len(original) == len(replacement):
        return "".join(_upper(r) if o.isupper() else r for o, r in zip(original, replacement, strict=True))
    return replacement


def replaced(key: bytes, text: str | None, attempts: dict[tuple[str, str], int]) -> tuple[str | None, list[dict]]:
    """The text with surrogates, and a record of each replacement."""
    found = entities_of(text)
    if not found:
        return text, []
    parts, records, at = [], [], 0
    for start, end, kind, canonical in found:
        new = surrogate(key, kind, canonical, attempts.get((kind, canonical), 0))
        new = fitted(text[start:end], new, kind)
        parts += [text[at:start], new]
        records.append({"kind": kind.split("-")[0], "start": start, "end": end, "surrogate": new})
        at = end
    return "".join([*parts, text[at:]]), records


# ---- collisions over all documents -------------------------------------------------------------


def mentions(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``doc``, ``kind``, ``canonical`` of the entities of every text, once for each document."""
    source = only(docs, key, text)
    schema = T.StructType(
        [
            T.StructField("doc", source.schema[key].dataType),
            T.StructField("kind", T.StringType()),
            T.StructField("canonical", T.StringType()),
        ]
    )

    def start():
        import pyarrow as pa

        def work(batch):
            found = [sorted({e[2:] for e in entities_of(t)}) for t in batch.column(1).to_pylist()]
            index = pa.array([i for i, some in enumerate(found) for _ in some], pa.int64())
            return {
                "doc": batch.column(0).take(index),
                "kind": [kind for some in found for kind, _ in some],
                "canonical": [canonical for some in found for _, canonical in some],
            }

        return work

    return arrow_map(source, start, schema)


def _drawn(entities: DataFrame, secret: bytes) -> DataFrame:
    """``entities`` (kind, canonical, attempt) with ``drawn``, their surrogates."""
    fields = ("kind", "canonical", "attempt")
    schema = T.StructType([*(entities.schema[f] for f in fields), T.StructField("drawn", T.StringType())])

    def start():
        def work(batch):
            columns = [batch.column(i) for i in range(3)]
            rows = zip(*(c.to_pylist() for c in columns), strict=True)
            return dict(zip(fields, columns, strict=True)) | {
                "drawn": [surrogate(secret, kind, canonical, attempt) for kind, canonical, attempt in rows]
            }

        return work

    return arrow_map(entities.select(*fields), start, schema, rows=4096)


def _family(kind: Column) -> Column:
    """Given names of all genders share one family; other kinds are their own."""
    return F.when(kind.startswith("given"), F.lit("given")).otherwise(kind)


def collisions(tables: OwnedTables, found: DataFrame, secret: bytes) -> tuple[DataFrame, int]:
    """Entities whose attempt is above 0, and how many they are.

    Each round draws surrogates for the entities still open, and finds those
    that equal a real entity of their family, or one drawn for another entity of it; of
    equal ones the first by canonical form and kind keeps it. Rounds go on until
    every surrogate is one entity's alone and no real one: with each draw there are more
    values to draw from, so they end.
    """
    everyone = tables.write(found.select("kind", "canonical").distinct().withColumn("attempt", F.lit(0)), "entities")
    current, step = tables.write(_drawn(everyone, secret), "drawn-0"), 0
    real = everyone.select(_family(F.col("kind")).alias("real_family"), F.col("canonical").alias("real")).distinct()
    holder = F.struct("canonical", "kind")
    while True:
        checked = current.withColumn("family", _family(F.col("kind")))
        taken = (
            checked.groupBy("family", "drawn")
            .agg(F.min(holder).alias("first"), F.count(F.lit(1)).alias("users"))
            .where("users > 1")
            .select(F.col("family").alias("taken_family"), F.col("drawn").alias("taken"), "first")
        )
        twice = checked.join(
            taken, (F.col("family") == F.col("taken_family")) & (F.col("drawn") == F.col("taken"))
        ).where(holder != F.col("first"))
        again = (
            checked.join(real, (F.col("family") == F.col("real_family")) & (F.col("drawn") == F.col("real")))
            .select("kind", "canonical")
            .unionByName(twice.select("kind", "canonical"))
            .distinct()
        )
        open_now = tables.write(again, f"open-{step}")
        if open_now.isEmpty():
            break
        step += 1
        marked = open_now.select(F.col("kind").alias("k"), F.col("canonical").alias("c"))
        on = (F.col("kind") == F.col("k")) & (F.col("canonical") == F.col("c"))
        moved = _drawn(
            current.join(marked, on, "left_semi").withColumn("attempt", F.col("attempt") + 1), secret
        )
        current = tables.write(current.join(marked, on, "left_anti").unionByName(moved), f"drawn-{step}")
    exceptions = current.where("attempt > 0").select("kind", "canonical", "attempt")
    return exceptions, exceptions.count()


RECORD = T.ArrayType(
    T.StructType(
        [
            T.StructField("kind", T.StringType()),
            T.StructField("start", T.IntegerType()),
            T.StructField("end", T.IntegerType()),
            T.StructField("surrogate", T.StringType()),
        ]
    )
)


def _spare(names: list[str], wanted: str) -> str:
    while wanted in names:
        wanted += "_"
    return wanted


def with_surrogates(docs: DataFrame, secret: bytes, key: str = "doc_id", text: str = "text", records: str | None = "entities") -> DataFrame:
    """``docs`` with its columns, surrogates in ``text`` and a record of them in ``records``.

    A null text stays null and has no entities, an empty one stays empty. Rows
    with equal texts get equal results; a repeated or null key is no harm, since a
    surrogate depends on the entity alone. A column named like ``records`` is
    replaced by it; other columns are passed on as they are.
    """
    spark = docs.sparkSession
    importable(spark)
    tables = OwnedTables(spark, "pii")
    found = tables.write(mentions(docs, key, text), "mentions")
    exceptions, count = collisions(tables, found, secret)
    base = docs.drop(records) if records else docs
    names = base.columns
    spare = _spare(names, "_attempts")
    attempts_type = T.ArrayType(
        T.StructType(
            [
                T.StructField("kind", T.StringType()),
                T.StructField("canonical", T.StringType()),
                T.StructField("attempt", T.IntegerType()),
            ]
        )
    )
    if count:
        # Written, so that Spark knows its size and decides by it whether to broadcast.
        by_doc = tables.write(
            found.join(exceptions, ["kind", "canonical"])
            .groupBy(F.col("doc").alias("_doc"))
            .agg(F.collect_list(F.struct("kind", "canonical", "attempt")).alias(spare)),
            "by_doc",
        )
        source = base.join(by_doc, base[key].eqNullSafe(by_doc["_doc"]), "left").select(
            *(base[n] for n in names), by_doc[spare]
        )
    else:
        source = base.withColumn(spare, F.lit(None).cast(attempts_type))
    at = names.index(text)
    fields = list(base.schema.fields) + ([T.StructField(records, RECORD)] if records else [])

    def start():
        def work(batch):
            out = {name: batch.column(i) for i, name in enumerate(names)}
            attempts = [
                {(e["kind"], e["canonical"]): e["attempt"] for e in row or ()}
                for row in batch.column(len(names)).to_pylist()
            ]
            rows = [replaced(secret, t, a) for t, a in zip(batch.column(at).to_pylist(), attempts, strict=True)]
            out[text] = [row[0] for row in rows]
            if records:
                out[records] = [row[1] for row in rows]
            return out

        return work

    return arrow_map(source, start, T.StructType(fields))
