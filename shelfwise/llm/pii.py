"""Replaces personal data and secrets by keyed surrogates of the same type and form."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator
from hashlib import shake_256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import LongType, StructField, StructType

# Key of the registered query. A deployment passes a secret of its own.
QUERY_KEY = "op8"
ROUNDS = 8

# Titles by gender, and given names by gender and script.
TITLES = {
    "f": "Mrs Ms Miss Frau Mme Madame Mlle Señora Sra Signora Lady Г-жа Госпожа Κυρία".split(),
    "m": "Mr Mister Herr M Monsieur Señor Sr Signor Sir Г-н Господин Κύριος".split(),
    "n": "Dr Prof Professor Doctor Dra Доктор".split(),
}
GIVEN = {
    ("f", "latin"): "Anna Maria Julia Laura Sophie Emma Clara Elena Marta Nora Alice Eva Lucia Sarah Mary Emily".split(),
    ("m", "latin"): "Peter Paul Martin Lukas Thomas Daniel David Simon Oscar Hugo Leo Adrian John James Michael Robert".split(),
    ("f", "cyrillic"): "Анна Мария Елена Ольга Ирина Наталья Вера Татьяна".split(),
    ("m", "cyrillic"): "Иван Пётр Алексей Сергей Дмитрий Андрей Николай Павел".split(),
    ("f", "greek"): "Μαρία Ελένη Άννα Σοφία Κατερίνα Βασιλική".split(),
    ("m", "greek"): "Γιώργος Νίκος Δημήτρης Πέτρος Ανδρέας Κώστας".split(),
}
# Beginnings of surrogates of family names. No name or beginning of a script begins another one, so that the rest of a
# surrogate can be told from it.
FAMILY = {
    "latin": "Bran Dorn Falk Gren Holt Kron Lund Quist Rusk Stol Thor Vald Wren Zand".split(),
    "cyrillic": "Бран Ворх Гром Дуб Зор Крон Лунд Рост Стол Тор Хром".split(),
    "greek": "Βαλτ Γριβ Δορκ Ζαχ Θρασ Καλφ Λυκ Ρηγ Στρατ Φωκ".split(),
}
FAMILY_END = {"latin": "", "cyrillic": "", "greek": "ος"}
GENDER_OF = {name: g for (g, _), names in GIVEN.items() for name in names}

_title = "|".join(sorted({re.escape(t) for ts in TITLES.values() for t in ts}, key=len, reverse=True))
_given = "|".join(sorted(map(re.escape, GENDER_OF), key=len, reverse=True))
_name = r"[^\W\d_]\w+(?:[-'’][^\W\d_]\w+)?"
# Words after which a name stands that is in no list.
_cue = r"[Mm]y name is|[Nn]ame:|[Aa]uthor:|[Ww]ritten by|[Ss]igned by|[Cc]ontact|[Rr]egards,|[Ss]incerely,|[Aa]ttn\.?:?"
# In order of precedence where matches begin at one place. Runs are possessive or bounded: each pattern is linear.
PATTERNS = {
    "secret": r"(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\b[\"']?[ \t]*[=:][ \t]*[\"']?)(?P<secret>[A-Za-z0-9_\-+/=.]{6,})",
    "email": r"(?P<email>(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,64}+@(?:[A-Za-z0-9\-]{1,63}+\.)+[A-Za-z]{2,})",
    "ipv6": r"(?<![\w:.])(?P<ipv6>(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:])",
    "mac": r"(?<![\w:-])(?P<mac>(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2})(?![\w:-])",
    "iban": r"\b(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)\b",
    "ip": r"(?<![\w.])(?P<ip>(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d))(?!\.?\d)",
    "ssn": r"(?<![\w-])(?P<ssn>\d{3}-\d{2}-\d{4})(?![\w-])",
    "card": r"(?<![\w-])(?P<card>\d(?:[ -]?\d){12,18})(?![\w-])",
    "phone": r"(?<![\w.])(?P<phone>\+\d{1,3}[ .\-/]?(?:\(\d{1,5}\)[ .\-/]?)?\d(?:[ .\-/]?\d){4,13}|\(\d{3}\)[ .\-]?\d{3}[ .\-]\d{4}|\d{3}[.\-]\d{3}[.\-]\d{4}|0\d{1,4} \d{3,4} \d{3,4})(?!\w)",
    "name": rf"\b(?:(?P<title>{_title})\.?[ \t]+)(?P<name>{_name}(?:[ \t]+{_name}){{0,2}})|\b(?P<plain>(?:{_given})[ \t]+{_name})",
    "cued": rf"(?:{_cue})[ \t\n]+(?P<cued>{_name}(?:[ \t]+{_name}){{1,2}})",
}
KINDS = ("secret", "email", "ipv6", "mac", "iban", "ip", "ssn", "card", "phone", "name", "plain", "cued")
# What a text must have for a pattern to match at all; most texts have none of the rarer ones.
NEEDS = {
    "secret": re.compile(r"(?i)passw|pwd|secret|token|key"),
    "email": re.compile("@"),
    "ipv6": re.compile("[0-9A-Fa-f]:"),
    "mac": re.compile("[0-9A-Fa-f]{2}[:-][0-9A-Fa-f]{2}[:-]"),
    "iban": re.compile(r"[A-Z]{2}\d{2}"),
    "ip": re.compile(r"\d\.\d"),
    "ssn": re.compile(r"\d-\d"),
    "card": re.compile(r"\d[ -]?\d[ -]?\d"),
    "phone": re.compile(r"\+\d|\(\d|\d[. -]\d"),
    "name": re.compile(rf"(?:{_title})\.?[ \t]|(?:{_given})[ \t]"),
    "cued": re.compile(_cue),
}
ENTITY = {kind: re.compile(pattern) for kind, pattern in PATTERNS.items()}


def _matches(text: str) -> Iterator[re.Match]:
    """Matches of all patterns from left to right, without overlaps; at one place the first pattern wins."""
    able = [kind for kind in ENTITY if NEEDS[kind].search(text)]
    ahead = {kind: ENTITY[kind].search(text) for kind in able}
    while True:
        found = [m for kind in able if (m := ahead[kind])]
        if not found:
            return
        first = min(found, key=lambda m: m.start())
        yield first
        for kind in able:
            while (m := ahead[kind]) and m.start() < first.end():
                ahead[kind] = ENTITY[kind].search(text, first.end())


def script_of(text: str) -> str:
    for c in text:
        if "\u0370" <= c <= "\u03ff" or "\u1f00" <= c <= "\u1fff":
            return "greek"
        if "\u0400" <= c <= "\u04ff":
            return "cyrillic"
    return "latin"


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, entity) without overlaps. The entity is the value without its form: digits of a
    number, lower case of an address, so that all its mentions agree. Name parts are entities of their own:
    'given:f' and 'family' keep a name and its parts in agreement."""
    out = []
    for m in _matches(text):
        kind = next(k for k in KINDS if k in m.groupdict() and m[k])
        start, end = m.span(kind)
        value = m[kind]
        if kind in ("card", "phone", "ssn"):
            out.append((start, end, kind, re.sub(r"\D", "", value)))
        elif kind in ("name", "plain", "cued"):
            parts = [(start + p.start(), start + p.end(), p[0]) for p in re.finditer(_name, value)]
            if not all(p[2][0].isupper() for p in parts):
                parts = parts[: next(i for i, p in enumerate(parts) if not p[2][0].isupper())]
            if not parts or (kind != "name" and len(parts) < 2):
                continue
            title = next((g for g, ts in TITLES.items() if m["title"] in ts), "n") if kind == "name" else "n"
            for i, (low, high, word) in enumerate(parts):
                gender = GENDER_OF.get(word)
                if i == 0 and (gender or len(parts) > 1):
                    out.append((low, high, f"given:{gender or title}:{script_of(word)}", word.lower()))
                else:
                    out.append((low, high, f"family:{script_of(word)}", word.lower()))
        elif kind == "iban":
            out.append((start, end, kind, value.replace(" ", "")))
        elif kind in ("email", "mac", "ipv6"):
            out.append((start, end, kind, value.lower()))
        else:
            out.append((start, end, kind, value))
    return out


def _keyed(key: str, *parts: object, bits: int = 64) -> int:
    """A number of so many bits from a keyed hash."""
    message = "\x00".join(map(str, (len(key), key, *parts))).encode("utf-8", "surrogatepass")
    return int.from_bytes(shake_256(message).digest(bits + 7 >> 3), "big") & (1 << bits) - 1


def _permuted(key: str, kind: str, size: int, x: int, back: bool = False) -> int:
    """A keyed permutation of 0 .. size - 1, by a balanced Feistel network walked until it is back in range."""
    half = max(1, (size - 1).bit_length() + 1 >> 1)
    mask = (1 << half) - 1
    mixed = functools.partial(_keyed, key, kind, size, bits=half)
    while True:
        left, right = x >> half, x & mask
        for step in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if back:
                left, right = right ^ mixed(step, left), left
            else:
                left, right = right, left ^ mixed(step, right)
        x = left << half | right
        if x < size:
            return x


def moved(key: str, kind: str, size: int, x: int) -> int:
    """Another number below `size`: a permutation without fixed points (for a size of 1 there is no other)."""
    return _permuted(key, kind, size, (_permuted(key, kind, size, x) + 1) % size, True)


def _class(alphabet: str) -> dict[str, tuple[str, int]]:
    return {c: (alphabet, i) for i, c in enumerate(alphabet)}


def _classes(*alphabets: str) -> dict[str, tuple[str, int]]:
    return {c: place for alphabet in alphabets for c, place in _class(alphabet).items()}


DIGITS = "0123456789"
HAN = "".join(map(chr, range(0x4E00, 0x9FA6)))
# Letters are replaced inside their class: vowels by vowels, so that a made-up word can be read like the one it replaces.
WORD = _classes(
    DIGITS, "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "àáâãäåæèéêëìíîïòóôõöøùúûü", "çñß",
    "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "АЕИОУЫЭЮЯ", "БВГДЖЗЙКЛМНПРСТФХЦЧШЩ", "αεηιουω", "βγδζθκλμνξπρστφχψ",
    "άέήίόύώ", HAN,
)
CODE = _classes(DIGITS, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
HEX = _classes(DIGITS, "abcdef", "ABCDEF")


def reshaped(key: str, kind: str, text: str, classes: dict[str, tuple[str, int]]) -> str:
    """Each character by one of its class, the others as they are.

    Texts of one shape (classes and other characters by place) are permuted among themselves, so different texts give
    different ones, and none gives itself, if any character has a class of two or more.
    """
    size, x = 1, 0
    for c in text:
        if c in classes:
            alphabet, place = classes[c]
            size, x = size * len(alphabet), x * len(alphabet) + place
    # The shape is part of the key: texts of other shapes use other permutations.
    shape = "".join(classes[c][0][0] if c in classes else c for c in text)
    x = moved(key, f"{kind}/{shape}", size, x)
    out = []
    for c in reversed(text):
        if c in classes:
            alphabet = classes[c][0]
            x, place = divmod(x, len(alphabet))
            c = alphabet[place]
        out.append(c)
    return "".join(reversed(out))


def luhn(digits: str) -> int:
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10


def _check_digit(body: str) -> int:
    return -luhn(body + "0") % 10


def _iban_check(bban: str, country: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in bban + country + "00")) % 97


def surrogate(kind: str, entity: str, key: str) -> str:
    """Replacement of an entity, itself in the plain form of `find`; a function of key, kind and entity alone.

    Different entities of a kind have different surrogates by construction: what is replaced is permuted among texts of one
    shape, what is kept (first digits, endings, whether a check digit holds) stays, and chosen beginnings
    of names can be read back. So no other entity need be known, the same key gives the same surrogate in
    every run, and no surrogate is the entity itself.
    """
    if kind == "email":
        local, _, domain = entity.partition("@")
        return f"{reshaped(key, kind, local, WORD)}@{reshaped(key, 'domain', domain, WORD)}.example.org"
    if kind == "ip":
        numbers = [int(x) for x in entity.split(".")]
        # The first and last number of an address of a host stay between 1 and 254, others are permuted apart.
        host = 0 < numbers[0] < 255 and 0 < numbers[3] < 255
        sizes, low = ((254, 256, 256, 254), (1, 0, 0, 1)) if host else ((256,) * 4, (0,) * 4)
        size, x = 1, 0
        for number, radix, least in zip(numbers, sizes, low, strict=True):
            size, x = size * radix, x * radix + number - least
        while True:
            out, x = [], moved(key, f"ip/{host}", size, x)
            rest = x
            for radix, least in zip(reversed(sizes), reversed(low), strict=True):
                rest, number = divmod(rest, radix)
                out.append(number + least)
            # Outside of host addresses the permutation is walked until it is outside again.
            if host or not (0 < out[3] < 255 and 0 < out[0] < 255):
                return ".".join(map(str, reversed(out)))
    if kind == "card":
        body, last = entity[:-1], int(entity[-1])
        other = entity[0] + reshaped(key, kind, body[1:], CODE)
        return other + str((_check_digit(other) + last - _check_digit(body)) % 10)
    if kind == "phone":
        keep = 1 if len(entity) > 10 else 0
        return entity[:keep] + reshaped(key, kind, entity[keep:], CODE)
    if kind == "iban":
        country, check, bban = entity[:2], int(entity[2:4]), entity[4:]
        other = reshaped(key, kind + country, bban, CODE)
        if 2 <= check <= 98:
            check = 2 + (_iban_check(other, country) - 2 + check - _iban_check(bban, country)) % 97
        return f"{country}{check:02d}{other}"
    if kind in ("mac", "ipv6"):
        return reshaped(key, kind, entity, HEX)
    if kind.startswith(("given", "family")):
        kind, *gender, script = kind.split(":")
        if kind == "family":
            first = FAMILY[script]
        else:
            who = "fm"[_keyed(key, "gender", entity) % 2] if gender[0] == "n" else gender[0]
            first = GIVEN[who, script]
        end = FAMILY_END[script] if kind == "family" else ""
        return first[_keyed(key, kind, entity) % len(first)] + reshaped(key, kind, entity, WORD) + end
    if all(c in HEX or not c.isalnum() for c in entity):
        return reshaped(key, kind, entity, HEX)
    while True:
        # Secrets beyond hexadecimal digits stay apart from those.
        entity = reshaped(key, kind, entity, CODE)
        if not all(c in HEX or not c.isalnum() for c in entity):
            return entity


def in_form_of(mention: str, kind: str, value: str) -> str:
    """The surrogate written as the mention is: its separators and its case."""
    if kind in ("card", "phone", "ssn"):
        digits = iter(value)
        return "".join(next(digits) if c.isdigit() else c for c in mention)
    if kind == "iban":
        characters = iter(value)
        return "".join(c if c == " " else next(characters) for c in mention)
    if mention.isupper() and len(mention) > 1 and kind.startswith(("given", "family", "email", "mac", "ipv6")):
        return value.upper()
    return value


def replaced(text: str, give: Callable[[str, str], str]) -> tuple[str, int]:
    """The text with the surrogates that `give` has for (kind, entity), and how many mentions were replaced."""
    out, at, count = [], 0, 0
    for start, end, kind, entity in find(text):
        out += [text[at:start], in_form_of(text[start:end], kind, give(kind, entity))]
        at, count = end, count + 1
    return "".join([*out, text[at:]]), count


def assign(entities: DataFrame, key: str) -> DataFrame:
    """(kind, entity) to (kind, entity, surrogate): the table that links both, for whoever may hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch["kind"].to_pylist(), batch["entity"].to_pylist(), strict=True)
            yield batch.append_column("surrogate", pa.array([surrogate(k, e, key) for k, e in rows], pa.string()))

    return entities.select("kind", "entity").distinct().mapInArrow(run, "kind string, entity string, surrogate string")


def entities(docs: DataFrame) -> DataFrame:
    """The distinct (kind, entity) of all texts; each task drops its own repeats first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {(k, e) for text in batch["text"].to_pylist() for _, _, k, e in find(text or "")}
            kinds, values = zip(*sorted(found), strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(values, pa.string())], ["kind", "entity"])

    return docs.select("text").mapInArrow(run, "kind string, entity string").distinct()


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """`docs` (doc_id, text, ...) with surrogates in text, and n_entities (mentions replaced).

    An entity has the same surrogate everywhere, in all runs with this key, and no two entities of a kind share one (see
    `surrogate`). So texts are replaced where they are, without a shuffle. Null and empty texts stay as they are,
    repeated rows get the same text. An existing n_entities is replaced, other columns stay.
    """
    columns = [c for c in docs.columns if c != "n_entities"]
    kept = docs.select(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give = functools.lru_cache(maxsize=65_536)(functools.partial(surrogate, key=key))
        for batch in batches:
            pairs = [(text, 0) if not text else replaced(text, give) for text in batch["text"].to_pylist()]
            texts = pa.array([text for text, _ in pairs], pa.string())
            arrays = [texts if n == "text" else batch[n] for n in batch.schema.names]
            counts = pa.array([count for _, count in pairs], pa.int64())
            yield pa.RecordBatch.from_arrays([*arrays, counts], [*batch.schema.names, "n_entities"])

    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField("n_entities", LongType())]))


def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All whole texts of `documents` with surrogates."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pseudonymise(docs, QUERY_KEY).select("doc_id", "text", "n_entities")
