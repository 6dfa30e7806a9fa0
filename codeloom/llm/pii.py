"""Operator 8: personal data replaced by keyed, type-consistent surrogates.

Found are e-mail addresses, phone numbers, card numbers (with a valid check digit), bank accounts (IBAN, valid), national numbers
(three, two and four digits), IP addresses of both kinds and personal names. Surrogates keep type and form:

- numbers and addresses pass through a keyed permutation of all values of the same form (a Feistel network over mixed radices), so
  two entities never get one surrogate and one entity gets the same everywhere; signs, letter case, country codes, the validity of
  cards and accounts, and an IP address's range (private, loopback, public; the first group of an IPv6 address) stay;
- listed given names move along a keyed cycle of the names of the same gender and script, listed surnames along one of the same
  script. In other names each letter passes through such a permutation of its kind (vowels, consonants, or the letters of its
  script), past the listed ones; endings that tell the gender stay. So names, too, keep apart in the whole corpus.

In each document a surrogate that equals an entity of the text, or one already given to another entity, is replaced by the next in
the keyed order. The same number written differently, or a name with and without given name, stays one entity: once a title or a
listed given name shows a name, its parts are replaced wherever the document has them, also before 's and in capitals.

Names need a capital letter, and a title or a listed given name once in the document. Where the permutation leaves a name as it is
(most likely one of a single letter), one of the listed names takes its place.

Null text stays null; empty text stays empty; repeated rows get equal answers; of overlapping finds the earlier kind wins, in the
order above; texts of any length are handled whole; an empty table gives no rows; extra columns, whatever their names, pass through.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.llm._shared import map_slices

KEY = b"codeloom surrogate key 1"
KINDS = ("email", "phone", "card", "iban", "national", "ip", "name")

# Names by script and gender, titles by gender.
GIVEN = {
    ("latin", "f"): "Alice Anna Barbara Carmen Claire Elena Emma Eva Greta Helen Ingrid Isabel Jane Julia Katharina Laura Lucia Maria Marie Mary Nora Olivia Paula Rosa Sarah Sofia Sophie Susan Teresa Ursula".split(),
    ("latin", "m"): "Adam Andreas Antonio Carlos Charles Daniel David Diego Felix Francisco George Hans Henri Hugo James Jean John Jorge Karl Louis Luis Marc Martin Michael Miguel Otto Paul Peter Pierre Thomas".split(),
    ("cyrillic", "f"): "Анна Екатерина Елена Ирина Мария Наталья Ольга Светлана Татьяна Юлия".split(),
    ("cyrillic", "m"): "Александр Алексей Андрей Дмитрий Иван Михаил Николай Павел Сергей Юрий".split(),
}
SURNAMES = {
    "latin": "Becker Bernard Brown Carter Dubois Fischer Garcia Gomez Hoffmann Hughes Jones Lambert Lopez Martinez Mercier Meyer Miller Moreau Moreno Navarro Parker Petit Richter Roberts Romero Schmidt Schneider Smith Taylor Torres Wagner Weber".split(),
    "cyrillic": "Волков Григорьев Захаров Иванов Козлов Лебедев Морозов Новиков Павлов Петров Семёнов Соколов".split(),
}
TITLES = {"f": "Mrs Ms Miss Frau Madame Mme Mademoiselle Señora Sra Doña".split(), "m": "Mr Herr Monsieur Señor Sr Don".split(), "": ["Dr", "Prof"]}

# Telephone country codes of one and of two digits (the others have three), letters by kind, endings that tell a gender.
COUNTRY_1 = "1 7".split()
COUNTRY_2 = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
LETTERS = ["aeiou", "bcdfghjklmnpqrstvwxyz", "àáâãäåèéêëìíîïòóôõöùúûü", "çñšžčćřłśźżďťňğş", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ"]
ENDINGS = tuple("ова ева ёва ина ская ов ев ёв ин ский".split())

_PLACE = {c: (kind, i) for kind, letters in enumerate(LETTERS) for i, c in enumerate(letters)}

_WORD = r"[^\W\d_]+(?:[-'][^\W\d_]+)*"
_SCRIPTS = (("latin", "A", "Z"), ("cyrillic", "Ѐ", "ӿ"))
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NUMBER = re.compile(r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?)?\d(?:[ .-]?\d)+(?![\w])")
_IP = re.compile(r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d)")
_IPV6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:|::)(?:[0-9A-Fa-f]{0,4}:){1,6}[0-9A-Fa-f]{1,4}(?![\w:]|\.\d)")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?!\w)")
_NATIONAL = re.compile(r"(?<![\w.-])(?!000|666|9)\d{3}([ -])(?!00)\d{2}\1(?!0000)\d{4}(?![\w-])")
_TITLE_OF = {t: g for g, ts in TITLES.items() for t in ts}
_GIVEN_OF = {n: k for k, ns in GIVEN.items() for n in ns}
_SURNAME_OF = {n: s for s, ns in SURNAMES.items() for n in ns}
_NAME = re.compile(rf"(?<!\w)(?:(?P<title>{'|'.join(sorted(_TITLE_OF, key=len, reverse=True))})\.?\x20+)?(?P<names>{_WORD}(?:\x20{_WORD})?)")
_NAME_START = re.compile(rf"(?<!\w)(?:(?:{'|'.join(_TITLE_OF)})\.?\x20+(?=[^\W\d_])|(?:{'|'.join(_GIVEN_OF)})(?!\w))")
_HINTS = {*_GIVEN_OF, *_TITLE_OF}
_RUN = re.compile(r"[^\W\d_]+")


def _keyed(key: bytes, *parts: object) -> int:
    return int.from_bytes(hashlib.blake2b("\x1f".join(map(str, parts)).encode(), key=key[:64], digest_size=16).digest(), "big")


def permute(digits: list[int], radices: list[int], key: bytes, tweak: str, rounds: int = 8) -> list[int]:
    """A keyed permutation of all digit rows with these radices."""
    half = len(digits) // 2
    size, value = [1, 1], [0, 0]
    for side, part in ((0, slice(None, half)), (1, slice(half, None))):
        for d, r in zip(digits[part], radices[part], strict=True):
            value[side], size[side] = value[side] * r + d, size[side] * r
    for i in range(rounds):
        side = (i + 1) % 2 if size[0] > 1 else 1
        value[side] = (value[side] + _keyed(key, tweak, i, value[1 - side])) % size[side]
    out: list[int] = []
    for side, part in ((1, radices[half:]), (0, radices[:half])):
        for r in reversed(part):
            value[side], d = divmod(value[side], r)
            out.append(d)
    return out[::-1]


def _letters(text: str, key: bytes, tweak: str) -> str:
    """Letters and digits of a lower-case text permuted within its form; other characters stay."""
    places = [i for i, c in enumerate(text) if c.isascii() and c.isalnum()]
    form = "".join("9" if c.isdigit() else "a" if c.isascii() and c.isalpha() else c for c in text)
    got = permute([int(text[i]) if text[i].isdigit() else ord(text[i]) - 97 for i in places], [10 if text[i].isdigit() else 26 for i in places], key, f"{tweak} {form}")
    out = list(text)
    for i, d in zip(places, got, strict=True):
        out[i] = str(d) if text[i].isdigit() else chr(97 + d)
    return "".join(out)


def _digits(text: str, key: bytes, tweak: str) -> str:
    return "".join(map(str, permute([*map(int, text)], [10] * len(text), key, f"{tweak} {len(text)}")))


def luhn(digits: str) -> int:
    """The check digit that makes digits + it valid."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 - i % 2)
        total += d - 9 * (d > 9)
    return -total % 10


def email_surrogate(entity: str, key: bytes) -> str:
    local, _, domain = entity.partition("@")
    labels = domain.split(".")
    return _letters(local, key, "local") + "@" + ".".join(x if i == len(labels) - 1 or x == "example" else _letters(x, key, "domain") for i, x in enumerate(labels))


def card_surrogate(entity: str, key: bytes) -> str:
    past = (int(entity[-1]) - luhn(entity[:-1])) % 10
    head = _digits(entity[:-1], key, "card")
    return head + str((luhn(head) + past) % 10)


def ip_range(a: int, b: int) -> str:
    if a == 10 or (a == 172 and 16 <= b < 32) or (a == 192 and b == 168):
        return "private"
    return "loopback" if a == 127 else "public" if 0 < a < 224 else "other"


def ip_surrogate(entity: str, key: bytes) -> str:
    at = [*map(int, entity.split("."))]
    kind = ip_range(*at[:2])
    while True:  # walking a permutation's cycle stays a permutation of the range
        at = permute(at, [256] * 4, key, "ip")
        if ip_range(*at[:2]) == kind:
            return ".".join(map(str, at))


def ipv6_surrogate(entity: str, key: bytes) -> str:
    first, *rest = ipaddress.IPv6Address(entity).exploded.split(":")
    return str(ipaddress.IPv6Address(":".join([first, *(f"{g:x}" for g in permute([int(x, 16) for x in rest], [1 << 16] * 7, key, "ipv6"))])))


def iban_check(country: str, account: str) -> str:
    """The two check digits of an IBAN."""
    return f"{98 - int(''.join(str(int(c, 36)) for c in account + country + '00')) % 97:02d}"


def iban_surrogate(entity: str, key: bytes) -> str:
    country, account = entity[:2], entity[4:]
    account = _letters(account.lower(), key, f"iban {country}").upper()
    return country + iban_check(country, account) + account


def national_surrogate(entity: str, key: bytes) -> str:
    while True:  # the cycle stays among the valid ones
        entity = _digits(entity, key, "national")
        if _NATIONAL.fullmatch(f"{entity[:3]}-{entity[3:5]}-{entity[5:]}"):
            return entity


def _kept(name: str) -> int:
    """How many letters at the end stay: an ending that tells the gender, or else the last letter."""
    return max((len(e) for e in ENDINGS if name.lower().endswith(e) and len(name) > len(e) + 1), default=int(len(name) > 2))


def _spelt(name: str, kept: int, key: bytes, tweak: str) -> str:
    """A name with its letters permuted within their kinds; case, marks, letters of no known kind and the last `kept` ones stay."""
    low = name.lower() if len(name.lower()) == len(name) else name
    kinds = [_PLACE.get(c) if i < len(low) - kept else None for i, c in enumerate(low)]
    form = " ".join(f"{k[0] if k else c}{'A' * (c != n)}" for c, n, k in zip(low, name, kinds, strict=True))
    found = [k for k in kinds if k]
    new = iter(permute([at for _, at in found], [len(LETTERS[kind]) for kind, _ in found], key, f"{tweak} {form}") if found else [])
    out = [LETTERS[k[0]][next(new)] if k else c for c, k in zip(low, kinds, strict=True)]
    return "".join(c.upper() if a != n else c for c, a, n in zip(out, low, name, strict=True))


def _new_name(name: str, key: bytes, tweak: str, listed: dict, pool: list[str], step: int) -> str:
    """The surrogate of a name that is not listed: never a listed one, and another for each name. One that the permutation leaves
    as it is, such as one without letters of a known kind, takes one of the pool."""
    k, kept, new = key if not step else key + str(step).encode(), _kept(name), name
    while True:  # the cycle leads back to the name itself at last, which is not listed
        new = _spelt(new, kept, k, tweak)
        if new not in listed and _kept(new) == kept:
            break
    return new if new != name else pool[_keyed(k, tweak, "pool", name) % len(pool)]


def script_of(word: str) -> str:
    return "cyrillic" if "Ѐ" <= word[0] <= "ӿ" else "latin"


def _cycle(pool: list[str], name: str, key: bytes, tweak: str, step: int) -> str:
    order = sorted(pool, key=lambda x: _keyed(key, tweak, x))
    return order[(order.index(name) + 1 + step) % len(order)]


def given_surrogate(entity: str, key: bytes, step: int = 0, gender: str = "") -> str:
    if entity in _GIVEN_OF:
        script, known = _GIVEN_OF[entity]
        return _cycle(GIVEN[script, known], entity, key, f"given {script} {known}", step)
    known = gender or "mf"[_keyed(key, "gender", entity) % 2]
    return _new_name(entity, key, "given", _GIVEN_OF, GIVEN[script_of(entity), known], step)


def surname_surrogate(entity: str, key: bytes, step: int = 0) -> str:
    script = script_of(entity)
    if entity in _SURNAME_OF:
        return _cycle(SURNAMES[script], entity, key, f"surname {script}", step)
    return _new_name(entity, key, "surname", _SURNAME_OF, SURNAMES[script], step)


def _same_case(model: str, text: str) -> str:
    if len(model) == len(text):
        return "".join(t.upper() if m.isupper() else t for m, t in zip(model, text, strict=True))
    return text.upper() if len(model) > 1 and model.isupper() else text


def _fill(model: str, digits: str) -> str:
    """digits in the places of model's digits."""
    left = iter(digits)
    return "".join(next(left) if c.isdigit() else c for c in model)


def detect(text: str) -> list[tuple[int, int, str, str, str]]:
    """(start, end, kind, entity, detail) in order, without overlaps. The entity is the same for all its written forms."""
    found: list[tuple[int, int, str, str, str]] = []
    if "@" in text:
        found += [(m.start(), m.end(), "email", m[0].lower(), "") for m in _EMAIL.finditer(text)]
    taken = [(a, b) for a, b, *_ in found]
    if any(c in text for c in "0123456789"):
        for m in _IBAN.finditer(text):
            entity = m[0].replace(" ", "")
            if not any(x < m.end() and m.start() < y for x, y in taken) and 15 <= len(entity) <= 34 and entity[2:4] == iban_check(entity[:2], entity[4:]):
                found.append((m.start(), m.end(), "iban", entity, ""))
        if text.count(":") > 2:
            for m in _IPV6.finditer(text):
                if _ipv6(m[0]):
                    found.append((m.start(), m.end(), "ip", ipaddress.IPv6Address(m[0]).compressed, "6"))
        for m in _IP.finditer(text):
            if all(int(x) < 256 and x == str(int(x)) for x in m[0].split(".")):
                found.append((m.start(), m.end(), "ip", m[0], ""))
        taken = [(a, b) for a, b, *_ in found]
        for m in _NUMBER.finditer(text):
            for a, b in _numbers(m[0], m.start()):
                s = text[a:b]
                digits = "".join(c for c in s if c.isdigit())
                if any(x < b and a < y for x, y in taken):
                    continue
                if s[0] != "+" and "(" not in s and 13 <= len(digits) <= 19:
                    if luhn(digits[:-1]) == int(digits[-1]):
                        found.append((a, b, "card", digits, ""))
                elif s[0] == "+" and 10 <= len(digits) <= 15:
                    cut = country_length(digits)
                    found.append((a, b, "phone", digits[cut:], digits[:cut]))
                elif 10 <= len(digits) <= 15 and (s[0] == "(" or re.fullmatch(r"\d{3}[ .-]\d{3}[ .-]\d{4}", s)):
                    found.append((a, b, "phone", digits[-10:], digits[:-10]))
        taken = [(a, b) for a, b, *_ in found]
        for m in _NATIONAL.finditer(text):
            if not any(x < m.end() and m.start() < y for x, y in taken):
                found.append((m.start(), m.end(), "national", m[0].replace(m[1], ""), ""))
        taken = [(a, b) for a, b, *_ in found]
    if not _HINTS.isdisjoint(_RUN.findall(text)):  # a title or given name that _NAME_START matches is a whole run of letters
        for m in _NAME_START.finditer(text):
            n = _NAME.match(text, m.start())
            if not n:
                continue
            words = n["names"].split(" ")
            if not words[0][0].isupper():
                continue
            at = n.start("names")
            title = _TITLE_OF.get(n["title"] or "", "")
            if len(words) == 2 and not words[1][0].isupper():
                words = words[:1]
            bare = [_bare(w) for w in words]
            if len(words) == 2 and bare[0] != words[0]:  # "Anna's Becker": the second word is another matter
                words, bare = words[:1], bare[:1]
            first = "given" if len(bare) == 2 or not n["title"] or bare[0] in _GIVEN_OF else "surname"
            for role, w, b in zip((first, "surname"), words, bare, strict=False):
                if not any(x < at + len(b) and at < y for x, y in taken):
                    found.append((at, at + len(b), "name", f"{role} {_one_form(b)}", title))
                    taken.append((at, at + len(b)))
                at += len(w) + 1
        found += _mentions(text, found)
    return sorted(found)


def country_length(digits: str) -> int:
    return 1 if digits[0] in COUNTRY_1 else 2 if digits[:2] in COUNTRY_2 else 3


def _ipv6(text: str) -> bool:
    """Whether text is an address, with a digit and at least three groups, and not the word "std::" or a time of day."""
    if len([g for g in text.split(":") if g]) < 3 or text.isalpha() or not any(c.isdigit() for c in text):
        return False
    try:
        return bool(ipaddress.IPv6Address(text))
    except ValueError:
        return False


def _bare(word: str) -> str:
    """A name without a possessive 's, and without what is joined to it in small letters ("Anna-like")."""
    word = re.sub(r"'[sS]?$", "", word)
    parts = re.split("([-'])", word)
    for i in range(2, len(parts), 2):
        if not parts[i][0].isupper():
            return "".join(parts[: i - 1])
    return word


def _one_form(name: str) -> str:
    return name.title() if len(name) > 1 and name.isupper() else name


def _mentions(text: str, found: list[tuple[int, int, str, str, str]]) -> list[tuple[int, int, str, str, str]]:
    """The other places of the names found in this text, also in capitals. Single letters are initials and not searched."""
    names: dict[str, tuple[str, str]] = {}
    for _, _, kind, entity, detail in sorted(found):
        name = entity.split(" ", 1)[1] if kind == "name" else ""
        if len(name) > 1:
            names.setdefault(name, (entity, detail))
            names.setdefault(name.upper(), (entity, detail))
    if not names:
        return []
    taken = bytearray(len(text))
    for a, b, *_ in found:
        taken[a:b] = b"\1" * (b - a)
    more = []
    for name in sorted((n for n in names if not _RUN.fullmatch(n)), key=len, reverse=True):
        more += [(m.start(), m.end(), "name", *names[name]) for m in re.finditer(rf"(?<!\w){re.escape(name)}(?!\w)", text)]
    for m in _RUN.finditer(text):
        if m[0] in names and not re.match(r"\w", text[m.end() : m.end() + 1]) and not re.match(r"\w", text[max(0, m.start() - 1) : m.start()]):
            more.append((m.start(), m.end(), "name", *names[m[0]]))
    out = []
    for x in more:
        if not any(taken[x[0] : x[1]]):
            taken[x[0] : x[1]] = b"\1" * (x[1] - x[0])
            out.append(x)
    return out


def _numbers(s: str, at: int) -> list[tuple[int, int]]:
    """A run of digits and single marks as the numbers in it: groups that are cards or phones for themselves are cut apart."""
    cut = [*re.finditer(r"\+?\d{0,3}[ .-]?\(\d{2,4}\)[ .-]?\d{3}[ .-]?\d{4}(?!\d)|\+\d{1,3}(?:[ .-]?\d){9,12}(?!\d)|(?<!\d)\d{13,19}(?!\d)|(?<!\d)\d{4}([ -])\d{4}\1\d{4}\1\d{4}(?!\d)|(?<!\d)\d{4}([ -])\d{6}\2\d{5}(?!\d)|(?<!\d)\d{3}[ .-]\d{3}[ .-]\d{4}(?!\d)", s)]
    return [(at + m.start(), at + m.end()) for m in cut]


def surrogate(kind: str, entity: str, detail: str, key: bytes, step: int) -> str:
    """The surrogate of an entity; step > 0 asks for the next one."""
    k = key if not step else key + str(step).encode()
    if kind == "email":
        return email_surrogate(entity, k)
    if kind == "phone":
        return _digits(entity, k, "phone")
    if kind == "card":
        return card_surrogate(entity, k)
    if kind == "ip":
        return ipv6_surrogate(entity, k) if detail else ip_surrogate(entity, k)
    if kind == "iban":
        return iban_surrogate(entity, k)
    if kind == "national":
        return national_surrogate(entity, k)
    role, name = entity.split(" ", 1)
    proper = name.capitalize() if name.isupper() and len(name) > 1 else name
    return given_surrogate(proper, key, step, detail) if role == "given" else surname_surrogate(proper, key, step)


def replace(text: str, key: bytes = KEY) -> tuple[str, list[dict]]:
    """The text with surrogates, and the spans in the original text."""
    found = detect(text)
    if not found:
        return text, []
    own = {(kind, e.split(" ", 1)[1].capitalize() if kind == "name" else e) for _, _, kind, e, _ in found}
    given: dict[tuple[str, str], str] = {}
    used: set[tuple[str, str]] = set()
    out, at, spans = [], 0, []
    for a, b, kind, entity, detail in found:
        s = text[a:b]
        known = (kind, entity)
        if known not in given:
            step, limit = 0, len(own) + 64
            new = surrogate(kind, entity, detail, key, step)
            while ((kind, new) in own or (kind, new) in used) and step < limit:
                step += 1
                new = surrogate(kind, entity, detail, key, step)
            if (kind, new) in used or (kind, new) in own:  # more names than the pool holds: a number keeps them apart
                new = f"{new}-{'abcdefghijklmnopqrstuvwxyz'[len(used) % 26]}{len(used) // 26 or ''}"
            given[known] = new
            used.add((kind, new))
        new = given[known]
        if kind in ("phone", "card"):
            digits = sum(c.isdigit() for c in s)
            new = _fill(s, (detail if kind == "phone" else "") + new) if digits == len(new) + len(detail if kind == "phone" else "") else _fill(s, new)
        elif kind in ("iban", "national"):
            left = iter(new)
            new = "".join(next(left) if c.isalnum() else c for c in s)
        elif kind in ("email", "name"):
            new = _same_case(s, new) if kind == "email" or (len(s) > 1 and s.isupper()) else new
        out += [text[at:a], new]
        at = b
        spans.append({"kind": kind, "start": a, "end": b, "surrogate": new})
    return "".join([*out, text[at:]]), spans


def surrogates(docs: DataFrame, key: bytes = KEY, spans: str | None = "pii_spans") -> DataFrame:
    """docs with text replaced and, unless spans is None, a column of that name at the end: array of kind, start, end in the
    original text, surrogate. A column of docs that has this name is refused, as two could not be told apart."""
    if spans in docs.columns:
        raise ValueError(f"the documents have a column {spans}: give spans another name, or None")
    names, place = [f"c{i}" for i in range(len(docs.columns))], docs.columns.index("text")
    plain = docs.toDF(*names)
    found = "array<struct<kind: string, start: long, end: long, surrogate: string>>"
    schema = T.StructType([*plain.schema.fields, *docs.sparkSession.createDataFrame([], f"found {found}").schema.fields][: len(names) + (spans is not None)])

    def replaced(part):
        from pyspark.sql.pandas.types import to_arrow_type

        got = [(None, []) if t is None else replace(t, key) for t in part.column(place).to_pylist()]
        columns = list(part.columns)
        columns[place] = pa.array([t for t, _ in got], pa.string())
        if spans is not None:
            columns.append(pa.array([s for _, s in got], to_arrow_type(schema["found"].dataType)))
        return pa.RecordBatch.from_arrays(columns, schema.names)

    return map_slices(plain, schema, replaced, place).toDF(*docs.columns, *[spans] * (spans is not None))


def digest(found: DataFrame) -> DataFrame:
    count = lambda kind: F.size(F.filter("pii_spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
