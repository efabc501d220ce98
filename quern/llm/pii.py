"""Surrogates for personal data: keyed replacements of the same type, gender, script and format.

Detected are e-mail addresses, telephone numbers, IPv4 and IPv6 addresses, card numbers, account numbers (IBAN), social
security numbers, secrets and persons named with a title; their given names and surnames are then found wherever the
same text has them, also without the title. Replacements are keyed permutations: a Feistel network over the digits or
letters that the entity has, so that two different entities of a type cannot get the same surrogate anywhere in the
corpus, one entity gets the same one everywhere, and nothing is exchanged between rows. What must stay valid (Luhn
digit, IBAN check digits, octets, private networks) stays so by walking the permutation on until a valid value of the
same kind comes up, which is again a permutation. Separators, case and country codes stay; letter case and separators
do not make two entities of one. Names of the lists go to names of the same list, by gender and script; other names go
to names composed of consonants and vowels in turn, of a length that follows their own, which no list has. A surname
does not depend on gender, so that a person named with and without a given name keeps one; endings of Russian surnames
stay, as they show the gender. Names in other letters go letter by letter. Each document's surrogates are checked for
collisions, ``collisions`` checks all documents', and ``checked`` raises if there is one.

A null text stays null, with no entities; an empty text has none, and texts are read whole, however long. Repeated rows
get the same text. Where two patterns match at one place, the first of ``KINDS`` wins. An empty table gives no rows.
Columns with the names of results are replaced, others pass through.
"""

from __future__ import annotations

import hashlib
import ipaddress
import math
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import own_name, per_worker, structs, values

ROUNDS = 8

# Given names by script and gender.
GIVEN = {
    ("latin", "f"): "Anna Maria Mary Laura Julia Clara Emma Sofia Elena Marta Paula Lucia Carla Sara Eva Nora Lea Ida Ines Rosa Alice Helen Ruth Diana Jane Lisa Karin Petra Sylvie Claire Odile Carmen Pilar",
    ("latin", "m"): "John James Paul Peter Martin Thomas Robert David Daniel Simon Lucas Oscar Hugo Felix Victor Adrian Julian Samuel Henry George Frank Karl Otto Erik Pierre Alain Michel Luc Pablo Diego Jorge Carlos Mario Bruno",
    ("cyrillic", "f"): "Анна Мария Ольга Елена Ирина Татьяна Наталья Светлана Екатерина Юлия Вера Надежда Любовь Галина Дарья Полина",
    ("cyrillic", "m"): "Иван Пётр Сергей Андрей Алексей Дмитрий Михаил Николай Павел Виктор Борис Олег Игорь Юрий Роман Антон",
    ("greek", "f"): "Μαρία Ελένη Κατερίνα Σοφία Άννα Ιωάννα Δήμητρα Χριστίνα",
    ("greek", "m"): "Γιώργος Δημήτρης Κώστας Νίκος Γιάννης Παναγιώτης Βασίλης Μιχάλης",
}
# Surnames by script.
SURNAMES = {
    "latin": "Smith Jones Taylor Brown Wilson Evans Walker Clark Müller Schmidt Weber Wagner Becker Hoffmann Koch Richter Petit Bernard Dubois Moreau Laurent Girard Garcia Lopez Perez Sanchez Torres Ramos Rossi Jansen Novak Silva",
    "cyrillic": "Иванов Смирнов Кузнецов Попов Васильев Петров Соколов Михайлов Новиков Фёдоров Морозов Волков",
    "greek": "Παπαδόπουλος Οικονόμου Παππάς Νικολάου Γεωργίου Δημητρίου Αντωνίου Βλάχος",
}
# Titles before names, with the gender they show; endings of Russian surnames, those of women first.
TITLES = {
    "Mr": "m", "Mister": "m", "Sir": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Lady": "f", "Herr": "m", "Herrn": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Mme": "f", "Mlle": "f",
    "Señor": "m", "Señora": "f", "Señorita": "f", "Sra": "f", "Господин": "m", "Госпожа": "f", "Κύριος": "m", "Κυρία": "f", "Dr": "", "Prof": "", "Professor": "",
}
ENDINGS = {"ова": "ов", "ева": "ев", "ёва": "ёв", "ина": "ин", "ская": "ский", "ов": "ов", "ев": "ев", "ёв": "ёв", "ин": "ин", "ский": "ский"}
#: What ends a composed name: nothing that a consonant, a vowel and so on with this end spells is in a list.
TAILS = {
    "latin": {"given/f": "yne", "given/m": "or", "given/": "ey", "surname": "holt"},
    "cyrillic": {"given/f": "лия", "given/m": "слав", "given/": "ша", "surname": "енко"},
    "greek": {"given/f": "ινα", "given/m": "ιδης", "given/": "ης", "surname": "ακης"},
}
#: Letters of names and the consonants and vowels that others are composed of, by script.
LETTERS = {"latin": ("abcdefghijklmnopqrstuvwxyz", "bcdfghjklmnpqrstvwxz", "aeiouy"), "cyrillic": ("абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "бвгджзклмнпрстфхцчшщ", "аеиоуыэюя"), "greek": ("αβγδεζηθικλμνξοπρστυφχψως", "βγδζθκλμνξπρστφχψ", "αεηιουω")}
#: Alphabets of one case; a letter stays in its own.
ALPHABETS = ["abcdefghijklmnopqrstuvwxyz", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþßœ", "абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω", "άέήίόύώ"]
RANGES = [(0x3040, 0x30FF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0x0620, 0x064A), (0x05D0, 0x05EA), (0x0904, 0x0939), (0x0E01, 0x0E2E)]
KINDS = ("email", "secret", "iban", "card", "ipv4", "ipv6", "ssn", "phone", "person")

# \\s is not used: an entity stays in its line.
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_NAME = r"[^\W\d_][^\W\d_'’\-]*(?:['’\-][^\W\d_]+)*"
PATTERN = re.compile(
    "|".join(
        [
            r"(?P<email>(?<![\w.%+\-])[\w%+\-]+(?:\.[\w%+\-]+)*@(?:[\w\-]+\.)+[^\W\d_]{2,})",
            r"(?i:(?<![^\W_])(?:token|secret|password|passwd|pwd|api[_\-]?key|access[_\-]?key)[\"']?[ \t]{0,4}[=:][ \t]{0,4}[\"']?)(?P<secret>[A-Za-z0-9+/_\-]{8,}={0,2})",
            r"(?<![^\W_])(?P<bare>(?=[a-fA-F]*\d)(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![^\W_]))",
            r"(?P<iban>(?<![^\W_])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![^\W_]))",
            rf"(?P<ipv4>(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d))",
            r"(?P<ipv6>(?<![\w:.])(?=[a-f]{0,3}\d)[0-9A-Fa-f]{3,4}:(?:[0-9A-Fa-f]{0,4}:){1,6}[0-9A-Fa-f]{0,4}(?![\w:]))",
            r"(?P<ssn>(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-]))",
            r"(?P<card>(?<![\w+])\d(?:[ \-]?\d){12,18}(?!\d))",
            r"(?P<phone>(?<![\w+])\+\d{1,3}[ .\-]?(?:\(\d{1,5}\)[ .\-]?)?\d{1,5}(?:[ .\-]?\d{2,5}){1,5}(?!\d)|(?<![\w(])\(\d{2,5}\)[ .\-]?\d{3,5}[ .\-]\d{2,5}(?!\d)|(?<![\w.\-])\d{3}[.\-]\d{3}[.\-]\d{4}(?![\w\-])|(?<![\w.\-])(?<!\d )\d{3} \d{3} \d{4}(?![\w\-]| \d))",
            rf"(?<![^\W_])(?P<title>(?:(?:{'|'.join(sorted(TITLES, key=len, reverse=True))})\.?[ \xa0])+)(?P<person>(?:{_NAME}[ \xa0])?{_NAME})",
        ]
    )
)
SECRET_WORDS = ("token", "secret", "passw", "pwd", "api", "access")
SIGN = re.compile(r"[@\d]")
_DIGIT = re.compile(r"\d")


class Permutation:
    """Keyed permutations of the numbers below radix**n, one for each tweak."""

    def __init__(self, key: bytes) -> None:
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _draw(self, tweak: bytes, i: int, x: int) -> int:
        data = struct.pack("<I", i) + x.to_bytes((x.bit_length() + 7) // 8 or 1, "little") + b"/" + tweak
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=64).digest(), "little")

    def apply(self, tweak: str, x: int, a: int, b: int) -> int:
        """Of x below a * b; a and b are both sides' numbers of values."""
        left, right = divmod(x, b)
        t = f"{tweak}/{a}/{b}".encode()
        for i in range(0, ROUNDS, 2):
            left = (left + self._draw(t, i, right)) % a
            right = (right + self._draw(t, i + 1, left)) % b
        return left * b + right

    def mixed(self, tweak: str, places: list[int], radices: list[int]) -> list[int]:
        """Of a sequence whose i-th place has radices[i] values; both halves mix."""
        half = len(places) // 2
        if not places:
            return []

        def number(s: int, e: int) -> tuple[int, int]:
            x, size = 0, 1
            for p, r in zip(places[s:e], radices[s:e], strict=True):
                x, size = x * r + p, size * r
            return x, size

        (x, a), (y, b) = number(0, half), number(half, len(places))
        left, right = divmod(self.apply(f"{tweak}/{','.join(map(str, radices))}", x * b + y, a, b), b)
        out = []
        for v, s, e in ((right, half, len(places)), (left, 0, half)):
            for r in reversed(radices[s:e]):
                v, p = divmod(v, r)
                out.append(p)
        return out[::-1]


def _alphabet(c: str, hexadecimal: bool) -> tuple[str | range, int] | None:
    if hexadecimal:
        i = "0123456789abcdef".find(c)
        return ("0123456789abcdef", i) if i >= 0 else None
    if "0" <= c <= "9":
        return "0123456789", ord(c) - 48
    for a in ALPHABETS:
        i = a.find(c)
        if i >= 0:
            return a, i
    for lo, hi in RANGES:
        if lo <= ord(c) <= hi and c == c.lower():
            return range(lo, hi + 1), ord(c) - lo
    return None


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _iban_check(country: str, rest: str) -> str:
    number = "".join(str(int(c, 36)) for c in rest + country + "00")
    return f"{98 - int(number) % 97:02d}"


class Surrogates:
    """The replacements of one key."""

    def __init__(self, key: bytes) -> None:
        self.permute = Permutation(key)
        self.lists = {k: v.split() for k, v in GIVEN.items()}
        self.surnames = {k: v.split() for k, v in SURNAMES.items()}
        self.listed = {n.lower() for names in (*self.lists.values(), *self.surnames.values()) for n in names}
        self.known: dict[tuple[str, str], str] = {}

    def spell(self, tweak: str, text: str, hexadecimal: bool = False) -> str:
        """Letters and digits permuted place by place; case and everything else stays."""
        low = [c.lower() if len(c.lower()) == 1 else c for c in text]
        found = [(i, _alphabet(c, hexadecimal)) for i, c in enumerate(low)]
        found = [(i, x) for i, x in found if x]
        shape = "".join("a" if c.isalpha() else "0" if c.isdigit() else c for c in low)
        new = self.permute.mixed(f"{tweak}/{shape if not hexadecimal else len(shape)}", [p for _, (_, p) in found], [len(a) for _, (a, _) in found])
        out = list(text)
        for (i, (a, _)), p in zip(found, new, strict=True):
            c = chr(a[p]) if isinstance(a, range) else a[p]
            out[i] = c.upper() if text[i] != low[i] and len(c.upper()) == 1 else c
        return "".join(out)

    def _walk(self, step, start: str, ok) -> str:
        """The permutation again and again, until a value of the start's kind comes up."""
        x = step(start)
        while not ok(x):
            x = step(x)
        return x

    def digits(self, tweak: str, text: str, keep: int = 0, ok=lambda new, old: True) -> str:
        """The digits after the first ``keep`` permuted, written where the old ones stood."""
        old = "".join(_DIGIT.findall(text))
        new = self._walk(lambda s: s[:keep] + self.spell(tweak, s[keep:]), old, lambda s: ok(s, old))
        it = iter(new)
        return _DIGIT.sub(lambda _: next(it), text)

    def email(self, x: str) -> str:
        local, _, domain = x.rpartition("@")
        labels, _, top = domain.rpartition(".")
        return f"{self.spell('local', local)}@{'.'.join(self.spell('domain', p) for p in labels.split('.'))}.{top}"

    def secret(self, x: str) -> str:
        low = x.lower()
        whole = all(c in "0123456789abcdef" for c in low) and (x == low or x == x.upper())
        if not whole:
            return self.spell("secret", x)
        new = self.spell("secret/hex", low, hexadecimal=True)
        return new if x == low else new.upper()

    bare = secret

    def iban(self, x: str) -> str:
        country, rest = x[:2], re.sub(r"[ ]", "", x[4:])
        valid = _iban_check(country, rest) == x[2:4]
        new = self.spell(f"iban/{country}", rest)
        check = _iban_check(country, new) if valid else self.spell("check", x[2:4])
        it = iter(country + check + new)
        return "".join(next(it) if c != " " else c for c in x)

    def card(self, x: str) -> str:
        return self.digits("card", x, 1, lambda new, old: luhn(new) == luhn(old))

    def ssn(self, x: str) -> str:
        return self.digits("ssn", x)

    def phone(self, x: str) -> str:
        country = re.match(r"\+(\d{1,3})(?=[ .\-(])", x)
        return self.digits("phone" + (country[1] if country else ""), x, len(country[1]) if country else 0)

    def ipv4(self, x: str) -> str:
        kind = lambda n: next((p for p, size in ((0x0A000000, 24), (0xAC100000, 20), (0xC0A80000, 16), (0x7F000000, 24)) if n >> size == p >> size), 0)
        old = int.from_bytes(bytes(map(int, x.split("."))), "big")
        base = kind(old)
        bits = {0x0A000000: 24, 0xAC100000: 20, 0xC0A80000: 16, 0x7F000000: 24}.get(base, 32)
        mask, n = (1 << bits) - 1, old
        while True:
            n = n & ~mask | self.permute.apply(f"ip/{base}", n & mask, 1 << bits // 2, 1 << bits - bits // 2)
            if kind(n) == base:
                return ".".join(map(str, n.to_bytes(4, "big")))

    def ipv6(self, x: str) -> str:
        """Within its network, if that is one of a kind (local, unique local, multicast, for documentation)."""
        kind = lambda n: next((p for p in ((0xFE80 << 112, 118), (0xFC << 120, 121), (0xFF << 120, 120), (0x20010DB8 << 96, 96)) if n >> p[1] == p[0] >> p[1]), (0, 128))
        n = int(ipaddress.IPv6Address(x))
        held = kind(n)
        mask = (1 << held[1]) - 1
        while True:
            n = n & ~mask | self.permute.apply(f"ip6/{held[0]}", n & mask, 1 << held[1] // 2, 1 << held[1] - held[1] // 2)
            if kind(n) == held:
                new = ipaddress.IPv6Address(n)
                new = new.exploded if len(x) == 39 else new.compressed
                return new.upper() if x.isupper() else new

    def _listed(self, tweak: str, names: list[str], low: str) -> str | None:
        """A name of the list goes to the next in a keyed order."""
        places = [n.lower() for n in names]
        if low not in places:
            return None
        order = sorted(range(len(names)), key=lambda k: self.permute._draw(tweak.encode(), 0, k))
        return places[order[(order.index(places.index(low)) + 1) % len(names)]]

    def _composed(self, tweak: str, low: str, script: str) -> str:
        """Consonants and vowels in turn; longer names get longer ones, so that no two lengths meet."""
        letters, *sounds = LETTERS[script]
        x, size, length, room = 0, 1, 0, 1
        for c in low:
            x, size = x * len(letters) + letters.index(c), size * len(letters)
            while True:  # at least one more sound for one more letter
                room *= len(sounds[length % 2])
                length += 1
                if room >= size:
                    break
        a = math.prod(len(sounds[i % 2]) for i in range(length // 2))
        x, out = self.permute.apply(f"{tweak}/{script}/{len(low)}", x, a, room // a), []
        for i in range(length - 1, -1, -1):
            x, at = divmod(x, len(sounds[i % 2]))
            out.append(sounds[i % 2][at])
        return "".join(reversed(out))

    def _name(self, tweak: str, name: str, names: list[str], script: str) -> str:
        low = name.lower()
        ending = next((e for e in ENDINGS if low.endswith(e) and len(low) > len(e) + 1), "") if tweak == "surname" and script == "cyrillic" else ""
        stem = low.removesuffix(ending)
        new = self._listed(f"{tweak}/{script}", names, stem + ENDINGS.get(ending, ""))
        if new is not None:
            new = new.removesuffix(ENDINGS[ending]) + ending if ending and new.endswith(ENDINGS[ending]) else new + "а" * ending.endswith("а")
        elif all(c in LETTERS[script][0] for c in stem):
            after = TAILS[script][tweak] if not ending else "" if ending.startswith("ск") else "ск"
            new = self._composed(tweak, stem, script) + after + ending
        else:
            new = self._walk(lambda x: self.spell("name", x), low, lambda x: x not in self.listed)
        return new.upper() if name.isupper() and len(name) > 1 else new if name.islower() else new.title()

    def given(self, name: str, gender: str) -> str:
        """By gender; where the title shows none, the lists may."""
        script = _script(name)
        gender = gender or next((g for g in "fm" if name.lower() in [n.lower() for n in self.lists[script, g]]), "")
        names = self.lists[script, gender] if gender else []
        return "".join(self._name(f"given/{gender}", x, names, script) if x[:1].isalpha() else x for x in re.split(r"(['’\-])", name))

    def surname(self, name: str) -> str:
        script = _script(name)
        return "".join(self._name("surname", x, self.surnames[script], script) if x[:1].isalpha() else x for x in re.split(r"(['’\-])", name))

    def person(self, x: str, gender: str) -> str:
        parts = re.split(r"([ \xa0])", x)
        last = self.surname(parts[-1])
        return self.given(parts[0], gender) + parts[1] + last if len(parts) == 3 else last

    def of(self, kind: str, x: str, gender: str = "") -> str:
        held = self.known.get((kind + gender, x))
        if held is None:
            if len(self.known) > 100_000:
                self.known.clear()
            held = self.person(x, gender) if kind == "person" else getattr(self, kind)(x)
            self.known[kind + gender, x] = held
        return held


def _script(name: str) -> str:
    return next((s for s, lo, hi in (("cyrillic", 0x400, 0x52F), ("greek", 0x370, 0x3FF)) if lo <= ord(name[0]) <= hi), "latin")


def canonical(kind: str, x: str) -> str:
    """What makes two spellings one entity."""
    if kind in ("card", "phone", "ssn", "iban"):
        return re.sub(r"[^0-9A-Za-z+]", "", x)
    if kind == "ipv6":
        return ipaddress.IPv6Address(x).compressed
    return x.lower() if kind in ("email", "person") else x


def _may_hold(line: str) -> bool:
    """False only if no pattern can match: all need a digit, an @, a title or a word before a secret."""
    if SIGN.search(line) or any(t in line for t in TITLES):
        return True
    low = line.lower()
    return any(w in low for w in SECRET_WORDS)


def _matches(text: str) -> Iterator[tuple[re.Match, int]]:
    """No entity goes over a line's end, so only lines that may hold one are searched."""
    if not _may_hold(text):
        return
    start = 0
    while start <= len(text):
        end = text.find("\n", start)
        end = len(text) if end < 0 else end
        line = text[start:end]
        if _may_hold(line):
            for m in PATTERN.finditer(line):
                yield m, start
        start = end + 1


def detect(text: str) -> Iterator[tuple[str, int, int, str]]:
    """(kind, start, end, gender) of the entities that show themselves, in order; places are code points."""
    for m, line in _matches(text):
        kind = next(k for k in (*KINDS, "bare") if m[k] is not None)
        if kind == "person":
            first, _, rest = m["person"].replace("\xa0", " ").rpartition(" ")
            if not (first or rest)[0].isupper():
                continue
            end = m.end("person") if rest[:1].isupper() or not first else m.start("person") + len(first)
            shown = {TITLES[x] for x in re.split(r"[. \xa0]+", m["title"]) if x}
            yield kind, line + m.start("person"), line + end, next(iter(shown - {""}), "")
        elif kind != "ipv6" or _is_ipv6(m["ipv6"]):
            yield ("secret" if kind == "bare" else kind), line + m.start(kind), line + m.end(kind), ""


def _is_ipv6(x: str) -> bool:
    try:
        return bool(ipaddress.IPv6Address(x))
    except ValueError:
        return False


def _mentions(text: str, found: list[tuple[str, int, int, str]], surrogates: Surrogates) -> Iterator[tuple[str, int, int, str]]:
    """Places outside the entities found where a name of a titled person stands alone; (person, start, end, surrogate)."""
    new: dict[str, str] = {}
    for kind, s, e, gender in found:
        if kind == "person":
            *given, last = re.split(r"[ \xa0]", text[s:e])
            for x, y in [(last, surrogates.surname(last)), *((g, surrogates.given(g, gender)) for g in given)]:
                if len(x) > 1:
                    new.setdefault(x, y)
    if not new:
        return
    ends, at = [(s, e) for _, s, e, _ in found], 0
    for m in re.finditer(rf"(?<![\w'’\-@.])(?:{'|'.join(map(re.escape, sorted(new, key=len, reverse=True)))})(?![\w\-@])", text):
        while at < len(ends) and ends[at][1] <= m.start():
            at += 1
        if at == len(ends) or m.end() <= ends[at][0]:
            yield "person", m.start(), m.end(), new[m[0]]


def rewrite(text: str, surrogates: Surrogates) -> tuple[str, list[tuple[str, int, int, str, str]]]:
    """The text with surrogates, and (kind, start, end, old, new) of each entity; places are the old text's."""
    shown = list(detect(text))
    all_ = [(kind, s, e, surrogates.of(kind, text[s:e], gender)) for kind, s, e, gender in shown]
    all_ = sorted([*all_, *_mentions(text, shown, surrogates)], key=lambda x: x[1])
    out, found, at = [], [], 0
    for kind, s, e, new in all_:
        out += [text[at:s], new]
        found.append((kind, s, e, text[s:e], new))
        at = e
    return ("".join([*out, text[at:]]) if found else text), found


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("surrogate", pa.string())])
FIELDS = (("text_out", pa.string()), ("n_entities", pa.int64()), ("n_distinct", pa.int64()), ("n_collisions", pa.int64()), ("spans", pa.list_(SPAN)))


def _digest(text: str | None, surrogates: Surrogates) -> tuple:
    if text is None:
        return None, 0, 0, 0, []
    new, found = rewrite(text, surrogates)
    pairs = {(k, canonical(k, a), canonical(k, b)) for k, _, _, a, b in found}
    hit = len({(k, a) for k, a, _ in pairs}) - len({(k, b) for k, _, b in pairs})
    spans = [{"kind": k, "start": s, "end": e, "surrogate": b} for k, s, e, _, b in found]
    return new, len(found), len({(k, a) for k, a, _ in pairs}), abs(hit), spans


def pseudonymize(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """The rows with the text rewritten, and n_entities, n_distinct, n_collisions and spans."""

    @F.arrow_udf("text_out string, n_entities long, n_distinct long, n_collisions long, spans array<struct<kind:string,start:int,end:int,surrogate:string>>")
    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        s = per_worker(("pii", key), lambda: Surrogates(key))
        for part in values(batches):
            yield structs([_digest(x, s) for x in part], FIELDS)

    held = own_name(docs, "_pii")
    names = [n for n, _ in FIELDS[1:]]
    out = docs.withColumn(held, apply(F.col(text)))
    return out.withColumns({text: F.col(held)["text_out"], **{n: F.col(held)[n] for n in names}}).drop(held)


def collisions(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """Surrogates (kind, surrogate, n) that stand for more than one entity in all documents: none, if all is well.

    Entities leave their row as keyed hashes only. A surrogate is grouped with all its entities' hashes counted, in
    partial sums first, so that a frequent entity is one row for each task.
    """
    pair = pa.struct([(n, pa.string()) for n in ("kind", "entity", "surrogate")])

    @F.arrow_udf("array<struct<kind:string,entity:string,surrogate:string>>")
    def pairs(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        s = per_worker(("pii", key), lambda: Surrogates(key))
        hidden = lambda k, a: hashlib.blake2b(canonical(k, a).encode(), key=s.permute.key, digest_size=16).hexdigest()
        for part in values(batches):
            found = (rewrite(x or "", s)[1] for x in part)
            yield pa.array([[{"kind": k, "entity": hidden(k, a), "surrogate": canonical(k, b)} for k, _, _, a, b in x] for x in found], pa.list_(pair))

    each = docs.select(F.explode(pairs(F.col(text))).alias("x")).select("x.*").distinct()
    return each.groupBy("kind", "surrogate").agg(F.count("*").alias("n")).filter("n > 1")


def checked(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """``pseudonymize``, once no surrogate in all documents stands for two entities; else an error names one."""
    bad = collisions(docs, key, text).first()
    if bad is not None:
        raise ArithmeticError(f"the {bad['kind']} {bad['surrogate']!r} stands for {bad['n']} entities")
    return pseudonymize(docs, key, text)
