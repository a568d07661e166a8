"""Surrogates for personal data: each detected entity gets a keyed replacement of its own type, gender, script and format.

Entities are found in whole texts: e-mail addresses, IPv4 addresses, phone numbers, payment card numbers, IBANs, US social
security numbers, and names of people after a title or a phrase that introduces one, with all further whole-word
occurrences of the same name, or of its family name, in that text. Names may be in any script, numbers in any decimal
digits. A surrogate keeps what can be seen of the format: separators, lengths, digits' and letters' script, upper and lower
case, an address's reserved domain, and the gender of a given name, as a title tells it or else the name's own form.

The same entity, written in any of its forms, gets the same surrogate in every document (coreference); different entities
get different ones (distinctness). A name of several words is given names and a family name; a family name, alone after a
title or as the end of a longer name, has one surrogate everywhere, so `Mr Smith` and `John Smith` stay of one name. A full
name that has no title in one place and in another always the title of one gender is one person; with titles of both
genders, those are different people, and the name without a title is a third.

For this the whole corpus is surveyed first: every different entity has a first candidate from the key and its own canonical
form; entities of a type whose candidates collide with each other, or with an entity that really occurs, move on to their
next candidates, round by round, until no collision is left. Only the entities that had to move are listed; all others'
surrogates follow from the key alone, so texts need not be shuffled. The list is sent to the executors while it is short
(LISTED at most, counted first); a longer one is joined to the documents that need it.

Defined results:
- text null: null, no entities; empty or without entities: unchanged
- overlapping finds: the earlier, then the longer, then the type listed first
- numbers like IBANs count as such if their check digits are right or the word IBAN stands before them
- after MOST_ROUNDS collisions in a row, which only a type of fixed length comes to whose forms are used up, an entity is
  written as its type and a keyed digest: distinct and consistent, without the format
- repeated rows and null ids: each row is rewritten on its text alone, equal texts equally
- a text of any length is one row, held by one task; an empty table: no rows
- columns of the input named like an output column are replaced; the text column holds the new text; all others are
  carried along, whatever their names
"""

from __future__ import annotations

import bisect
import hashlib
import hmac
import re
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import SLICE, append_columns, cut, fresh, look_up

#: Moved entities that are sent to every executor; beyond it they are joined.
LISTED = 50_000
MOST_ROUNDS = 40

# Patterns by type, in order of precedence.
PATTERNS = {
    "email": re.compile(r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    "iban": re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
    "card": re.compile(r"(?<![\d.-])(?:\d{4}[ -]?){3}\d{4}(?![\d-]|\.\d)|(?<![\d.-])3[47]\d{2}[ -]?\d{6}[ -]?\d{5}(?![\d-]|\.\d)"),
    "phone": re.compile(r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?![\w-])|(?<!\w)\(\d{3}\) ?\d{3}[ .-]\d{4}(?![\w-])|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])"),
    "ssn": re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    "ip": re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\w]|\.\d)"),
}
#: Vowel signs and other marks are parts of words though `\\w` leaves them out.
MARKS = "".join(re.escape(c) for c in map(chr, range(0x300, 0x1200)) if unicodedata.category(c)[0] == "M")
WORD = rf"(?:[^\W\d_][{MARKS}]*)+(?:['’-](?:[^\W\d_][{MARKS}]*)+)*"
# Titles by gender, phrases that introduce a name, and words inside names that are not names.
FEMALE = frozenset("Mrs Ms Miss Frau Madame Mme Señora Sra Signora Госпожа госпожа г-жа Κυρία κυρία السيدة גברת".split())
MALE = frozenset("Mr Herr Monsieur Señor Sr Signor Господин господин г-н Κύριος κύριος السيد מר".split())
NEUTRAL = ("Dr", "Prof")
INTRODUCED = ("[Mm]y name is", "[Ii]ch heiße", "[Jj]e m'appelle", "[Mm]e llamo", "[Мм]еня зовут", "[Μμ]ε λένε", "اسمي", "שמי", "我叫")
TITLES = FEMALE | MALE | frozenset(NEUTRAL)
PARTICLES = frozenset("van von de del della di da dos la le der den ter bin ben al el".split())
NAME = re.compile(rf"(?:\b(?P<title>{'|'.join(sorted(TITLES, key=lambda t: (-len(t), t)))})\b\.?|\b(?:{'|'.join(INTRODUCED)})) ?(?P<name>(?:(?:{'|'.join(sorted(PARTICLES))}) ){{0,2}}{WORD}(?: (?:(?:{'|'.join(sorted(PARTICLES))}) ){{0,2}}{WORD}){{0,2}})")
TYPES = (*PATTERNS, "name", "family")
# Given names by script and gender, and syllables that family names are put together from.
GIVEN = {
    "latin": {
        "f": "Alma Berta Carla Dora Edith Flora Greta Hanna Irma Julia Klara Lena Marta Nora Olga Paula Rosa Silvia Thea Vera".split(),
        "m": "Anton Bruno Carlos David Emil Felix Georg Hugo Ivan Jakob Karl Leon Martin Nils Oskar Paul Robert Simon Tomas Viktor".split(),
        "n": "Alex Andrea Chris Dana Eden Gabriel Jamie Jordan Kim Lee Mika Nikola Quinn Robin Sam Sascha Sidney Toni Val Yuri".split(),
    },
    "cyrillic": {"f": "Анна Вера Галина Дарья Елена Зоя Ирина Лидия Мария Нина Ольга Раиса Софья Тамара Юлия".split(), "m": "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Максим Олег Павел Роман Семён Тимур Юрий".split(), "n": "Валя Женя Саша Слава Тоня Шура".split()},
    "greek": {"f": "Άννα Βασιλική Δήμητρα Ελένη Ζωή Ιωάννα Κατερίνα Μαρία Νίκη Σοφία".split(), "m": "Ανδρέας Βασίλης Γιώργος Δημήτρης Κώστας Λευτέρης Νίκος Πέτρος Σπύρος Χρήστος".split(), "n": "Άρτεμις Φοίβη Ορέστης Αλέξης".split()},
    "arabic": {"f": "أمينة خديجة زينب سعاد عائشة فاطمة ليلى مريم نادية هدى".split(), "m": "أحمد إبراهيم حسن خالد سامي طارق عمر كريم محمود يوسف".split(), "n": "نور رضا وسام صباح".split()},
    "hebrew": {"f": "אסתר דינה חנה לאה מרים נעמי רות רחל שרה תמר".split(), "m": "אברהם דוד חיים יוסף יעקב משה נתן עמוס שמואל תומר".split(), "n": "טל נועם עדי שי".split()},
}
# Given names that end as the other gender's do.
ENDS_OTHERWISE = {"luca": "m", "nikita": "m", "joshua": "m", "elia": "m", "ezra": "m", "andrea": "n", "mika": "n", "sasha": "n", "sascha": "n", "dana": "n", "nikola": "n", "никита": "m", "илья": "m", "лука": "m", "фома": "m", "саша": "n", "женя": "n", "валя": "n"}
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ha ka ke ko la le lo ma me mo na ne no pa pe ra re ro sa so ta te to va ve za".split(),
    "cyrillic": "ба бо ва во га го да до за ка ко ла ло ма мо на но па по ра ро са со та то фа ха ша".split(),
    "greek": "βα γα δα θα κα λα μα να πα ρα σα τα φα χα βο γο δο κο λο μο νο πο ρο σο το".split(),
    "arabic": "با بو دا دي را رو زا سا سو صا طا عا فا قا كا لا لو ما مو نا نو ها يا".split(),
    "hebrew": "בא בו גא דא דו זא חא טא יא כא לא לו מא מו נא נו סא פא רא רו שא תא".split(),
}
# Characters of Chinese family names and of given names.
HAN_FAMILY, HAN_GIVEN = "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧程曹袁邓许傅沈曾彭吕", "伟芳娜敏静丽强磊军洋勇艳杰涛明超秀霞平刚桂英华玉兰红文斌宇浩然欣怡思雨晨佳琪梓轩"
RESERVED = re.compile(r"(?:^|\.)(?:example\.(?:com|org|net)|test|example|invalid|localhost)$", re.IGNORECASE)


def luhn(digits: str) -> int:
    """The sum that is a multiple of ten for a valid card number."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total


@dataclass(frozen=True)
class Entity:
    start: int
    end: int
    kind: str
    text: str
    canonical: str


def plain_digits(text: str) -> str:
    """Decimal digits of any script as ASCII."""
    return text if text.isascii() else "".join(str(unicodedata.decimal(c)) if c.isdecimal() else c for c in text)


def canonical(kind: str, text: str) -> str:
    """The form that all ways of writing an entity share."""
    if kind == "email":
        return text.lower()
    if kind in ("card", "ssn", "iban"):
        return re.sub(r"[ -]", "", plain_digits(text))
    if kind == "phone":
        return "".join(c for c in plain_digits(text) if c.isdigit())
    if kind in ("name", "family"):
        return " ".join(text.split()).casefold()
    return plain_digits(text)


def caseless(c: str) -> bool:
    return c.upper() == c.lower()


def name_words(text: str) -> list[str]:
    return [w for w in text.split(" ") if w not in PARTICLES]


def name_at(m: re.Match) -> int | None:
    """Where the name that a match holds ends, or None. Its words start with capitals, or with letters of a script without
    case, of which two count at most: in such scripts the next word looks the same. Han and Hangul names have four letters at
    most, three where more follow."""
    held, end = m["name"], m.start("name")
    first = name_words(held)[0] if name_words(held) else ""
    if not first or first in TITLES or not (first[0].isupper() or caseless(first[0])):
        return None
    if script_of(first) in ("han", "hangul"):
        return end + held.index(first) + (len(first) if len(first) <= 4 else 3)
    at, n, last = 0, 0, None
    for word in held.split(" "):
        if word not in PARTICLES:
            if not (caseless(word[0]) if caseless(first[0]) else word[0].isupper()) or n == (2 if caseless(first[0]) else 3):
                break
            n, last = n + 1, at + len(word)
        at += len(word) + 1
    return end + last


def iban_valid(text: str) -> bool:
    plain = canonical("iban", text)
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


DECIMAL = re.compile(r"\d")


def detect(text: str | None) -> list[Entity]:
    """The entities of a text, by position, none overlapping another."""
    if not text:
        return []
    found = []
    digits = any(d in text for d in "0123456789") or not text.isascii() and DECIMAL.search(text) is not None
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        if "@" not in text if kind == "email" else not digits:
            continue
        for m in pattern.finditer(text):
            start, end = m.span()
            if kind != "iban" or iban_valid(m[0]) or "IBAN" in text[max(0, start - 12) : start].upper():
                found.append((start, start - end, rank, kind, None))
    m = NAME.search(text)
    while m:
        start, end = m.start("name"), name_at(m)
        # a title and a name stand apart, but for scripts that write no spaces
        if end is not None and (text[start - 1].isspace() or script_of(m["name"]) == "han"):
            while text[start:end].split(" ")[0] in PARTICLES:
                start = text.index(" ", start) + 1
            found.append((start, start - end, len(PATTERNS), "name", m["title"]))
        m = NAME.search(text, m.start("name") if end is None else end)
    entities, last = [], -1
    for start, size, _, kind, title in sorted(found, key=lambda x: x[:3]):
        if start >= last:
            last = start - size
            held = text[start:last]
            if kind == "name":
                entities.append(person(start, held, "f" if title in FEMALE else "m" if title in MALE else "n"))
            else:
                entities.append(Entity(start, last, kind, held, canonical(kind, held)))
    return sorted(entities + mentions(text, entities), key=lambda e: e.start)


def person(start: int, held: str, gender: str) -> Entity:
    """A name of several words with its gender, or a family name alone."""
    several = len(name_words(held)) > 1
    return Entity(start, start + len(held), "name" if several else "family", held, (f"{gender}:" if several else "") + canonical("name", held))


def family_of(name: str) -> str:
    return name.rpartition(" ")[2]


def mentions(text: str, entities: list[Entity]) -> list[Entity]:
    """Further whole-word occurrences of the names found in a text and of their family names, longer ones first, none
    overlapping an entity.

    Where the text has the full name with one gender only, they are that person; else they are the name without a title.
    """
    persons: dict[str, set[str]] = {}
    forms = set()
    for e in entities:
        if e.kind in ("name", "family"):
            forms |= {e.text, family_of(e.text)}
            if e.kind == "name":
                persons.setdefault(e.canonical[2:], set()).add(e.canonical)
    if not forms:
        return []
    taken = sorted((e.start, e.end) for e in entities)
    starts = [start for start, _ in taken]
    pattern = re.compile(rf"(?<!\w)(?:{'|'.join(re.escape(x) for x in sorted(forms, key=lambda x: (-len(x), x)))})(?!\w)", re.IGNORECASE)
    found = []
    for m in pattern.finditer(text):
        at = bisect.bisect_left(starts, m.end())
        if not (m[0][0].isupper() or caseless(m[0][0])) or at and taken[at - 1][1] > m.start():
            continue
        bare = canonical("name", m[0])
        if len(name_words(m[0])) > 1:
            held = persons.get(bare, set())
            found.append(Entity(m.start(), m.end(), "name", m[0], next(iter(held)) if len(held) == 1 else f"n:{bare}"))
        else:
            found.append(Entity(m.start(), m.end(), "family", m[0], bare))
    return found


class Stream:
    """Numbers that follow from the key, the type, the entity and the attempt."""

    def __init__(self, key: bytes, kind: str, entity: str, attempt: int):
        self.seed, self.block, self.rest = f"{kind}\x00{entity}\x00{attempt}".encode(), 0, 0
        self.key, self.size = key, 1

    def below(self, n: int) -> int:
        if self.size < n << 32:
            digest = hmac.new(self.key, self.seed + self.block.to_bytes(4, "big"), hashlib.sha256).digest()
            self.block, self.rest, self.size = self.block + 1, int.from_bytes(digest, "big"), 1 << 256
        self.rest, x = divmod(self.rest, n)
        self.size //= n
        return x

    def pick(self, items):
        return items[self.below(len(items))]


@cache
def script_of_letter(c: str) -> str:
    name = unicodedata.name(c, "other").split(" ")[0].lower()
    return "han" if name == "cjk" else name


def script_of(text: str) -> str:
    return next((script_of_letter(c) for c in text if c.isalpha()), "other")


@cache
def letters_like(c: str) -> str:
    """The letters beside c in its script that have its category."""
    low = ord(c) & ~127
    return "".join(x for x in map(chr, range(low, min(low + 128, sys.maxunicode))) if unicodedata.category(x) == unicodedata.category(c) and script_of_letter(x) == script_of_letter(c)) or c


def gender_of(given: str) -> str:
    """What a given name's own form tells of its bearer's gender: f, m or n."""
    word, script = given.casefold(), script_of(given)
    if word in ENDS_OTHERWISE:
        return ENDS_OTHERWISE[word]
    known = [g for g in "fm" for name in GIVEN.get(script, {}).get(g, ()) if name.casefold() == word]
    if known:
        return known[0]
    if script == "latin":
        return "f" if word.endswith("a") else "n"
    if script == "cyrillic":
        return "f" if word[-1] in "ая" else "m"
    if script == "greek":
        return "m" if word[-1] in "ςσ" else "f" if word[-1] in "αηάή" else "n"
    return "f" if word[-1] == "ة" else "n"


def drawn_word(word: str, stream: Stream, longer: int) -> str:
    """A made-up family name in the script of word."""
    script = script_of(word)
    if script == "han":
        return stream.pick(HAN_FAMILY) + "".join(stream.pick(HAN_GIVEN) for _ in range(max(1, len(word) - 1) + longer))
    if script in SYLLABLES:
        stem = "".join(stream.pick(SYLLABLES[script]) for _ in range(3 + stream.below(2) + longer))
        if script == "cyrillic":  # such family names have the gender in their ends
            stem += "ова" if word[-1] in "ая" else "ов"
        return stem.capitalize()
    return "".join(stream.pick(letters_like(next(c for c in word if c.isalpha()))) for _ in range(max(3, len(word)) + longer))


def redrawn(text: str, stream: Stream, keep: int = 0) -> str:
    """Digits for digits and letters for letters of the same case; the first keep characters and all others stay."""
    out = list(text)
    for i in range(keep, len(out)):
        c = out[i]
        if c.isdigit():
            out[i] = str(stream.below(10))
        elif c.isascii() and c.isalpha():
            drawn = chr(97 + stream.below(26))
            out[i] = drawn.upper() if c.isupper() else drawn
    return "".join(out)


def surrogate(key: bytes, kind: str, entity: str, attempt: int = 0) -> str:
    """The canonical surrogate of a canonical entity."""
    stream = Stream(key, kind, entity, attempt)
    if attempt < 0:
        return f"{kind}-{hmac.new(key, stream.seed, hashlib.sha256).hexdigest()[:32]}"
    longer = attempt // 2  # where short forms are used up, longer ones are free
    if kind == "email":
        local, _, domain = entity.rpartition("@")
        return redrawn(local + longer * "x", stream) + "@" + (domain if RESERVED.search(domain) else redrawn(domain.rpartition(".")[0], stream) + ".example")
    if kind == "ip":
        parts = [int(x) for x in entity.split(".")]
        if parts[0] in (10, 127):  # private and loopback addresses stay so
            return ".".join([str(parts[0])] + [str(stream.below(256)) for _ in parts[1:]])
        first = 1 + stream.below(223)
        return ".".join([str(11 if first in (10, 127) else first)] + [str(stream.below(256)) for _ in parts[1:]])
    if kind == "card":
        drawn = redrawn(entity, stream, 1)
        if luhn(entity) % 10 == 0:  # a valid number stays valid
            drawn = next(x for x in (drawn[:-1] + str(d) for d in range(10)) if luhn(x) % 10 == 0)
        return drawn
    if kind == "iban":
        body = redrawn(entity[4:], stream)
        moved = "".join(str(int(c, 36)) for c in body + entity[:2] + "00")
        return entity[:2] + f"{98 - int(moved) % 97:02d}" + body
    if kind == "phone":
        return entity[: max(0, len(entity) - 10)] + "".join(str(stream.below(10)) if i else str(2 + stream.below(8)) for i in range(min(10, len(entity))))
    if kind == "name":  # the given names; the family name has a surrogate of its own
        gender, _, name = entity.partition(":")
        *given, _ = name_words(name)
        gender = gender if gender != "n" else gender_of(given[0])
        drawn = []
        for word in given:
            names = GIVEN.get(script_of(word))
            drawn.append("-".join(stream.pick(names[gender]) for _ in range(1 + longer)) if names else drawn_word(word, stream, longer))
        return " ".join(drawn)
    if kind == "family":
        return drawn_word(entity, stream, longer)
    return redrawn(entity, stream)


def in_digits_of(like: str, plain: str) -> str:
    """plain with its ASCII digits in the script of the first digit of like."""
    first = next((c for c in like if c.isdecimal()), "0")
    zero = ord(first) - unicodedata.decimal(first)
    return plain if zero == 48 else "".join(chr(zero + int(c)) if "0" <= c <= "9" else c for c in plain)


def formatted(kind: str, like: str, plain: str) -> str:
    """A canonical surrogate written in the way that the entity is written."""
    if kind in ("card", "ssn", "iban", "phone"):
        drawn = iter(in_digits_of(like, plain))
        return "".join(next(drawn) if c.isalnum() else c for c in like)
    if kind == "ip":
        return in_digits_of(like, plain)
    if kind == "email":
        return plain.upper() if like.isupper() else plain
    if kind == "family":
        return plain.upper() if like.isupper() and len(like) > 1 else plain
    return plain


Moved = dict[tuple[str, str], tuple[str, int]]


def replacement(e: Entity, key: bytes, moved: Moved) -> str:
    """What stands for an entity."""
    target, attempt = moved.get((e.kind, e.canonical), (e.canonical, 0))
    plain = surrogate(key, e.kind, target, attempt)
    if e.kind != "name":
        return plain if attempt < 0 else formatted(e.kind, e.text, plain)
    # the words of the name one for one, what is between them as it is
    given, drawn, words = name_words(e.text)[:-1], iter(plain.split(" ")), e.text.split(" ")
    family = Entity(0, 0, "family", words[-1], family_of(e.canonical))
    out = [w if w in PARTICLES or i == len(words) - 1 else next(drawn, "") for i, w in enumerate(words)]
    out[:-1] = [w.upper() if given and given[0].isupper() and len(given[0]) > 1 and w not in PARTICLES else w for w in out[:-1]]
    return " ".join([*out[:-1], replacement(family, key, moved)])


def keys_of(found: list[Entity]) -> set[tuple[str, str]]:
    """(kind, entity) of all that may have moved: a full name counts with its family name."""
    return {(e.kind, e.canonical) for e in found} | {("family", family_of(e.canonical)) for e in found if e.kind == "name"}


def entities_of(docs: DataFrame, text_col: str, key: bytes) -> DataFrame:
    """(kind, entity), one row for each different entity of the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                pairs = {pair for text in batch.slice(at, SLICE).column(0).to_pylist() for pair in keys_of(detect(text))}
                yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.string()) for i in (0, 1)], names=["kind", "entity"])

    return docs.select(F.col(f"`{text_col}`")).mapInArrow(run, "kind string, entity string").distinct()


def shown(kind: str, entity: str, plain: str) -> str:
    """What two surrogates must not share: a name's gender is not seen in the name itself, and of full names, as different
    family names have different surrogates, only those of one family name can be alike."""
    return f"{plain.casefold()} {family_of(entity)}" if kind == "name" else plain.casefold() if kind in ("family", "email") else plain


def with_surrogate(entities: DataFrame, key: bytes) -> DataFrame:
    def make():
        return lambda kinds, names, attempts: ([shown(k, e, surrogate(key, k, e, a)) for k, e, a in zip(kinds, names, attempts, strict=True)],)

    return append_columns(entities, ["kind", "entity", "attempt"], [("drawn", "string")], make, ["kind", "entity", "attempt"])


def untitled_names(entities: DataFrame) -> DataFrame:
    """(kind, entity, target): names met without a title of a gender, where titles of just one gender occur with them."""
    gender, bare = F.expr("substring(entity, 1, 1)"), F.expr("substring(entity, 3)")
    # three rows for a name at most
    names = entities.filter("kind = 'name'").groupBy("kind", bare.alias("bare")).agg(F.sort_array(F.collect_set(gender)).alias("g"))
    met = names.filter((F.size("g") == 2) & F.array_contains("g", "n"))
    return met.select("kind", F.concat(F.lit("n:"), "bare").alias("entity"), F.concat(F.array_min(F.array_remove("g", "n")), F.lit(":"), "bare").alias("target"))


def moved_entities(docs: DataFrame, text_col: str, key: bytes) -> DataFrame:
    """(kind, entity, target, attempt) of the entities that do not get the first candidate of their own.

    target is the entity that entity is another form of (untitled_names), or entity itself; attempt is that of the
    candidate that target keeps.
    """
    found = cut(entities_of(docs, text_col, key))
    forms = cut(untitled_names(found))
    moved = moved_candidates(found.join(forms, ["kind", "entity"], "left_anti"), key)
    own = moved.select("kind", "entity", F.col("entity").alias("target"), "attempt")
    same = forms.join(moved.select("kind", F.col("entity").alias("target"), "attempt"), ["kind", "target"], "left")
    return cut(own.unionByName(same.select("kind", "entity", "target", F.coalesce("attempt", F.lit(0)).alias("attempt"))))


def moved_candidates(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, entity, attempt) of the entities whose first candidate is taken; attempt is that of the one they keep.

    A candidate is kept by the entity with the smallest hash among those that draw it, unless it is the canonical form of
    an entity that occurs or was kept in an earlier round.
    """
    every = cut(entities.withColumn("attempt", F.lit(0)))
    real = every.select("kind", F.when(F.col("kind") == "name", F.expr("substring(entity, 3)")).otherwise(F.col("entity")).alias("drawn")).distinct()
    order = Window.partitionBy("kind", "drawn").orderBy(F.xxhash64("entity"), "entity")
    waiting, taken, moved = every, real, None
    for round_ in range(MOST_ROUNDS):
        drawn = cut(with_surrogate(waiting, key))
        free = drawn.join(taken, ["kind", "drawn"], "left_anti").withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")
        lost = cut(drawn.join(free.select("kind", "entity"), ["kind", "entity"], "left_anti").select("kind", "entity", (F.col("attempt") + 1).alias("attempt")))
        if round_:
            free = cut(free)
            kept = free.select("kind", "entity", "attempt")
            moved = kept if moved is None else moved.unionByName(kept)
        if lost.isEmpty():
            return cut(moved) if moved is not None else every.limit(0)
        taken, waiting = cut(taken.unionByName(free.select("kind", "drawn"))), lost
    # the forms of these are used up
    rest = lost.withColumn("attempt", F.lit(-1))
    return cut(rest if moved is None else moved.unionByName(rest))


def rewrite(text: str | None, key: bytes, moved: Moved) -> tuple[str | None, list[Entity]]:
    found = detect(text)
    if not found:
        return text, found
    out, at = [], 0
    for e in found:
        out += [text[at : e.start], replacement(e, key, moved)]
        at = e.end
    return "".join([*out, text[at:]]), found


def replace(docs: DataFrame, key: bytes, text_col: str = "text", listed: int = LISTED, keep: list[str] | None = None) -> DataFrame:
    """Replace the text column, add n_entities and entities (type:start:end in the old text, comma-joined)."""
    moved = moved_entities(docs, text_col, key)
    carried = docs.columns if keep is None else keep
    outputs = [(text_col, "string"), ("n_entities", "long"), ("entities", "string")]

    def result(found):
        return [t for t, _ in found], [len(e) for _, e in found], [",".join(f"{x.kind}:{x.start}:{x.end}" for x in e) for _, e in found]

    if moved.count() <= listed:
        # listed rows at most
        shared = docs.sparkSession.sparkContext.broadcast({(r["kind"], r["entity"]): (r["target"], r["attempt"]) for r in moved.collect()})

        def make():
            return lambda texts: result([rewrite(t, key, shared.value) for t in texts])

        out = append_columns(docs, [text_col], outputs, make, carried)
    else:

        def make_joined():
            def own_list(rows):
                return {(k, e): (t, int(a)) for k, e, t, a in (x.split("\x00") for x in rows or [])}

            return lambda texts, held: result([rewrite(text, key, own_list(own)) for text, own in zip(texts, held, strict=True)])

        text, own = fresh([*carried, text_col, "n_entities", "entities"], "_text", "_moved")
        out = append_columns(with_moved(docs, text_col, moved, carried, text, own), [text, own], outputs, make_joined, carried)
    names = {name.lower() for name, _ in outputs}
    place = {c.lower(): c for c in out.columns}
    # the text where it was, the other outputs at the end
    kept = [text_col if c.lower() == text_col.lower() else place[c.lower()] for c in carried if c.lower() not in names or c.lower() == text_col.lower()]
    return out.select(*[F.col(f"`{c}`") for c in [*kept, *[c for c, _ in outputs if c not in kept]]])


def with_moved(docs: DataFrame, text_col: str, moved: DataFrame, carried: list[str], text: str, own: str) -> DataFrame:
    """The carried columns, the text and the moved entities in it: each different text meets its own by the text's hash."""
    digest = F.sha2(F.col(f"`{text_col}`"), 256)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                rows = {(h, *pair) for h, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for pair in keys_of(detect(text))}
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=["hash", "kind", "entity"])

    met = cut(docs.select(digest.alias("hash"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "hash string, kind string, entity string"))
    sized = moved.join(met.groupBy("kind", "entity").agg(F.count(F.lit(1)).alias("n")), ["kind", "entity"])
    listed = look_up(met, sized, ["kind", "entity"], "n").groupBy("hash").agg(F.collect_set(F.concat_ws("\x00", "kind", "entity", "target", F.col("attempt").cast("string"))).alias(own), F.count(F.lit(1)).alias("n"))
    (print_,) = fresh([*carried, text, own], "_print")
    rows = docs.select(*[F.col(f"`{c}`") for c in carried], F.col(f"`{text_col}`").alias(text), digest.alias(print_))
    listed = listed.withColumnRenamed("hash", print_)
    some = look_up(rows.filter(F.col(text).isNotNull()), listed, [print_], "n", "left")
    return some.unionByName(rows.filter(F.col(text).isNull()).withColumn(own, F.lit(None).cast("array<string>"))).drop(print_)
