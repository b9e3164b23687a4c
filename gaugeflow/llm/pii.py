"""Surrogates for personal data: keyed, type-consistent replacements.

Every detected entity is replaced by a value of its own kind and form, computed from a secret key, so
that the same entity gets the same surrogate in all texts and nobody without the key can tell which.

* Structured values (mail and network addresses, phone, card and account numbers, secrets) are permuted
  within their format by a keyed cipher on that format: length, separators, letter case, check digit,
  country code and address range stay. A permutation keeps different values different.
* Names get names of the same gender and script, built from syllables; given names and surnames are
  entities of their own, so "Mrs Smith" and "Anna Smith" keep their common part. A surname is one entity
  whatever the gender of its mentions; where its ending tells a gender, it is that of a mention which has
  one. Later bare mentions of the names of a text are replaced too. Initials stay as they are.
* Spark gathers the different entities of the corpus and checks their surrogates: one that two entities
  share, or that is itself a real value, is drawn again for all but one. The few entities whose draw is
  not the first are exceptions that the replacing pass looks up: in memory while they are few, else by a
  join on the texts that hold them.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeflow.llm.common import BROADCAST_ROWS, pick, pieces, stored

# Draws after which an entity that still clashes is an error.
MOST_DRAWS = 50

# Titles by gender (f, m, or n for either) and common given names.
TITLES = {
    "Mr": "m", "Mister": "m", "Sir": "m", "Herr": "m", "Herrn": "m", "Monsieur": "m", "Señor": "m", "Sr": "m",
    "Mrs": "f", "Ms": "f", "Miss": "f", "Madam": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Mademoiselle": "f",
    "Señora": "f", "Sra": "f", "Señorita": "f", "Dr": "n", "Prof": "n", "Professor": "n", "Doctor": "n",
    "Господин": "m", "Госпожа": "f", "Κύριος": "m", "Κυρία": "f",
}
GIVEN = {
    "f": """Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Emily Anna Alice Maria
        Laura Julia Sophie Claire Camille Ingrid Greta Heike Ursula Carmen Lucía Elena Isabel Marta
        Анна Мария Елена Ольга Наталья Ирина Татьяна Μαρία Ελένη Σοφία""".split(),
    "m": """James John Robert Michael William David Richard Joseph Thomas Charles Peter Paul Daniel George
        Hans Klaus Jürgen Stefan Pierre Jean Michel Antoine Carlos José Juan Miguel Pablo Diego
        Иван Сергей Алексей Дмитрий Андрей Михаил Николай Γιώργος Νίκος Κώστας""".split(),
}
_GENDER = {name: gender for gender, names in GIVEN.items() for name in names}
# Syllables that names are built from, and their ends: given names by gender, then surnames by gender.
SCRIPTS = {
    "latin": {
        "syllables": "ba be bri ca cel da del di do fa fe ga gre ha hel ja jo ka kel la le li ma mel mi na ne no "
                     "pa pe ra re ri ro sa se sel ta te ti to va vel vi za".split(),
        "given": {"f": ("na", "lla", "ra", "ssa"), "m": ("n", "rt", "s", "ld"), "n": ("l", "m", "x", "r")},
        "surname": {g: ("son", "berg", "ley", "ton", "mann", "field", "well", "ford") for g in "fmn"},
    },
    "cyrillic": {
        "syllables": "ба бе ва ве га да де жа за зе ка ла ле ли ма ме ми на не ни па ра ре ри са се та те ти то фа ша".split(),
        "given": {"f": ("на", "ля", "са", "ра"), "m": ("н", "р", "с", "л"), "n": ("й", "нь", "ша", "ка")},
        "surname": {"f": ("нова", "лева", "рина", "това"), "m": ("нов", "лев", "рин", "тов"),
                    "n": ("енко", "ко", "ян", "ич")},
    },
    "greek": {
        "syllables": "βα βε γα δα δε ζα θα θε κα κε λα λε μα με να νε πα πε ρα ρε σα σε τα τε φα χα".split(),
        "given": {"f": ("νη", "ρα", "λα", "σα"), "m": ("νος", "ρης", "λης", "σος"), "n": ("ρι", "νι", "λι", "τι")},
        "surname": {"f": ("πούλου", "ίδου", "άκη", "ού"), "m": ("πουλος", "ίδης", "άκης", "ός"),
                    "n": ("έας", "ίας", "ώς", "άς")},
    },
}

_EMAIL = re.compile(r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+")
_IP = re.compile(r"\d{1,3}(?:\.\d{1,3}){3}(?![\w.]*\d)")
_CARD = re.compile(r"(?:\d{4}([ \-])\d{4}\1\d{4}\1\d{4}|\d{4}([ \-])\d{6}\2\d{5}|\d{13,19})(?![\d\-])")
_PHONE = re.compile(r"(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,4}\)[ .\-]?|\d{3}[ .\-])\d{3,4}[ .\-]\d{4}(?![\d\-])"
                    r"|\+\d{8,15}(?![\d\-])|\+\d{1,3}[ .\-]\d{7,12}(?![\d\-])"
                    r"|\+\d(?:[ .\-/]?(?:\(0\) ?)?(?:\(\d{1,5}\)|\d)){4,14}(?![\d\-])")
# Beginnings of calling codes of one and of two digits; others have three.
_CODES = re.compile(r"[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}")
_SSN = re.compile(r"\d{3}-\d{2}-\d{4}(?![\d\-])")
_IBAN = re.compile(r"[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?!\w)")
_SECRET = re.compile(r"""[=:]\s{0,3}["']?([A-Za-z0-9_\-/+]{16,})(?!\w)""")
_SECRET_NAME = re.compile(r"(?:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key|key)[\"']?\s{0,3}$", re.IGNORECASE)
# Beginnings of access keys and tokens that tell their issuer, and what follows them.
_KEY_STARTS = ("AKIA", "ASIA", "AIza", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xoxb-", "xoxp-", "xoxa-", "sk-", "eyJ")
_KEYS = re.compile(r"(?:(AKIA|ASIA)[A-Z0-9]{16}|(AIza)[\w\-]{35}|(gh[pousr]_)[A-Za-z0-9]{36}|(xox[abp]-)[A-Za-z0-9\-]{10,}"
                   r"|(sk-)[A-Za-z0-9_\-]{20,}|(eyJ)[\w\-]{8,}\.eyJ[\w\-]{8,}\.[\w\-]{8,})(?![\w\-])")
_RESERVED = re.compile(r"(?<=[.@])example\.(?:com|net|org)$")
_CAPITAL = "A-ZÀ-ÖØ-ÞА-ЯЁΑ-Ω"
_WORD = rf"(?:[{_CAPITAL}]['’])?[{_CAPITAL}]\w+"
_LEAD = re.compile(_WORD)
_PARTICLES = r"(?:(?:de|del|della|den|der|di|da|do|dos|du|la|le|van|von|zu|bin|ibn|al|y) ){0,3}"
# What follows a title or a known given name: words of a name, with initials before them.
_INITIALS = rf"(?:[{_CAPITAL}](?:\. ?| )){{0,3}}"
_FOLLOWING = re.compile(rf"(\.?)[ \n\-]({_INITIALS}{_PARTICLES}{_WORD}(?:(?:-| {_INITIALS}{_PARTICLES}){_WORD}){{0,5}})")


# -- keyed permutations -------------------------------------------------------------------------------

def _draw(key: bytes, *parts: object) -> int:
    text = "\x1f".join(map(str, parts)).encode()
    return int.from_bytes(hashlib.blake2b(text, key=key, digest_size=24).digest(), "big")


def permuted(key: bytes, x: int, size: int, *tweak: object) -> int:
    """A keyed permutation of 0..size-1: an alternating Feistel network on a rectangle that holds the
    range, walked on until it falls into the range."""
    if size < 2:
        return x
    a = int(size ** 0.5) if size < 1 << 50 else 1 << (size.bit_length() + 1) // 2
    a = max(a, 1)
    b = -(-size // a)
    while True:
        left, right = x % a, x // a
        for turn in range(8):
            if turn % 2:
                right = (right + _draw(key, *tweak, size, turn, left)) % b
            else:
                left = (left + _draw(key, *tweak, size, turn, right)) % a
        x = right * a + left
        if x < size:
            return x


_ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_ALPHABET = {c: letters for letters in _ALPHABETS for c in letters}


# Texts with more letters are permuted letter by letter: one number for all would outgrow a draw, and its
# arithmetic takes time with the square of the length.
NUMBER_LETTERS = 40


def _permuted_long(key: bytes, text: str, letters: list, tweak: tuple) -> str:
    """A Feistel network over the two halves of the letters, in linear time: each half is moved, letter by
    letter in its own alphabet, by a stream drawn from all of the other half and the form."""
    form = "".join(c if a is None else a[0] for c, a in zip(text, letters))
    places = [k for k, a in enumerate(letters) if a]
    sizes = np.array([len(letters[k]) for k in places], np.uint32)
    index = {a: {c: i for i, c in enumerate(a)} for a in {letters[k] for k in places}}
    digits = np.array([index[letters[k]][text[k]] for k in places], np.uint32)
    half = len(digits) // 2
    sides = (slice(0, half), slice(half, None))
    said = hashlib.blake2b("\x1f".join(map(str, (form, *tweak))).encode(), key=key, digest_size=32).digest()
    for turn in range(8):
        moved, other = sides[turn % 2], sides[1 - turn % 2]
        seed = hashlib.blake2b(said + bytes([turn]) + digits[other].tobytes(), key=key, digest_size=32).digest()
        stream = np.frombuffer(hashlib.shake_256(seed).digest(4 * len(digits[moved])), np.uint32)
        digits[moved] = (digits[moved] + stream % sizes[moved]) % sizes[moved]
    out = list(text)
    for k, digit in zip(places, digits.tolist()):
        out[k] = letters[k][digit]
    return "".join(out)


def permuted_text(key: bytes, text: str, *tweak: object, letters_of: str | None = None) -> str:
    """A keyed permutation of the texts of one form: digits, small and capital letters in the same places
    and everything else as it is; or of all texts over the letters ``letters_of``."""
    letters = [letters_of or _ALPHABET.get(c) for c in text]
    if sum(a is not None for a in letters) > NUMBER_LETTERS:
        return _permuted_long(key, text, letters, tweak)
    form = text if not any(letters) else "".join(c if a is None else a[0] for c, a in zip(text, letters))
    x, size = 0, 1
    for c, a in zip(text, letters):
        if a:
            x, size = x * len(a) + a.index(c), size * len(a)
    x = permuted(key, x, size, form, *tweak)
    out = []
    for c, a in zip(reversed(text), reversed(letters)):
        if a:
            x, digit = divmod(x, len(a))
            c = a[digit]
        out.append(c)
    return "".join(reversed(out))


def _luhn(digits: str) -> int:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 - k % 2)
        total += d - 9 if d > 9 else d
    return -total % 10


def _card(key, digits, draw):
    """Keeps the first digit, and the distance of the last one from the right check digit."""
    off = int(digits[-1]) - _luhn(digits[:-1])
    body = digits[0] + permuted_text(key, digits[1:-1], "card", digits[0], draw)
    return body + str((_luhn(body) + off) % 10)


def _phone(key, digits, draw):
    """Keeps the calling code after a plus, or what stands before the last ten digits, and the exchange 555
    where it stands."""
    cut = _CODES.match(digits, 1).end() if digits[0] == "+" else max(0, len(digits) - 10)
    lead, rest = digits[:cut], digits[cut:]
    fiction = rest[3:6] == "555"
    if fiction:
        moved = permuted_text(key, rest[:3] + rest[6:], "phone", lead, draw)
        return lead + moved[:3] + "555" + moved[3:]
    while True:
        rest = permuted_text(key, rest, "phone", lead, draw)
        if rest[3:6] != "555":
            return lead + rest


_NETS = ((10 << 24, 8), (172 << 24 | 16 << 16, 12), (192 << 24 | 168 << 16, 16), (127 << 24, 8))


def _net(x: int) -> tuple[int, int]:
    return next(((base, 32 - bits) for base, bits in _NETS if x >> 32 - bits == base >> 32 - bits), (0, 32))


def _ip(key, text, draw):
    """Stays in its private or loopback network, or public."""
    x = 0
    for part in text.split("."):
        x = x << 8 | int(part)
    base, bits = _net(x)
    while True:
        x = base | permuted(key, x - base, 1 << bits, "ip", base, draw)
        if _net(x) == (base, bits):
            return ".".join(str(x >> s & 255) for s in (24, 16, 8, 0))


def _check(text: str) -> int:
    """The check digits that an account number should have."""
    return 98 - int("".join(str(int(c, 36)) for c in text[4:] + text[:2] + "00")) % 97


def _iban(key, text, draw):
    """Keeps the country; the check digits are right for the new number if they were for the old."""
    country, body = text[:2], permuted_text(key, text[4:], "iban", text[:2], draw)
    return country + (f"{_check(country + '00' + body):02d}" if int(text[2:4]) == _check(text) else text[2:4]) + body


def _email(key, text, draw):
    """Keeps the form and the top-level domain, or a domain that is reserved for examples."""
    reserved = _RESERVED.search(text)
    at = reserved.start() if reserved else text.rindex(".")
    return permuted_text(key, text[:at], "email", text[at:], draw) + text[at:]


def _secret(key, text, draw):
    """Hexadecimal numbers stay such."""
    digits = "0123456789abcdef"
    return permuted_text(key, text, "secret", draw, letters_of=None if text.strip(digits) else digits)


def _issued(key, text, draw):
    """Keeps the beginning that tells the issuer."""
    start = next(s for s in _KEY_STARTS if text.startswith(s))
    return start + permuted_text(key, text[len(start):], "key", start, draw)


def _script(word: str) -> str:
    first = ord(word[0])
    return "cyrillic" if 0x400 <= first < 0x530 else "greek" if 0x370 <= first < 0x400 else "latin"


def _name(key, kind, value, draw):
    """``kind`` is given or surname with a gender; more syllables after each few draws."""
    part, gender = kind.split(":")
    script = SCRIPTS[_script(value)]
    x = _draw(key, part if part == "surname" else kind, value, draw)
    word = ""
    for _ in range(2 + (part == "surname") + draw // 8):
        x, k = divmod(x, len(script["syllables"]))
        word += script["syllables"][k]
    ends = script[part][gender]
    return (word + ends[x % len(ends)]).capitalize()


def surrogate(key: bytes, kind: str, value: str, draw: int) -> str:
    """The surrogate of a normalised value on its ``draw``-th try; never the value itself."""
    make = {"card": _card, "phone": _phone, "ip": _ip, "iban": _iban, "email": _email, "secret": _secret,
            "key": _issued}.get(kind)
    if make:
        return make(key, value, draw)
    if ":" in kind:
        return _name(key, kind, value, draw)
    return permuted_text(key, value, kind, draw)


# -- detection ------------------------------------------------------------------------------------------

def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit() and c.isascii())


def _free(text: str, start: int) -> bool:
    """Whether a number that starts here is not the rest of a longer one or of a word."""
    return start == 0 or not (text[start - 1].isalnum() or text[start - 1] in "._-+" and text[start - 2:start - 1].isalnum())


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, normalised value), in order, without overlaps; earlier rules win."""
    found: list[tuple[int, int, str, str]] = []
    if "=" in text or ":" in text:
        for m in _SECRET.finditer(text):
            if _SECRET_NAME.search(text, max(0, m.start() - 24), m.start()):
                found.append((*m.span(1), "secret", m[1]))
    if any(start in text for start in _KEY_STARTS):
        found += [(*m.span(), "key", m[0]) for m in _KEYS.finditer(text) if _free(text, m.start())]
    if "@" in text:
        found += [(*m.span(), "email", m[0].lower()) for m in _EMAIL.finditer(text)]
    for m in _IBAN.finditer(text):
        end = _account_end(m[0]) if _free(text, m.start()) else 0
        if end:
            found.append((m.start(), m.start() + end, "iban", m[0][:end].replace(" ", "")))
    if any(c in text for c in "0123456789"):
        for m in _CARD.finditer(text):
            # Up to 15 digits after a plus are a phone number.
            if _free(text, m.start()) and (text[m.start() - 1:m.start()] != "+" or len(_digits(m[0])) > 15):
                found.append((*m.span(), "card", _digits(m[0])))
        for m in _IP.finditer(text):
            if _free(text, m.start()) and all(int(p) < 256 for p in m[0].split(".")):
                found.append((*m.span(), "ip", ".".join(str(int(p)) for p in m[0].split("."))))
        for m in _SSN.finditer(text):
            if _free(text, m.start()):
                found.append((*m.span(), "ssn", m[0]))
        found += _phones(text, sorted(found))
    found += _names(text)
    kept = _apart([], found)
    named = {x[3]: x[2] for x in reversed(kept) if ":" in x[2]}
    if named:
        bare = [m for m in _LEAD.finditer(text) if m[0] in named]
        _apart(kept, [(*m.span(), named[m[0]], m[0]) for m in bare if not text[m.start() - 1:m.start()].isalnum()])
    return kept


def _apart(kept: list, found: list) -> list:
    """``kept``, in order, with those of ``found`` that overlap nothing before them."""
    for x in found:
        k = bisect_left(kept, x[:2], key=lambda y: y[:2])
        if x[0] < x[1] and (k == 0 or kept[k - 1][1] <= x[0]) and (k == len(kept) or x[1] <= kept[k][0]):
            kept.insert(k, x)
    return kept


def _account_end(shown: str) -> int:
    """Where an account number ends: what stands in groups may go on with other words, so the longest part
    with right check digits counts, or all of it if most of it are digits; 0 if there is none."""
    if " " not in shown:
        return len(shown)
    ends = [len(shown), *[k for k in range(len(shown) - 1, 0, -1) if shown[k] == " "]]
    for end in ends:
        value = shown[:end].replace(" ", "")
        if len(value) >= 15 and int(value[2:4]) == _check(value):
            return end
    value = shown.replace(" ", "")
    return len(shown) if len(value) >= 15 and 2 * len(_digits(value)) >= len(value) else 0


def _phones(text: str, others: list) -> list[tuple[int, int, str, str]]:
    """Phone numbers, none of which goes on into an entity of ``others``."""
    found = []
    starts = [x[0] for x in others]
    for m in _PHONE.finditer(text):
        k = bisect_left(starts, m.start())
        if k < len(starts) and starts[k] < m.end():
            m = _PHONE.match(text, m.start(), starts[k])
        if m and _free(text, m.start()):
            digits = _digits(m[0].replace("(0)", ""))
            plus = m[0][0] == "+"
            if (8 if plus else 10) <= len(digits) <= (15 if plus else 13) and len(m[0]) > len(digits):
                found.append((*m.span(), "phone", "+" * plus + digits))
    return found


def _names(text: str) -> list[tuple[int, int, str, str]]:
    """Given names and surnames after a title, or after a known given name. Initials stay."""
    found: list[tuple[int, int, str, str]] = []
    end, told = 0, "n"
    for lead in _LEAD.finditer(text):
        if lead.start() < end or lead.start() and text[lead.start() - 1].isalnum():
            continue
        titled = TITLES.get(lead[0])
        gender = titled or _GENDER.get(lead[0])
        m = gender and _FOLLOWING.match(text, lead.end())
        second = _LEAD.match(m[2]) if m and text[m.start(2) - 1] == "-" else None
        if not m or m[1] and not titled or text[m.start(2) - 1] == "-" and (
                titled or not second or second[0] not in _GENDER):
            told = "n"
            continue
        words = [(w.start() + m.start(2), w.end() + m.start(2), w[0]) for w in _LEAD.finditer(m[2])]
        cut = next((k for k, w in enumerate(words) if w[2] in TITLES), len(words))
        if cut == 0:
            # The next title goes on with the gender of this one.
            told = gender if titled and gender != "n" else told
            continue
        words = words[:cut]
        if titled:
            gender = told if gender == "n" else gender
            if gender == "n" and len(words) > 1:
                gender = _GENDER.get(words[0][2], "n")
        else:
            words = [(lead.start(), lead.end(), lead[0]), *words]
        # Words joined by a hyphen are one; the last is a surname, those before it are if not known as given names.
        place = [0]
        for k in range(1, len(words)):
            place.append(place[-1] + (text[words[k - 1][1]] != "-"))
        if not titled and not place[-1]:
            continue
        told = "n"
        end = words[-1][1]
        found += [(a, b, f"{'given' if p < place[-1] and (p == 0 or w in _GENDER) else 'surname'}:{gender}", w)
                  for p, (a, b, w) in zip(place, words)]
    return found


def _shown(original: str, kind: str, new: str) -> str:
    """The surrogate in the written form of the original: its separators and its letter case."""
    if kind in ("card", "phone"):
        digits = iter(_digits(new))
        return "(0)".join("".join(next(digits) if c.isdigit() and c.isascii() else c for c in part)
                          for part in (original.split("(0)") if kind == "phone" else [original]))
    if kind == "iban":
        letters = iter(new)
        return "".join(c if c == " " else next(letters) for c in original)
    if kind == "email":
        return "".join(n.upper() if c.isupper() else n for c, n in zip(original, new))
    if ":" in kind and original.isupper():
        return new.upper()
    return new


def replaced(text: str, key: bytes, exceptions: dict, known: dict) -> tuple[str, int, int]:
    """The text with surrogates, the number of entities in it, and of different ones."""
    found = entities(text)
    if not found:
        return text, 0, 0
    out, at = [], 0
    for start, end, kind, value in found:
        new = exceptions.get((kind, value)) or known.get((kind, value))
        if new is None:
            if len(known) > 50_000:
                known.clear()
            new = known[kind, value] = surrogate(key, kind, value, 0)
        out += [text[at:start], _shown(text[start:end], kind, new)]
        at = end
    out.append(text[at:])
    return "".join(out), len(found), _different({x[2:] for x in found})


def _different(found: set) -> int:
    """Number of entities of some (kind, value); surnames, and given names of no gender, are one with those of another."""
    own = {("surname", v) if k.startswith("surname:") else (k, v) for k, v in found}
    return len({x for x in own if x[0] != "given:n" or not {("given:f", x[1]), ("given:m", x[1])} & own})


# -- jobs -------------------------------------------------------------------------------------------------

def _mentions(batches):
    for batch in batches:
        for part in pieces(batch):
            rows = []
            prints = part.column("print").to_pylist()
            for row, text in zip(prints, part.column("text").to_pylist()):
                rows += {(row, *x[2:]) for x in entities(text or "")}
            columns = list(zip(*rows)) or [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())],
                ["print", "kind", "value"])


def _drawn(key: bytes):
    def run(batches):
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("kind", "value", "draw")))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("kind", "value", "draw")],
                 pa.array([surrogate(key, *row) for row in rows], pa.string())], ["kind", "value", "draw", "surrogate"])

    return run


def _replace(key: bytes, exceptions: dict | None):
    def run(batches):
        known: dict = {}
        for batch in batches:
            for part in pieces(batch):
                own = part.column("exceptions").to_pylist() if exceptions is None else [None] * part.num_rows
                rows = [(None, 0, 0) if text is None else replaced(
                    text, key, exceptions if exceptions is not None else {
                        (x["kind"], x["value"]): x["surrogate"] for x in extra or ()}, known)
                    for text, extra in zip(part.column("text").to_pylist(), own)]
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()),
                     pa.array(columns[2], pa.int32())], ["row", "text", "n_entities", "n_distinct"])

    return run


def assign(found: DataFrame, key: bytes) -> tuple[DataFrame, int]:
    """(kind, value, surrogate) of the mentions that do not get their own first draw, and their number.

    A surname has one gender in all mentions, and a given name without one takes that of another mention.
    Names of all genders share one space of surrogates. Rounds: draw for all entities, find clashes, let one of
    each clash keep its surrogate (the one drawn last) and draw anew for the others; all do if it is a real value.
    """
    space = F.substring_index("kind", ":", 1)
    shape = "kind STRING, value STRING, draw INT, surrogate STRING"
    told = found.where(F.col("kind").rlike(":[fm]$")).groupBy(space.alias("space"), "value").agg(F.min("kind").alias("told"))
    joint = F.col("kind").startswith("surname:") | (F.col("kind") == "given:n")
    own, _ = stored(found.withColumn("draw", F.lit(0)).mapInArrow(_drawn(key), shape).withColumn("space", space)
                    .join(told, ["space", "value"], "left")
                    .withColumn("entity", F.when(joint, F.coalesce("told", "kind")).otherwise(F.col("kind"))), "mentioned")
    now, _ = stored(own.select(F.col("entity").alias("kind"), "value").distinct().withColumn("draw", F.lit(0)).mapInArrow(
        _drawn(key), shape), "surrogates")
    for _ in range(MOST_DRAWS):
        real = now.select(space.alias("space"), F.col("value").alias("surrogate")).distinct().withColumn("real", F.lit(True))
        first = now.groupBy(space.alias("space"), "surrogate").agg(
            F.max(F.struct("draw", "value", "kind")).alias("one"), F.count(F.lit(1)).alias("holders"))
        bad = first.join(real, ["space", "surrogate"], "left").where("holders > 1 or real")
        bad, seen = stored(bad.select("space", "surrogate", "one", F.coalesce("real", F.lit(False)).alias("real")), "clashes")
        if not seen["rows"]:
            break
        few = F.broadcast(bad) if seen["rows"] <= BROADCAST_ROWS else bad
        joined = now.withColumn("space", space).join(few, ["space", "surrogate"], "left")
        stays = F.col("one").isNull() | (~F.col("real") & (F.col("one.value") == F.col("value")) & (
            F.col("one.kind") == F.col("kind")))
        again = joined.select("kind", "value", F.when(stays, F.col("draw")).otherwise(F.col("draw") + 1).alias("draw"))
        now, _ = stored(again.mapInArrow(_drawn(key), shape), "surrogates")
    else:
        raise RuntimeError("surrogates still clash; use longer names")
    final = now.select(F.col("kind").alias("entity"), "value", F.col("surrogate").alias("final"))
    kept, seen = stored(own.join(final, ["entity", "value"]).where("surrogate <> final").select(
        "kind", "value", F.col("final").alias("surrogate")), "exceptions")
    return kept, seen["rows"]


def replace_entities(docs: DataFrame, key: bytes, most_in_memory: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` with surrogates in ``text``, and n_entities and n_distinct (different ones) added.

    All columns and rows stay; ``docs`` needs text alone. Null texts stay null and empty ones empty, with
    no entities. Equal entities have equal surrogates in all texts, different ones of a kind different
    surrogates, and no surrogate is a value of its kind that the corpus holds. Columns named n_entities or
    n_distinct are replaced. An empty table gives an empty result.
    """
    others = [c for c in docs.columns if c not in ("text", "n_entities", "n_distinct")]
    # A row without other columns still needs a field.
    rest = F.struct(*[F.col(f"`{c}`") for c in others], F.lit(0).alias("_none_")).alias("row")
    printed = docs.select(rest, "text", F.xxhash64("text").alias("print"))
    mentions = printed.select("print", "text").mapInArrow(_mentions, "print BIGINT, kind STRING, value STRING")
    found, _ = stored(mentions.select("kind", "value").distinct(), "entities")
    exceptions, rows = assign(found, key)
    kind = printed.schema["row"].dataType.simpleString()
    shape = f"row {kind}, text STRING, n_entities INT, n_distinct INT"
    if rows <= most_in_memory:
        lookup = {(r["kind"], r["value"]): r["surrogate"] for r in exceptions.collect()}
        done = printed.select("row", "text").mapInArrow(_replace(key, lookup), shape)
    else:
        held = mentions.distinct().join(exceptions, ["kind", "value"]).groupBy("print").agg(
            F.collect_list(F.struct("kind", "value", "surrogate")).alias("exceptions"))
        done = printed.join(held, "print", "left").select("row", "text", "exceptions").mapInArrow(
            _replace(key, None), shape)
    columns = [F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns
               if c not in ("n_entities", "n_distinct")]
    return done.select(*columns, "n_entities", "n_distinct")
