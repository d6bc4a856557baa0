"""Keyed surrogates for personal data and secrets, alike in type, gender, script and format.

Every surrogate comes from a keyed permutation without fixed points of all strings that look alike: the same
kind, the same class at each place (digit, vowel, consonant, upper or lower case, script), the same fixed
parts. So one original has one surrogate in every document (coreference), two originals never share one, and
none keeps its own. ``checked_surrogates`` counts over the whole corpus what would contradict that, and a
document that holds such an entity gets it masked by its kind instead.

Names: common given names are permuted within the list of their gender and script. Any other name word, given or
family, keeps the ending that shows gender and origin (Schmidt-ova, -ski and -ska, -ina, -son) and gets another
stem of the same vowels and consonants that can be spoken where the original can. Persons are found after a title
and where a common given name stands before another name; their later mentions in the document are replaced too, but
for words that a language has besides. Forms of one entity (a telephone number's spaces, an address in capitals, a name
in capitals) have one surrogate, and the count over the corpus goes by these normal forms; a number without its country's
code is another one.
Names outside the list without a title, and names in scripts without upper case, are not found. Check digits are
kept valid (a number whose check digit is wrong is no card; an IBAN's may be).

Cases: a null text stays null and an empty one empty, with 0 entities; a text without entities is returned
unchanged; a secret without letters or digits is a mask (``****``) and stays; longer entities win over shorter
ones inside them; long secrets are permuted piece by piece; repeated rows give equal rows; other columns, whatever
their names, are kept.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable
from functools import lru_cache
from hashlib import blake2b
from itertools import takewhile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cut, free_name, release, schema_of, slices, with_row_number

# Common given names by script and gender; titles by gender; letters by script.
NAMES = {
    ("latin", "f"): "Anna Maria Sophie Laura Julia Emma Clara Lucia Elena Sarah Marie Claire Camille Carmen Isabel Paula Ingrid Helga Nora Alice Mary Linda Susan Karen Emily Olivia Hannah Grace Amelia Charlotte".split(),
    ("latin", "m"): "Peter Thomas Michael Hans Karl Jan Lukas Paul Louis Pierre Jean Hugo Carlos Javier Pablo Diego Miguel Robert John James David William Henry George Oliver Jack Daniel Samuel Edward Charles".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Юлия".split(),
    ("cyrillic", "m"): "Иван Пётр Алексей Дмитрий Сергей Андрей Михаил Николай Владимир Павел".split(),
}
TITLES = {
    "f": "Mrs Ms Miss Madame Mme Mademoiselle Mlle Frau Señora Señorita Sra Srta Doña Госпожа".split(),
    "m": "Mr Mister Monsieur Herr Señor Don Господин".split(),
    "": "Dr Prof Doktor Docteur Doctor".split(),
}
#: Words of a language that are names too: such a word alone is no mention of a person, nor does it begin one.
COMMON = frozenset("Will May Mark Grace Hope Rose Bill Frank Art Rich Grant Chase Young Long Short Brown White Black Green King Page Price Day Summer Winter Stone Wood Field Hill Bush Best Good Strong Sharp Bell Cook Baker Carter Fox Wolf Rivers Banks Church Pope Bishop".split())
#: Country codes of telephone numbers: of one digit, and of two; all others have three.
CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
ALPHABETS = ["0123456789"] + [x for low in ("aeiou", "bcdfghjklmnpqrstvwxyz", "äöüáàâéèêíìîóòôúùûëïæøå", "çñßþð", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ") for x in (low, "".join(c.upper() for c in low if len(c.upper()) == 1 and c.upper() != c))]
HEX = {"0-9a-f": ["0123456789abcdef"], "0-9A-F": ["0123456789ABCDEF"]}
#: Endings of names that show gender or origin; consonants that are spoken together.
ENDINGS = (
    "a ia ina ine ette elle e o us ian an er ik son sen sson dottir mann berg stein ez es ov ova ev eva in ski ska sky skaya wicz ini elli ard ier "
    "а я ия ина ов ова ев ева ёв ёва ин ский ская цкий цкая енко ко ич ук юк ий ей"
).split()
CLUSTERS = frozenset(
    "bb bl br ch ck cl cr ct dd dr dt ff fl fr ft gg gl gn gr gs ht hl hm hn hr kh kl kn kr ks lb ld lf lg lk ll lm ln lp ls lt lz mb mm mp mt nd nf ng nk nn ns nt nz pf ph pl pp pr ps pt "
    "rb rc rd rf rg rh rk rl rm rn rp rr rs rt rv rw rz sc sh sk sl sm sn sp ss st sw th tn tr ts tt tw tz wh zh zz chl chm chr cht ndr nch ngl nst ntr rch rst rth rtz sch scr spr str tch".split()
)
VOWELS = frozenset("ae ai au ea ee ei eu ia ie io oa oe oi oo ou ua ue ui".split())
#: Letters of names: those that most names have, and the rare ones.
NAME_LETTERS = [x for low in ("aeiou", "bdfghklmnprstvwz", "cjqxy") for x in (low, low.upper())]

_OF = {c: a for a in ALPHABETS for c in a}
_IN_NAMES = {c: a for a in NAME_LETTERS for c in a}
_STAY = frozenset("ъьЪЬ")
PIECE = 256


@lru_cache(10_000)
def alphabet(c: str) -> str | None:
    """What may stand for a character: its class above, else the ten digits of its script or the letters of its
    case in its block of 128 code points; None for all other signs."""
    if c in _OF:
        return _OF[c]
    kind = unicodedata.category(c)
    if kind == "Nd":
        return "".join(chr(ord(c) - unicodedata.decimal(c) + k) for k in range(10))
    if kind not in ("Lu", "Ll", "Lo") or c in _STAY:
        return None
    block = ord(c) // 128 * 128
    found = "".join(x for x in map(chr, range(block, block + 128)) if unicodedata.category(x) == kind and x not in _OF and x not in _STAY)
    return found if len(found) > 1 else None
_UPPER = "A-ZÀ-ÖØ-ÞА-ЯЁ"
_LOWER = "a-zà-öø-ÿа-яё"
#: What stands before a name's stem and stays.
_PREFIX = "(?:Mc|Mac(?=[A-Z])|[OD]['’](?=[A-Z]))"
_WORD = rf"{_PREFIX}?[{_UPPER}][{_LOWER}]+"
_NAME = rf"{_WORD}(?:-{_WORD})?"
_LOUD = rf"(?:[OD]['’])?[{_UPPER}]{{2,}}(?:-[{_UPPER}]{{2,}})?"
_TITLES = [t for ts in TITLES.values() for t in ts]
_GIVEN = {n: (k, i) for k, names in NAMES.items() for i, n in enumerate(names)}

_PATTERNS = {
    "email": r"(?<![\w.+-])[A-Za-z0-9][\w.+-]*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}(?![\w-])",
    "pem": r"-----BEGIN [A-Z ]*PRIVATE KEY-----\s*(?P<token2>[A-Za-z0-9+/=\s]+?)\s*-----END",
    "bearer": r"\b[Bb]earer\s+(?P<token3>[A-Za-z0-9._~+/-]{8,})",
    "provider": r"\b(?P<token4>gh[pousr]_[A-Za-z0-9]{16,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9_-]{20,})",
    "named_token": r"(?i:(?:token|secret|api[_-]?key|access[_-]?key)[\"']?\s{0,3}[:=]\s{0,3})[\"']?(?P<token5>(?=[^\s\"']*[0-9])[A-Za-z0-9_./+=-]{8,})",
    "quoted_password": r"(?i:(?:password|passwd|passphrase|pwd)[\"']?\s{0,3}[:=]\s{0,3})(?:\"(?P<password2>[^\"\n]+)\"|'(?P<password3>[^'\n]+)')",
    "named_password": r"(?i:(?:password|passwd|passphrase|pwd)\s{0,3}=\s{0,3})(?P<password4>[^\s\"',;]+)|(?i:(?:password|passwd|passphrase|pwd)\s{0,3}:\s{0,3})(?P<password5>(?=[^\s\"',;]*[^\sA-Za-z.\"',;])[^\s\"',;]+)|\b(?i:pwd): (?P<password6>[^\s\"',;]+)",
    "token": r"(?:(?<=token = \")|(?<=token=\")|(?<=secret = \")|(?<=api_key = \"))[0-9A-Za-z_-]{16,}(?=\")|(?<=\")(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?=\")",
    "aws_key": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ipv6": r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:]|\.\w)",
    "ipv4": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\w]|\.\d)",
    "card": r"(?<![\w-])[3-6]\d{3}(?:[ -]?\d{4}){2}[ -]?\d{4}(?![\w-])|(?<![\w-])3[47]\d{2}[ -]?\d{6}[ -]?\d{5}(?![\w-])",
    "ssn": r"(?<![\w-])(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}(?![\w-])",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\w)|(?<![\w(])\(\d{3}\) ?\d{3}[.-]\d{4}(?!\w)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w.-])",
}
_PERSONS = {
    "titled": rf"\b(?:(?:{'|'.join(sorted(_TITLES, key=len, reverse=True))})\b\.? {{1,3}})+{_NAME}(?: {{1,3}}{_NAME}){{0,2}}",
    "loud": rf"\b(?:(?:{'|'.join(sorted((t.upper() for t in _TITLES), key=len, reverse=True))})\b\.? {{1,3}})+{_LOUD}(?: {{1,3}}{_LOUD}){{0,2}}(?![{_LOWER}])",
    "named": rf"\b(?:{'|'.join(sorted(_GIVEN.keys() - COMMON, key=len, reverse=True))})(?: [{_UPPER}]\.)?(?: {{1,3}}{_NAME}){{1,2}}",
}
_PERSON = re.compile("|".join(f"(?P<{k}>{v})" for k, v in _PERSONS.items()))
#: Starts with a known letter, so that texts without such a name are passed over fast.
_KNOWN = re.compile("|".join(sorted({*_TITLES, *(t.upper() for t in _TITLES), *_GIVEN})))
_DIGIT = re.compile("[0-9]")
_TITLE = re.compile(rf"(?:{'|'.join(sorted({*_TITLES, *(t.upper() for t in _TITLES)}, key=len, reverse=True))})\b\.? {{1,3}}")
_KEYWORDS = ("passw", "passphrase", "pwd", "token", "secret", "api_key", "api-key", "apikey", "access_key", "access-key", "accesskey", "bearer", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "sk-", "private key")


@lru_cache(32)
def _finder(mail: bool, keyed: bool, quoted: bool, digits: bool, colons: bool) -> re.Pattern | None:
    """All patterns that a text of these signs can hold, in their order."""
    signs = {"email": mail, "token": keyed or quoted, "ipv6": colons} | dict.fromkeys(("pem", "bearer", "provider", "named_token", "quoted_password", "named_password"), keyed)
    some = {k: v for k, v in _PATTERNS.items() if signs.get(k, digits)}
    return re.compile("|".join(v if "(?P<" in v else f"(?P<{k}>{v})" for k, v in some.items())) if some else None


class Permutation:
    """A keyed permutation of 0..n-1 that is one cycle, so it has no fixed point (n > 1)."""

    def __init__(self, key: bytes, tweak: str, n: int):
        self.n, self.half = n, max(1, ((n - 1).bit_length() + 1) // 2)
        self.key, self.tweak = key[:64], tweak.encode()[:64] if len(tweak.encode()) <= 64 else blake2b(tweak.encode()).digest()

    def _round(self, k: int, x: int) -> int:
        size = (self.half + 7) // 8
        stream, j = b"", 0
        while len(stream) < size:
            stream += blake2b(self.tweak + bytes([k, j]) + x.to_bytes(size, "big"), key=self.key).digest()
            j += 1
        return int.from_bytes(stream[:size], "big") & ((1 << self.half) - 1)

    def _mix(self, x: int, rounds) -> int:
        mask = (1 << self.half) - 1
        while True:  # walk on until the value is in range again
            a, b = x >> self.half, x & mask
            if rounds[0] == 0:
                for k in rounds:
                    a, b = b, a ^ self._round(k, b)
            else:
                for k in rounds:
                    a, b = b ^ self._round(k, a), a
            x = a << self.half | b
            if x < self.n:
                return x

    def next(self, x: int) -> int:
        return self._mix((self._mix(x, range(8)) + 1) % self.n, range(7, -1, -1)) if self.n > 1 else x


def permuted(key: bytes, kind: str, text: str, alphabets: list[str] | Callable[[str], str | None] | None = None, fixed: int = 0, tail: int = 0, same: Callable[[str], object] | None = None) -> str:
    """Another text with a character of the same alphabet at each place but the first ``fixed`` and last ``tail``
    ones; characters of no alphabet stay. ``same`` has one value for the text and for the result."""
    if len(text) > PIECE:
        return "".join(permuted(key, f"{kind}|{k}", text[k : k + PIECE], alphabets, max(0, fixed - k), 0, same) for k in range(0, len(text), PIECE))
    of = {c: a for a in alphabets for c in a}.get if isinstance(alphabets, list) else alphabets or alphabet
    mask = [of(c) if fixed <= i < len(text) - tail else None for i, c in enumerate(text)]
    n, x = 1, 0
    for c, a in zip(text, mask, strict=True):
        if a:
            x, n = x * len(a) + a.index(c), n * len(a)
    if n < 2:
        return text
    shape = "".join("?" if a is None else a[0] for a in mask) + "|" + "".join(c for c, a in zip(text, mask, strict=True) if a is None)
    walk = Permutation(key, f"{kind}|{shape}", n)
    wanted = same(text) if same else None
    while True:  # on along the cycle, so that what is alike is permuted among itself
        x = y = walk.next(x)
        out = []
        for c, a in zip(reversed(text), reversed(mask), strict=True):
            if a:
                y, i = divmod(y, len(a))
                c = a[i]
            out.append(c)
        new = "".join(reversed(out))
        if same is None or same(new) == wanted:
            return new


def luhn(digits: str) -> int:
    """Sum that is 0 for a valid number."""
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits)))) % 10


def _refill(form: str, chars: str, holds=str.isalnum) -> str:
    it = iter(chars)
    return "".join(next(it) if holds(c) else c for c in form)


def _card(key: bytes, text: str) -> str:
    body = permuted(key, "card", "".join(filter(str.isdigit, text))[:-1], fixed=1)
    return _refill(text, body + str(-luhn(body + "0") % 10))


def _iban_number(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4]))


def _iban(key: bytes, text: str) -> str:
    s = text.replace(" ", "")
    body = permuted(key, "iban", s[4:], ["0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"])
    right = lambda x: 98 - _iban_number(f"{s[:2]}00{x}") % 97
    # as far from the right check digits as the original is
    return _refill(text, f"{s[:2]}{(int(s[2:4]) + right(body) - right(s[4:])) % 100:02d}{body}")


def _ip(key: bytes, text: str) -> str:
    parts = list(map(int, text.split(".")))
    kept = 1 if parts[0] in (10, 127) else 2 if parts[:2] == [192, 168] or parts[0] == 172 and 16 <= parts[1] < 32 or parts[:2] == [169, 254] else 0
    low = {1: 0, 2: 10, 3: 100}
    size = {1: 10, 2: 90, 3: 156}
    lens = [len(str(p)) for p in parts]
    n, x = 1, 0
    for p, k in zip(parts[kept:], lens[kept:], strict=True):
        x, n = x * size[k] + p - low[k], n * size[k]
    walk = Permutation(key, f"ipv4|{parts[:kept]}|{lens}", n)
    public = lambda q: not (q[0] in (0, 10, 127) or q[0] >= 224 or q[:2] in ([192, 168], [169, 254]) or q[0] == 172 and 16 <= q[1] < 32)
    while True:
        x = y = walk.next(x)
        new = []
        for k in reversed(lens[kept:]):
            y, r = divmod(y, size[k])
            new.append(r + low[k])
        new = parts[:kept] + new[::-1]
        if kept or public(parts) == public(new):
            return ".".join(map(str, new))


def _email(key: bytes, text: str) -> str:
    if text != text.lower():  # the address is the same in any case
        return "".join(n.upper() if o.isupper() else n for o, n in zip(text, _email(key, text.lower()), strict=True))
    local, _, domain = text.rpartition("@")
    labels = domain.split(".")
    reserved = 2 if len(labels) > 1 and labels[-2] == "example" else 1
    own = ".".join(labels[:-reserved])
    letters = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
    # a domain has one surrogate in all addresses
    return permuted(key, "local", local, letters) + "@" + ".".join([*([permuted(key, "domain", own, letters)] if own else []), *labels[-reserved:]])


def name_ending(word: str) -> str:
    """The longest listed ending that leaves two letters before it."""
    return max((e for e in ENDINGS if word.endswith(e) and len(word) >= len(e) + 2), key=len, default="")


def _spoken(word: str) -> bool | None:
    """Whether all letters that meet are spoken together; None where too few such words have this shape."""
    runs, pairs = re.findall("[bcdfghjklmnpqrstvwxyz]{2,}", word.lower()), re.findall("[aeiou]{2,}", word.lower())
    cost = 1
    for r in runs:
        cost *= 5 if len(r) == 2 else 200
    return None if cost > 5000 else all(r in CLUSTERS for r in runs) and all(v in VOWELS for v in pairs)


def _letters(c: str) -> str | None:
    return _IN_NAMES.get(c) or alphabet(c)


def name_surrogate(key: bytes, word: str) -> str:
    """One surrogate for a name word in any role: a listed given name's from its list, else a new stem."""
    if word in _GIVEN:
        k, i = _GIVEN[word]
        names = NAMES[k]
        return names[Permutation(key, f"given|{k}", len(names)).next(i)]
    if "-" in word:
        return "-".join(name_surrogate(key, w) for w in word.split("-"))
    if len(word) > 3 and (prefix := re.match(_PREFIX, word)):
        return prefix[0] + name_surrogate(key, word[prefix.end() :])
    if len(word) > 1 and word.isupper():  # the same name as in small letters
        return name_surrogate(key, word.capitalize()).upper()
    if len(word) > PIECE:
        return permuted(key, "name", word)
    return permuted(key, "name", word, _letters, tail=len(name_ending(word)), same=lambda w: (name_ending(w), w in _GIVEN, _spoken(w)))


def _phone(key: bytes, text: str) -> str:
    # its digits alone behind the country's code, so a number has one surrogate however it is written
    digits = "".join(filter(str.isdigit, text))
    code = next((k for k in (1, 2) if digits[:k] in CODES), 3) if text.startswith("+") else 0
    return _refill(text, permuted(key, "phone", digits, ["0123456789"], fixed=code), str.isdigit)


def _hex(text: str) -> str | None:
    return next((chars for chars in HEX if re.fullmatch(f"[{chars}]+", text)), None)


def _secret(key: bytes, kind: str, text: str) -> str:
    return permuted(key, kind, text, HEX.get(_hex(text)), same=lambda x: _hex(x) is None)


def surrogate(key: bytes, kind: str, text: str) -> str:
    """The surrogate of an entity of the given kind (persons: one word, see name_surrogate)."""
    if kind == "card":
        return _card(key, text)
    if kind == "iban":
        return _iban(key, text)
    if kind == "ipv4":
        return _ip(key, text)
    if kind == "ipv6":
        made = iter(permuted(key, kind, text.lower(), ["0123456789", "abcdef"]))
        return "".join(n.upper() if c.isupper() else n for c, n in zip(text, made, strict=True))
    if kind == "email":
        return _email(key, text)
    if kind == "phone":
        return _phone(key, text)
    if kind == "aws_key":
        return permuted(key, kind, text, ["0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"], fixed=4)
    if kind in ("token", "password"):
        return _secret(key, kind, text)
    return permuted(key, kind, text, ["0123456789"])


def entities(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in order; persons word by word as given or family."""
    if not text:
        return []
    low = text.lower()
    finder = _finder("@" in text, any(k in low for k in _KEYWORDS), '"' in text, bool(_DIGIT.search(text)) or "AKIA" in text or "ASIA" in text, text.count(":") > 1)
    found, known = [], {}
    for m in finder.finditer(text) if finder else ():
        group = m.lastgroup
        kind = group.rstrip("23456") if group not in ("ipv4", "ipv6") else group
        if kind == "card" and luhn("".join(filter(str.isdigit, m.group()))):
            continue  # an order number or the like
        if kind in ("password", "token") and not any(map(alphabet, m.group(group))):
            continue  # masked already
        found.append((*m.span(group), kind))
    taken = [x[0] for x in found], [x[1] for x in found]
    for m in _PERSON.finditer(text) if _KNOWN.search(text) else ():
        k = bisect_right(taken[0], m.end() - 1)
        if k and taken[1][k - 1] > m.start():
            continue  # inside or across another entity
        start = m.start()
        while m.lastgroup != "named" and (title := _TITLE.match(text, start, m.end())):
            start = title.end()
        words = takewhile(lambda x: x.group() not in _TITLES, re.finditer(_LOUD if m.lastgroup == "loud" else _NAME, text[start : m.end()]))
        parts = [(start + x.start(), start + x.end()) for x in words]
        for k, (a, b) in enumerate(parts):
            role = "given" if k < len(parts) - 1 or text[a:b] in _GIVEN else "family"
            found.append((a, b, role))
            if text[a:b] not in COMMON:
                known.setdefault(text[a:b], role)
    if known:  # mentions elsewhere
        found.sort()
        starts, ends = [x[0] for x in found], [x[1] for x in found]
        for m in re.finditer(rf"(?<!\w)(?:{'|'.join(map(re.escape, sorted(known, key=len, reverse=True)))})(?!\w)", text):
            k = bisect_right(starts, m.start())
            if (not k or ends[k - 1] <= m.start()) and (k == len(starts) or starts[k] >= m.end()):
                found.append((m.start(), m.end(), known[m.group()]))
    return sorted(found)


def replaced(key: bytes, text: str, masked: bool = False) -> tuple[str, list[tuple[str, str, str]]]:
    """The text with surrogates (or its entities masked), and (kind, original, surrogate) of each entity."""
    out, pairs, at = [], [], 0
    cached = _cached(key)
    for a, b, kind in entities(text):
        old = text[a:b]
        new = f"[{kind}]" if masked else cached(kind, old)
        out += [text[at:a], new]
        pairs.append((kind, old, new))
        at = b
    return ("".join([*out, text[at:]]), pairs) if pairs else (text, pairs)


@lru_cache(4)
def _cached(key: bytes):
    @lru_cache(20_000)
    def one(kind: str, old: str) -> str:
        return name_surrogate(key, old) if kind in ("given", "family") else surrogate(key, kind, old)

    return one


def normal(kind: str, text: str) -> str:
    """What all written forms of an entity have in common."""
    if kind in ("email", "ipv6"):
        return text.lower()
    if kind in ("phone", "card", "iban", "ssn"):
        return text[0] * (text[0] == "+") + "".join(filter(str.isalnum, text))
    return text.capitalize() if kind in ("given", "family") and text.isupper() else text


def _digest(kind: str, text: str) -> bytes:
    """Of the normal form; names are one kind, whatever their role."""
    return blake2b(f"{'name' if kind in ('given', 'family') else kind}|{normal(kind, text)}".encode(), digest_size=16).digest()


def with_surrogates(docs: DataFrame, key: bytes, text_col: str = "text", mask_col: str | None = None) -> DataFrame:
    """``docs`` with its text replaced, and pii: how many entities of which kind were replaced. Rows in which the
    boolean ``mask_col`` holds have their entities masked; that column goes."""
    names = [c for c in docs.columns if c != mask_col]
    added = free_name(docs, "pii")

    def replace(batches):
        for b in slices(batches):
            texts, kinds = [], []
            masks = b.column(mask_col).to_pylist() if mask_col else [False] * b.num_rows
            for t, m in zip(b.column(text_col).to_pylist(), masks, strict=True):
                new, pairs = replaced(key, t, bool(m)) if t else (t, [])
                texts.append(new)
                many: dict[str, int] = {}
                for kind, *_ in pairs:
                    many[kind] = many.get(kind, 0) + 1
                kinds.append(sorted(many.items()))
            cols = [pa.array(texts, pa.string()) if n == text_col else b.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(kinds, pa.map_(pa.string(), pa.int64()))], names=[*names, added])

    return docs.mapInArrow(replace, schema_of(docs, names, f"`{added}` map<string,bigint>"))


def mentions(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """(kind, original, surrogate, n): digests of what is replaced by what, counted."""

    def found(batches):
        seen: dict[tuple, int] = {}

        def batch():
            side = lambda k: pa.array([_digest(x[0], x[k]) for x in seen], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in seen], pa.string()), side(1), side(2), pa.array(list(seen.values()), pa.int64())], names=["kind", "original", "surrogate", "n"])

        for b in slices(batches):
            for t in b.column(0).to_pylist():
                for x in replaced(key, t)[1] if t else ():
                    seen[x] = seen.get(x, 0) + 1
            if len(seen) > 100_000:
                yield batch()
                seen.clear()
        yield batch()

    rows = docs.select(F.col(text_col).alias("t")).mapInArrow(found, "kind string, original binary, surrogate binary, n long")
    kind = F.when(F.col("kind").isin("given", "family"), "name").otherwise(F.col("kind"))
    return rows.groupBy(kind.alias("kind"), "original", "surrogate").agg(F.sum("n").alias("n"))


def contradictions(pairs: DataFrame) -> DataFrame:
    """Originals that keep themselves, have several surrogates, or share one."""
    shared = pairs.groupBy("surrogate").agg(F.count("*").alias("k")).where("k > 1").select("surrogate")
    split = pairs.groupBy("original").agg(F.count("*").alias("k")).where("k > 1").select("original")
    kept = pairs.where(F.col("original") == F.col("surrogate")).select("original")
    return kept.unionByName(split).unionByName(pairs.join(shared, "surrogate", "left_semi").select("original")).distinct()


def checked_surrogates(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """``with_surrogates`` after a count over all documents: those that hold a contradicting entity are masked."""
    pairs = cut(mentions(docs, key, text_col))
    bad = cut(contradictions(pairs))
    release(pairs)
    if bad.isEmpty():
        release(bad)
        return with_surrogates(docs, key, text_col)
    row, mark = free_name(docs, "_row"), free_name(docs, "_masked")
    rows = cut(with_row_number(docs, row))

    def held(batches):
        for b in slices(batches):
            found = [(r, d) for r, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if t for d in {_digest(k, old) for k, old, _ in replaced(key, t)[1]}]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.binary())], names=[row, "original"])

    marked = rows.select(row, text_col).mapInArrow(held, f"`{row}` long, original binary").join(bad, "original", "left_semi").select(row).distinct().withColumn(mark, F.lit(True))
    return with_surrogates(rows.join(marked, row, "left").drop(row), key, text_col, mark)


def collisions(pairs: DataFrame) -> DataFrame:
    """Per kind of stored ``mentions``: distinct originals and surrogates, surrogates of several originals
    (distinctness lost), originals of several surrogates (coreference lost), originals that keep themselves."""
    by_new = pairs.groupBy("kind", "surrogate").agg(F.count("*").alias("k"), F.sum(F.when(F.col("original") == F.col("surrogate"), 1).otherwise(0)).alias("same"), F.sum("n").alias("n"))
    by_old = pairs.groupBy("kind", "original").agg(F.count("*").alias("k"))
    left = by_new.groupBy("kind").agg(F.sum("n").alias("mentions"), F.count("*").alias("surrogates"), F.sum(F.when(F.col("k") > 1, 1).otherwise(0)).alias("shared"), F.sum("same").alias("unchanged"))
    right = by_old.groupBy("kind").agg(F.count("*").alias("originals"), F.sum(F.when(F.col("k") > 1, 1).otherwise(0)).alias("split"))
    return left.join(right, "kind")
