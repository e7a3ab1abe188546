"""Personal data replaced by surrogates of the same type, gender, script and format.

A surrogate comes from a keyed permutation: the characters of a value, each within its own alphabet
(digits, lower- or upper-case letters), are read as one number, moved by one step along a secret cycle of all
numbers of that shape, and written back. So the same value has the same surrogate everywhere (coreference),
different values have different surrogates (distinctness), none is its own, and punctuation, length, case,
script, issuer digit and check digit stay. Whoever has the key can undo it; there is no default key.

Names go word by word, so that a person keeps a surrogate under title, full name and surname. Listed given
names permute within their gender and script, listed Chinese surnames among themselves. Other Latin, Cyrillic
and Greek words become pronounceable names of their script: the word's number, moved along the cycle of all
words that need as many syllables, is spelt in syllables, with an ending for feminine or other names as the
word's own last letter tells. Words of other scripts permute within the letters of their Unicode block. Once a
text names a person, the words of that name are replaced wherever they stand in it.

A Spark job checks the distinct entities of the corpus: should two values of a kind meet, or a surrogate be
another value of the corpus, the next key is tried; of ``TRIES`` keys the one with the fewest such values stays
(none that meet; of small sets, like given names or a block of numbers, some are always in the corpus).
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.lean import lean
from strandline.llm.store import store

#: Keys that are tried.
TRIES = 4
#: Characters of a value that are read as one number, and of a word that is spelt in syllables.
CHUNK, LONGEST_NAME = 64, 32

# Given names by script and gender, and titles by gender.
GIVEN = {
    ("latin", "f"): "Anna Alice Barbara Carmen Charlotte Claire Elena Emily Emma Eva Grace Hannah Isabel Jane Julia Laura Linda Lucia Maria Marie Mary Nina Olivia Paula Rosa Sarah Sofia Susan".split(),
    ("latin", "m"): "Alexander Andrew Antonio Carlos Charles Daniel David Felix George Hans Henry Jack James Jean John Jorge Louis Luis Martin Max Michael Oliver Pablo Paul Peter Pierre Robert Thomas William".split(),
    ("cyrillic", "f"): "Анна Виктория Дарья Екатерина Елена Ирина Мария Наталья Ольга Светлана Татьяна Юлия".split(),
    ("cyrillic", "m"): "Александр Алексей Андрей Борис Виктор Дмитрий Иван Михаил Николай Олег Павел Сергей".split(),
}
TITLES = "Mr. Mrs. Ms. Mr Mrs Ms Miss Dr. Dr Prof. Herr Frau Señor Señora Sr. Sra. Monsieur Madame Mme".split()

#: The commonest Chinese surnames.
HAN_SURNAMES = "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧程曹袁邓许傅沈曾彭吕苏卢蒋蔡贾丁魏薛叶阎余潘杜戴夏钟汪田任姜范方石姚谭廖邹熊金陆郝孔白崔康毛邱秦江史顾侯邵孟龙万段钱汤尹黎易常武乔贺赖龚文"

_LISTED = {name: (names, names.index(name)) for names in GIVEN.values() for name in names}
_WORD = r"[^\W\d_]+(?:[-'’][^\W\d_]+)*"
_CAPITAL = rf"(?=[^\W\d_a-zß-öø-ÿа-я]){_WORD}"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_SOLID = re.compile(
    "|".join(
        [
            r"(?P<key>\bAKIA[0-9A-Z]{12,20}\b)",
            r"(?i:password|passwd|pwd|secret|token|api[_-]?key)\s*[=:]\s*[\"']?(?P<secret>[^\s\"',;]{6,})",
            r"(?P<hex>\b(?=[0-9a-fA-F]*\d)[0-9a-fA-F]{32,128}\b)",
            r"(?P<token>(?<![\w-])(?=[\w-]*\d)(?:gh[pousr]_|github_pat_|sk-|xox[abprs]-)[A-Za-z0-9_-]{16,}|(?<![\w-])eyJ[\w-]{8,}\.[\w-]{8,}(?:\.[\w-]+)?)",
            r"(?i:\bbearer)\s+(?P<bearer>[A-Za-z0-9._~+/=-]{16,})",
            r"(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b|\b[A-Za-z]{2}\d{2}(?: ?[A-Za-z]{4})?(?: ?\d{4}){3,7}(?: ?\d{1,3})?\b)",
            r"(?P<ip6>(?<![\w:.])(?=[0-9A-Fa-f:]*\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}|::(?:[0-9A-Fa-f]{1,4}:){0,5}[0-9A-Fa-f]{1,4})(?![\w:]))",
            rf"(?P<ip>(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d))",
            r"(?P<card>(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-]))",
            r"(?P<phone>(?<![\w(])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .-]\d{3,4}[ .-]\d{4}(?!\w)|(?<!\w)\+\d(?:[ .-]?\d){7,14}(?!\w)|(?<![\w(])0\d{1,4}[ /-]\d{5,9}(?!\w))",
            r"(?i:\b(?:tel|phone|mobile|cell|call|fax|telefon|mobil|teléfono|téléphone)\b)[.: ]{1,3}(?P<called>\d{9,12}(?!\w))",
            r"(?P<ssn>(?<!\w)\d{3}-\d{2}-\d{4}(?!\w))",
        ]
    )
)
_KIND_OF = {"bearer": "token", "called": "phone"}
_DOMAIN = re.compile(r"(?:[^\W_]|-){1,63}(?:\.(?:[^\W_]|-){1,63}){0,8}\.[^\W\d_]{2,63}")
_CAPITALS = re.compile(_CAPITAL)
_EITHER = sorted({*TITLES, *map(str.upper, TITLES)}, key=len, reverse=True)
_ANY_GIVEN = sorted({*_LISTED, *map(str.upper, _LISTED)}, key=len, reverse=True)
_TITLED = re.compile(rf"\b(?:{'|'.join(map(re.escape, _EITHER))})\s+(?P<person>{_CAPITAL}(?:[ ]{_CAPITAL}){{0,2}})")
_NAMED = re.compile(rf"\b(?P<person>(?:{'|'.join(_ANY_GIVEN)})[ ]{_CAPITAL})")
#: In small letters throughout: a surname behind a title that has no other use, a listed given name with its surname behind any.
_SMALL = re.compile(rf"\b(?:(?:mr|mrs|ms)\.|(?:dr|prof|sr|sra)\.(?=\s+(?:{'|'.join(sorted(map(str.lower, _LISTED), key=len, reverse=True))})\b))\s+(?P<person>(?:(?:{'|'.join(sorted(map(str.lower, _LISTED), key=len, reverse=True))})[ ])?[^\W\d_]+)")
#: What a text without digits needs, in folded case, for anything but names and addresses.
_TRIGGERS = ("akia", "password", "passwd", "pwd", "secret", "token", "api", "bearer", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "xox", "eyj", "sk-")
_CAPITAL_PAIR = re.compile("[A-ZА-Я]{2}")
#: The shortest titles, which all others begin with or hold.
_LEAST_TITLES = [t for t in _EITHER if not any(o != t and o in t for o in _EITHER)]
_UPPER_GIVEN = [n.upper() for n in _LISTED]
_DIGIT = re.compile(r"\d")


def _mails(text: str):
    """From each at sign, forwards to the end of a domain and back over what a local part has: to another at sign at most."""
    at, end = text.find("@"), 0
    while at >= 0:
        if domain := _DOMAIN.match(text, at + 1):
            first = at
            while first > end and (text[first - 1].isalnum() or text[first - 1] in "_.%+-"):
                first -= 1
            if first < at:
                end = domain.end()
                yield first, end, "email"
        at = text.find("@", at + 1)


def _people(text: str):
    """Persons by title or given name, then every other place of a word of their names."""
    found = [(*m.span("person"), "person") for m in _TITLED.finditer(text)] if any(map(text.__contains__, _LEAST_TITLES)) else []
    if any(map(text.__contains__, _LISTED)) or _CAPITAL_PAIR.search(text) and any(map(text.__contains__, _UPPER_GIVEN)):
        found += [(*m.span("person"), "person") for m in _NAMED.finditer(text)]
    small = [(*m.span("person"), "person") for m in _SMALL.finditer(text)] if any(t in text for t in ("mr.", "mrs.", "ms.", "dr.", "prof.", "sr.", "sra.")) else []
    found = [(a, b - 2, kind) if text[b - 2 : b] in ("'s", "’s") and b - 2 > a else (a, b, kind) for a, b, kind in found]
    names = {w for a, b, _ in found for w in text[a:b].split(" ") if len(w) > 1 or w and not w.isascii()}
    names |= {w.capitalize() for w in names if len(w) > 1 and w.isupper()} | {w.capitalize() for a, b, _ in small for w in text[a:b].split(" ") if len(w) > 1}
    names |= {w.upper() for w in names}
    found += small
    if names:
        for m in _CAPITALS.finditer(text):
            word = m.group().removesuffix("'s").removesuffix("’s")
            if word in names:
                found.append((m.start(), m.start() + len(word), "person"))
    return found


def spans(text: str) -> list[tuple[int, int, str]]:
    """Start, end and kind of the entities of a text, in order, without overlaps: of two, the one that starts first, then the longer."""
    found = [*_mails(text)] if "@" in text else []
    if _DIGIT.search(text) or any(map(text.casefold().__contains__, _TRIGGERS)):
        found += [(*m.span(m.lastgroup), _KIND_OF.get(m.lastgroup, m.lastgroup)) for m in _SOLID.finditer(text)]
    found += _people(text)
    out, end = [], 0
    for a, b, kind in sorted(found, key=lambda x: (x[0], -x[1])):
        if a >= end:
            out.append((a, b, kind))
            end = b
    return out


def _both(alphabet: str) -> list[str]:
    return [alphabet, alphabet.upper()]


_DIGITS, _HEX = ["0123456789"], ["0123456789abcdef"]
#: For hex with an upper-case letter: letters stay letters of their case, so no value meets one in lower case.
_HEX_CASED = [*_DIGITS, *_both("abcdef")]
_LETTERS = [*_DIGITS, *_both("abcdefghijklmnopqrstuvwxyz"), *_both("абвгдежзийклмнопрстуфхцчшщъыьэюя")]


class Syllables:
    """Names spelt in syllables of one script: no two numbers and no two endings give one name.

    A syllable is an onset, a vowel and perhaps a closing consonant. No onset of two letters starts with a
    closing consonant, so a name can be read back in one way only. With ``marks`` the first vowel has an accent.
    """

    def __init__(self, letters: str, onsets: str, vowels: str, closing: str, endings: tuple[str, str], feminine: str, marks: str = ""):
        self.letters, self.vowels, self.endings, self.feminine, self.marks = "".join(sorted(letters)), vowels, endings, feminine, marks
        self.place = {c: k for k, c in enumerate(self.letters)}
        self.syllables = [a + b + c for a in onsets.split() for b in vowels for c in ("", *closing)]

    def name(self, word: str, key: bytes, tweak: str) -> str:
        number = 0  # of the word among all words of these letters, shorter ones first
        for c in word:
            number = number * len(self.letters) + self.place[c] + 1
        number, count, room = number - 1, 2, len(self.syllables) ** 2
        while number >= room:
            number, room, count = number - room, room * len(self.syllables), count + 1
        number = Permutation(key, f"{tweak}\1{self.letters}{count}", room).step(number)
        out = []
        for _ in range(count):
            number, k = divmod(number, len(self.syllables))
            out.append(self.syllables[k])
        new = "".join(reversed(out)) + self.endings[not word.endswith(tuple(self.feminine))]
        if self.marks:
            at = next(i for i, c in enumerate(new) if c in self.vowels)
            new = new[:at] + self.marks[self.vowels.index(new[at])] + new[at + 1 :]
        return new


_PLAIN = "abcdefghijklmnopqrstuvwxyz"
_MARKED = "".join(chr(c) for c in (*range(0xDF, 0xF7), *range(0xF8, 0x180)) if chr(c).islower() and len(chr(c).upper()) == 1 and chr(c).upper().lower() == chr(c)) + "ß"
_CYRILLIC = "".join(map(chr, range(0x430, 0x460)))
_GREEK = "".join(chr(c) for c in range(0x3AC, 0x3CF))
_ONSETS = "b c d f g h j k l m n p r s t v w z br dr gr kr pr tr bl fl kl st"
SCRIPTS = (
    Syllables(_PLAIN, _ONSETS, "aeiou", "lmnr", ("na", "der"), "a"),
    Syllables(_PLAIN + _MARKED, _ONSETS, "aeiou", "lmnr", ("na", "der"), "aá", "áéíóú"),
    Syllables(_CYRILLIC, "б в г д ж з к л м н п р с т ф х ч ш бр др гр кр пр тр бл кл ст", "аеиоу", "лмнр", ("ова", "ов"), "ая"),
    Syllables(_GREEK, "β γ δ ζ θ κ λ μ ν π ρ σ τ φ χ δρ γρ κρ πρ τρ θρ στ", "αειου", "λμνρ", ("ιδου", "ιδης"), "αηάή", "άέίόύ"),
)


class Permutation:
    """Steps along a keyed cycle through ``0 .. n - 1``: a Feistel network, walked until it stays in range."""

    ROUNDS = 8

    def __init__(self, key: bytes, tweak: str, n: int):
        self.n, self.half = n, max(1, ((n - 1).bit_length() + 1) // 2)
        self.mask = (1 << self.half) - 1
        self.hash = hashlib.blake2b(tweak.encode(), key=key, digest_size=max(8, (self.half + 7) // 8) if self.half <= 512 else 64)

    def _f(self, r: int, x: int) -> int:
        h = self.hash.copy()
        h.update(bytes([r]) + x.to_bytes((self.half + 7) // 8, "big"))
        out = h.digest()
        while len(out) * 8 < self.half:
            out += hashlib.blake2b(out).digest()
        return int.from_bytes(out, "big") & self.mask

    def _there(self, x: int) -> int:
        a, b = x >> self.half, x & self.mask
        for r in range(self.ROUNDS):
            a, b = b, a ^ self._f(r, b)
        return a << self.half | b

    def _back(self, x: int) -> int:
        a, b = x >> self.half, x & self.mask
        for r in reversed(range(self.ROUNDS)):
            a, b = b ^ self._f(r, a), a
        return a << self.half | b

    def step(self, x: int) -> int:
        """The value after ``x`` on the cycle; never ``x`` itself if there is another."""
        y = self._back(x)
        while y >= self.n:
            y = self._back(y)
        y = self._there((y + 1) % self.n)
        while y >= self.n:
            y = self._there(y)
        return y


def permuted(value: str, alphabets: list[str], key: bytes, tweak: str) -> str:
    """``value`` with each character replaced within its alphabet; others stay and belong to the tweak.

    Longer values go ``CHUNK`` characters at a time, each under a tweak that knows all before it.
    """
    if len(value) > CHUNK:
        before, out = hashlib.blake2b(tweak.encode(), key=key), []
        for k in range(0, len(value), CHUNK):
            out.append(permuted(value[k : k + CHUNK], alphabets, key, f"{tweak}\3{before.hexdigest()}"))
            before.update(value[k : k + CHUNK].encode("utf-8", "surrogatepass"))
        return "".join(out)
    places = [next(((a, a.index(c)) for a in alphabets if c in a), None) for c in value]
    if not any(places):
        return value
    number, n = 0, 1
    for p in places:
        if p:
            number, n = number * len(p[0]) + p[1], n * len(p[0])
    shape = "".join("\0" + p[0][0] if p else c for c, p in zip(value, places))
    number = Permutation(key, f"{tweak}\1{shape}", n).step(number)
    out = []
    for c, p in zip(reversed(value), reversed(places)):
        if p:
            number, k = divmod(number, len(p[0]))
            c = p[0][k]
        out.append(c)
    return "".join(reversed(out))


def _luhn(digits: str) -> int:
    """Check digit for the digits before it."""
    total = sum(sum(divmod(int(d) * (2 - i % 2), 10)) for i, d in enumerate(reversed(digits)))
    return -total % 10


_BLOCKS: dict[tuple[int, str], str] = {}


def _block(c: str) -> str:
    """The letters of a character's category in its Unicode block of 256 places; of all Chinese ones that aren't listed surnames, or all Korean ones."""
    at = ord(c)
    first, last = (0x4E00, 0xA000) if 0x4E00 <= at < 0xA000 else (0xAC00, 0xD7A4) if 0xAC00 <= at < 0xD7A4 else (at & ~255, (at & ~255) + 256)
    kind = unicodedata.category(c)
    if (first, kind) not in _BLOCKS:
        _BLOCKS[first, kind] = "".join(x for x in map(chr, range(first, last)) if unicodedata.category(x) == kind and x not in HAN_SURNAMES)
    return _BLOCKS[first, kind]


def _cased(new: str, old: str) -> str:
    """``new`` in the case of ``old``: small, capitalised, capitals, or with a second capital inside."""
    if old == old.lower():
        return new
    if old == old.upper() and len(old) > 1:
        return new.upper()
    new, inner = new.capitalize(), next((i for i, c in enumerate(old[1:-1], 1) if c.isupper()), 0)
    return new[:inner] + new[inner].upper() + new[inner + 1 :] if 0 < inner < len(new) else new


def _person(word: str, key: bytes) -> str:
    low = word.lower()
    if word in (low, low.upper(), low.capitalize()) and low.capitalize() in _LISTED:
        names, at = _LISTED[low.capitalize()]
        return _cased(names[Permutation(key, "given\1" + names[0], len(names)).step(at)].lower(), word)
    if len(word) == 1 and word.isascii():
        return permuted(word, _LETTERS, key, "initial")
    for script in SCRIPTS if len(low) <= LONGEST_NAME else ():
        if all(c in script.place for c in low):
            # A case that isn't one of the usual three is part of the word.
            usual = word in (low, low.upper(), low.capitalize())
            return _cased(script.name(low, key, "name" if usual else "name" + "".join("ul"[c.islower()] for c in word)), word)
    alphabets = [HAN_SURNAMES, *dict.fromkeys(_block(c) for c in word if c.isalpha() and c not in HAN_SURNAMES)]
    return permuted(word, alphabets, key, "name")


def surrogate(kind: str, value: str, key: bytes) -> str:
    """The replacement of one entity."""
    if kind == "email":
        local, _, domain = value.rpartition("@")
        labels = domain.split(".")
        keep = 2 if labels[-2].lower() == "example" else 1
        labels = [permuted(x, _LETTERS, key, "domain") for x in labels[:-keep]] + labels[-keep:]
        return permuted(local, _LETTERS, key, "email") + "@" + ".".join(labels)
    if kind == "ip":
        number = 0
        for octet in value.split("."):
            number = number << 8 | int(octet)
        number = Permutation(key, "ip", 1 << 32).step(number)
        return ".".join(str(number >> s & 255) for s in (24, 16, 8, 0))
    if kind == "card":
        digits = re.sub(r"\D", "", value)
        body = digits[0] + permuted(digits[1:-1], _DIGITS, key, "card" + digits[0])
        offset = (int(digits[-1]) - _luhn(digits[:-1])) % 10
        new = iter(body + str((_luhn(body) + offset) % 10))
        return "".join(next(new) if c.isdigit() else c for c in value)
    if kind == "phone":
        m = re.match(r"\+\d{1,3}(?=[ .(-])|0(?=\d)", value)  # a country's prefix, or the zero before an area
        head = m.group() if m else ""
        parts = re.split(r"(?<!\d)(555)(?!\d)", value[len(head) :])
        fixed = "555" if len(parts) == 3 else ""
        number = permuted("\2".join((parts[0], parts[2])) if fixed else value[len(head) :], _DIGITS, key, "phone" + head + fixed)
        return head + number.replace("\2", "555")
    if kind == "ip6":
        return permuted(value, _HEX_CASED if re.search("[A-F]", value) else _HEX, key, kind)
    if kind == "token":
        head = re.match(r"gh[pousr]_|github_pat_|sk-|xox[abprs]-|eyJ|", value).group()
        return head + permuted(value[len(head) :], _LETTERS, key, kind + head)
    if kind == "key":
        return value[:4] + permuted(value[4:], _LETTERS, key, kind)
    if kind == "person":
        return "".join(_person(w, key) if w[0].isalpha() else w for w in re.split(r"([ '’-])", value) if w)
    if kind in ("secret", "hex") and re.fullmatch(r"[0-9a-fA-F]+", value):
        return permuted(value, _HEX_CASED if re.search("[A-F]", value) else _HEX, key, kind)
    out = permuted(value, _LETTERS, key, kind)
    while kind == "secret" and re.fullmatch(r"[0-9a-fA-F]+", out) and out != value:  # stay among the secrets that aren't hex
        out = permuted(out, _LETTERS, key, kind)
    return out


def derived(key: str, version: int) -> bytes:
    return hashlib.blake2b(f"{version}\0{key}".encode(), digest_size=32).digest()


def _entities(at):
    def run(batches):
        for batch in batches:
            own = {(kind, t[a:b]) for t in batch.column(at).to_pylist() if t for a, b, kind in spans(t)}
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in own], pa.string()), pa.array([v for _, v in own], pa.string())], names=["kind", "value"])

    return run


def _surrogates(key, draw):
    def run(batches):
        for batch in batches:
            new = [draw(k, v, key) for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(new, pa.string())], names=["kind", "value", "surrogate"])

    return run


def entities(docs: DataFrame) -> DataFrame:
    """The distinct ``kind, value`` of all texts."""
    return docs.select("text").mapInArrow(lean(_entities(0)), "kind string, value string").distinct()


def collisions(found: DataFrame, key: bytes, draw=surrogate) -> tuple[int, int]:
    """Surrogates shared by several values of a kind, and surrogates that are a value of their kind in the corpus."""
    drawn = found.mapInArrow(lean(_surrogates(key, draw)), "kind string, value string, surrogate string")
    both = drawn.select("kind", F.col("surrogate").alias("x"), F.lit(1).alias("new")).unionByName(found.select("kind", F.col("value").alias("x"), F.lit(0).alias("new")))
    each = both.groupBy("kind", "x").agg(F.sum("new").alias("new"), F.count_if(F.col("new") == 0).alias("old"))
    return tuple(each.agg(F.count_if(F.col("new") > 1), F.count_if((F.col("new") > 0) & (F.col("old") > 0))).first())


def _replace(at, key, draw):
    def run(batches):
        known: dict[tuple[str, str], str] = {}
        for batch in batches:
            texts, counts = [], []
            for text in batch.column(at).to_pylist():
                found = spans(text) if text else []
                if found:
                    parts, end = [], 0
                    for a, b, kind in found:
                        value = text[a:b]
                        if (kind, value) not in known:
                            if len(known) > 100_000:
                                known.clear()
                            known[kind, value] = draw(kind, value, key)
                        parts += [text[end:a], known[kind, value]]
                        end = b
                    text = "".join(parts) + text[end:]
                texts.append(text)
                counts.append(len(found))
            columns = [c if i != at else pa.array(texts, pa.string()) for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64())], names=[*batch.schema.names, "n_entities"])

    return run


def chosen_version(found: DataFrame, key: str, draw=surrogate, tries: int = TRIES) -> int:
    """The first version of a key without a collision, or of ``tries`` the one with the fewest."""
    counts = []
    for version in range(tries):
        counts.append(collisions(found, derived(key, version), draw))
        if counts[-1] == (0, 0):
            break
    return min(range(len(counts)), key=counts.__getitem__)


def pseudonymised(docs: DataFrame, key: str, draw=surrogate) -> DataFrame:
    """``docs`` with surrogates in ``text`` and their number in ``n_entities`` (null text: null and 0).

    ``key`` is a secret of the caller. Of entities that overlap the one that starts first is taken, then the
    longer. A text of any length is searched as a whole, in time linear in its length. All other columns,
    whatever their names, pass through (an input column ``n_entities`` is replaced). Repeated rows give
    repeated results; equal values have one surrogate in all rows. An empty table gives no rows.
    """
    if not key:
        raise ValueError("surrogates need a key")
    version = chosen_version(store(entities(docs), "entities"), key, draw)
    docs = docs.drop("n_entities")
    schema = T.StructType([*docs.schema, T.StructField("n_entities", T.LongType())])
    return docs.mapInArrow(lean(_replace(docs.columns.index("text"), derived(key, version), draw)), schema)
