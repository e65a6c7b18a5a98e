"""Personal data and secrets, replaced by keyed surrogates of the same kind and format.

A surrogate is computed from the entity alone: its letters and digits form a number, each place with the signs of its
own script and kind, which a keyed permutation without fixed points maps to another number of the same form. So equal
entities get equal surrogates in all documents (coreference), different ones of a form never share one
(distinctness), separators, case, script and length stay (format), and no table of entities is needed. Check digits are
made to fit.

Addresses stay in their class (private, loopback, link-local, multicast), numbers in their country.

Names are found behind a title or a label, and next to one of the given names below. They get a given name of the title's
or name's gender and script and a made-up surname. These are drawn, not
permuted, so they are checked within the document: a surrogate that another name has taken, or that is itself
an original there, is drawn anew. Other mentions of the surname in the document follow, with the given names beside it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglens.llm.common import as_batch, bytes_of

# Alphabets, in which a sign is replaced by another one.
DIGITS, HEX = "0123456789", "0123456789abcdef"
ALPHABETS = (
    DIGITS,
    "abcdefghijklmnopqrstuvwxyz",
    "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿ",
    "абвгдежзийклмнопрстуфхцчшщъыьэюя",
    "αβγδεζηθικλμνξοπρστυφχψω",
)
OF = {c: a for a in ALPHABETS for c in a}

# Titles by gender (None: either), given names by script and gender, syllables of surnames by script.
TITLES = {
    "m": ("Mr", "Herr", "Monsieur", "Señor", "Господин", "Κύριος"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Señorita", "Госпожа", "Κυρία"),
    None: ("Dr", "Prof", "Professor"),
}
GENDER = {t: g for g, titles in TITLES.items() for t in titles}
GIVEN = {
    "latin": {
        "m": ("Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Hugo", "Ivan", "Jonas", "Karl", "Leon", "Martin", "Nico", "Oscar", "Paul", "Simon"),
        "f": ("Anna", "Berta", "Clara", "Diana", "Elena", "Flora", "Helena", "Irene", "Julia", "Klara", "Laura", "Maria", "Nora", "Olga", "Paula", "Sofia"),
    },
    "cyrillic": {
        "m": ("Антон", "Борис", "Виктор", "Денис", "Егор", "Иван", "Кирилл", "Максим"),
        "f": ("Анна", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Мария", "Ольга"),
    },
    "greek": {
        "m": ("Γιώργος", "Δημήτρης", "Κώστας", "Νίκος", "Πέτρος", "Σπύρος"),
        "f": ("Άννα", "Ελένη", "Ιωάννα", "Κατερίνα", "Μαρία", "Σοφία"),
    },
}
SYLLABLES = {
    "latin": ("bcdfghklmnprstvz", "aeiou"),
    "cyrillic": ("бвгдзклмнпрст", "аеиоу"),
    "greek": ("βγδζκλμνπρστ", "αειοη"),
}

# Labels of names, calling codes of two digits (1 and 7 have one digit, all others three).
NAME_LABELS = ("Name", "name", "Author", "author", "Signed", "signed", "Attn")
TWO_DIGITS = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
#: IPv4 networks within which an address stays: first bits of each, and how many. Any other address is public and stays so.
NETWORKS = tuple((int(first) << 24 | int(second) << 16, bits) for first, second, bits in ((0, 0, 8), (10, 0, 8), (100, 64, 10), (127, 0, 8), (169, 254, 16), (172, 16, 12), (192, 168, 16), (224, 0, 4), (240, 0, 4)))
#: The same of IPv6: link-local, unique local, multicast.
NETWORKS6 = re.compile(r"fe[89ab][0-9a-f]|f[cdf](?=[0-9a-f]{2})")

_title = "|".join(sorted(GENDER, key=len, reverse=True))
_upper = "A-ZÀ-ÖØ-ÞΆΈ-ΏΑ-ΫЀ-Я"
_name = rf"(?:[{_upper}]['’])?[{_upper}]\w+(?:[-'’][{_upper}]\w+)*"
GENDER_OF = {name: gender for names in GIVEN.values() for gender, own in names.items() for name in own}
_given = "|".join(sorted(GENDER_OF, key=len, reverse=True))
#: What may stand before a name, and a name without a title: given names first, or last behind a comma.
LEAD = re.compile(rf"(?:{_title})\b\.? |(?:{'|'.join(NAME_LABELS)})\s*[:=]\s*")
#: In this order: an earlier kind wins where several begin at the same place.
KINDS = {
    "email": r"(?<![\w.+-])[\w.+-]+@(?:[\w-]+\.)+[^\W\d_]{2,}",
    "secret": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b|\b(?:gh[pousr]_|sk-|xox[bp]-)[A-Za-z0-9-]{16,}|\beyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,}",
    "labelled": r"(?i:\b(?:api[_-]?key|secret|token|passw(?:or)?d|pwd|access[_-]?key|auth)\b[\"']?\s*[=:]\s*)[\"']?[\w+/.~-]{6,}={0,2}[\"']?",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "ipv6": r"(?i:(?<![\w:])(?:(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}|[0-9a-f]{3,4}(?::[0-9a-f]{1,4}){0,6}::(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){0,5})?)(?![\w:]))",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\w)|(?<![\w(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w.-]\d)"
    rf"|(?<![\w(])\(0\d{{1,4}}\)(?:[ -]?\d{{2,5}}){{2,4}}(?!\w)|(?i:(?<=\b(?:tel|fax))|(?<=\bcell)|(?<=\bcall)|(?<=\bphone)|(?<=\bmobile))(?:\.?:? ?)0\d{{6,13}}(?!\w)",
    "card": r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w])",
    "hash": r"(?i:(?<!\w)[0-9a-f]{32,}(?!\w))",
    "name": rf"\b(?:{_title})\b\.? {_name}(?: {_name}){{0,2}}|\b(?:{'|'.join(NAME_LABELS)})\s*[:=]\s*{_name}(?: {_name}){{1,2}}"
    rf"|\b(?:{_given}) {_name}\b|(?:(?m:^)|(?<=[;(|] )|(?<=[;(|])){_name}, (?:{_given})(?=\s*(?:[;)|\n]|\Z))",
}
ENTITY = re.compile("|".join(f"(?P<{k}>{p})" for k, p in KINDS.items()))
#: No entity is without a digit, an @, a title, a known given name, one of these labels or, in hexadecimal without digits, such a run.
SIGN = re.compile(r"[\d@]|::|(?i:[a-f]{32}|(?:[a-f]{1,4}:){7})")
LABELS = ("key", "secret", "token", "passw", "pwd", "auth", "akia", "asia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", "xox", "eyj", *dict.fromkeys(x.lower() for x in NAME_LABELS))
WORDS = (*GENDER, *GENDER_OF)


def may_hold(text: str) -> bool:
    """Whether the text has a sign without which there is no entity in it."""
    if SIGN.search(text) or any(t in text for t in WORDS):
        return True
    low = text.lower()
    return any(x in low for x in LABELS)


class Permutation:
    """Keyed permutations of 0 .. n - 1 without fixed points, one for each n and purpose."""

    def __init__(self, key: bytes, rounds: int = 8):
        self.key, self.rounds = key[:64], rounds

    def _f(self, r: int, x: int, tweak: bytes, size: int) -> int:
        h = hashlib.blake2b(tweak + b"\x00" + x.to_bytes((x.bit_length() + 8) // 8, "big"), key=self.key, salt=bytes([r]), digest_size=64)
        out = h.digest()
        while len(out) * 8 < size:
            out += hashlib.blake2b(out, key=self.key, digest_size=64).digest()
        return int.from_bytes(out, "big") & ((1 << size) - 1)

    def _walk(self, x: int, n: int, tweak: bytes, back: bool) -> int:
        """A Feistel network over twice half bits, repeated until the number is below n again."""
        half = ((n - 1).bit_length() + 1) // 2 or 1
        while True:
            a, b = x >> half, x & ((1 << half) - 1)
            for r in range(self.rounds):
                if back:
                    a, b = b ^ self._f(self.rounds - 1 - r, a, tweak, half), a
                else:
                    a, b = b, a ^ self._f(r, b, tweak, half)
            x = a << half | b
            if x < n:
                return x

    def __call__(self, x: int, n: int, tweak: bytes) -> int:
        """The number before whose place in a keyed order is one behind x's place: never x itself, if n > 1."""
        return self._walk((self._walk(x, n, tweak, False) + 1) % n, n, tweak, True)


def permuted(text: str, p: Permutation, kind: str, alphabet: str | None = None) -> str:
    """text with all its letters and digits replaced, each by one of the same alphabet, jointly."""
    low = text.lower() if len(text.lower()) == len(text) else text
    own = [(i, a) for i, c in enumerate(low) if (a := (alphabet if alphabet and c in alphabet else OF.get(c)))]
    n, x = 1, 0
    for i, a in own:
        x, n = x * len(a) + a.index(low[i]), n * len(a)
    form = "".join(f"{len(a)}." for _, a in own).encode()
    y, out = p(x, n, kind.encode() + form), list(low)
    for i, a in reversed(own):
        y, k = divmod(y, len(a))
        out[i] = a[k].upper() if not alphabet and text[i] != low[i] and len(a[k].upper()) == 1 else a[k]
    made = "".join(out)
    return made.upper() if alphabet and text.isupper() else made


def _refill(shape: str, digits: str) -> str:
    """shape with its digits replaced one by one."""
    it = iter(digits)
    return "".join(next(it) if c in DIGITS else c for c in shape)


def luhn(digits: str) -> int:
    """The check digit that belongs behind digits."""
    total = sum(sum(divmod(int(c) * (2 - i % 2), 10)) for i, c in enumerate(reversed(digits)))
    return -total % 10


def _digits(text: str) -> str:
    return "".join(c for c in text if c in DIGITS)


def _card(text: str, p: Permutation) -> str:
    """The first digit stays; the last is as far from the right check digit as it was."""
    d = _digits(text)
    body = d[0] + permuted(d[1:-1], p, "card")
    return _refill(text, body + str((luhn(body) + int(d[-1]) - luhn(d[:-1])) % 10))


def _network(x: int) -> tuple[int, int] | None:
    return next(((first, bits) for first, bits in NETWORKS if x >> (32 - bits) == first >> (32 - bits)), None)


def _ip(text: str, p: Permutation) -> str:
    """Another address of the same network, or another public one."""
    x = 0
    for part in text.split("."):
        x = x << 8 | int(part)
    if own := _network(x):
        first, bits = own
        n = 1 << (32 - bits)
        y = first | p(x & (n - 1), n, b"ip%d" % first)
    else:
        y = p(x, 1 << 32, b"ip")
        while _network(y):
            y = p(y, 1 << 32, b"ip")
    return ".".join(str(y >> s & 255) for s in (24, 16, 8, 0))


def _ipv6(text: str, p: Permutation) -> str:
    own = NETWORKS6.match(text.lower())
    keep = own.end() if own else 0
    made = permuted(text[keep:], p, f"ipv6{text[:keep].lower()}", HEX)
    while not own and NETWORKS6.match(made.lower()):
        made = permuted(made, p, "ipv6", HEX)
    return text[:keep] + made


def _phone(text: str, p: Permutation) -> str:
    """The country code stays, or the 0 before a number of the country itself; other numbers don't get one."""
    d = _digits(text)
    if text[0] == "+":
        keep = 1 if d[0] in "17" else 2 if d[:2] in TWO_DIGITS else 3
    else:
        keep = int(d[0] == "0")
    made = permuted(d[keep:], p, "phone")
    while not keep and made[0] == "0":
        made = permuted(made, p, "phone")
    return _refill(text, d[:keep] + made)


def _iban(text: str, p: Permutation) -> str:
    """The country stays, the check digits are made anew and off by as much as they were."""

    def check(country: str, account: str) -> int:
        return 98 - int("".join(str(int(c, 36)) for c in account + country + "00")) % 97

    flat = text.replace(" ", "")
    account = permuted(flat[4:], p, "iban")
    off = (int(flat[2:4]) - check(flat[:2], flat[4:])) % 100
    new = iter(flat[:2] + f"{(check(flat[:2], account) + off) % 100:02d}" + account)
    return "".join(c if c == " " else next(new) for c in text)


def _email(text: str, p: Permutation) -> str:
    local, _, domain = text.rpartition("@")
    rest, _, top = domain.rpartition(".")
    local, rest = local.lower(), rest.lower()  # mail addresses differ by more than case
    return f"{permuted(f'{local}@{rest}', p, f'email.{top.lower()}')}.{top}"


def _secret(text: str, p: Permutation) -> str:
    prefix = re.match(r"AKIA|ASIA|gh[pousr]_|sk-|xox[bp]-|eyJ", text)
    keep = prefix.end() if prefix else 0
    return text[:keep] + permuted(text[keep:], p, "secret")


def _labelled(text: str, p: Permutation) -> str:
    m = re.fullmatch(r"(.*?[=:]\s*[\"']?)(.*?)([\"']?)", text, re.S)
    value = m[2]
    kind = "secret"
    alphabet = HEX if len(value) >= 16 and not set(value.lower()) - set(HEX) else None
    return m[1] + permuted(value, p, kind, alphabet) + m[3]


def script_of(word: str) -> str:
    c = next((c for c in word.lower() if c.isalpha()), "a")
    return "cyrillic" if "Ѐ" <= c <= "ӿ" else "greek" if "Ͱ" <= c <= "Ͽ" or "ἀ" <= c <= "῿" else "latin"


def _parts(name: str) -> tuple[str, list[str], str, bool]:
    """What stands before a name, its given names, its surname, and whether the surname comes first."""
    lead = LEAD.match(name)
    head = lead[0] if lead else ""
    last, comma, first = name[len(head) :].partition(", ")
    if comma:
        return head, [first], last, True
    *first, last = last.split(" ")
    return head, first, last, False


class Surrogates:
    """Replaces the entities of texts under one key."""

    PLAIN = {
        "email": _email,
        "secret": _secret,
        "labelled": _labelled,
        "iban": _iban,
        "ssn": lambda t, p: permuted(t, p, "ssn"),
        "ipv6": _ipv6,
        "ip": _ip,
        "phone": _phone,
        "card": _card,
        "hash": lambda t, p: permuted(t, p, "secret", HEX),
    }

    def __init__(self, key: bytes):
        self.key, self.p = key, Permutation(key)

    def _draw(self, what: str, n: int) -> int:
        return int.from_bytes(hashlib.blake2b(what.encode(), key=self.key[:64], digest_size=8).digest(), "big") % n

    def _surname(self, word: str, attempt: int) -> str:
        a, b = SYLLABLES[script_of(word)]
        x = self._draw(f"surname\0{word.lower()}\0{attempt}", (len(a) * len(b)) ** 4)
        out = ""
        for _ in range(4):
            x, i = divmod(x, len(a) * len(b))
            out += a[i // len(b)] + b[i % len(b)]
        return out.upper() if word.isupper() else out.capitalize()

    def _given(self, word: str, gender: str | None, attempt: int) -> str:
        names = GIVEN[script_of(word)]
        pool = names[gender] if gender else names["m"] + names["f"]
        out = pool[self._draw(f"given\0{word.lower()}\0{attempt}", len(pool))]
        return out.upper() if word.isupper() else out

    def names(self, found: list[str]) -> dict[str, str]:
        """Surrogates of a document's names (title and all), and of its surnames alone: distinct, and none an original."""
        full, surnames, _ = self.people(found)
        return full | surnames

    def people(self, found: list[str]) -> tuple[dict[str, str], dict[str, str], dict[str, str]]:
        """The same for names as they were found, surnames and given names."""
        split = {x: _parts(x) for x in found}
        given: dict[str, str | None] = {}
        for lead, first, _, _ in split.values():
            for w in first:
                given[w] = given.get(w) or GENDER.get(lead.rstrip(". ")) or GENDER_OF.get(w)
        surnames = {last for _, _, last, _ in split.values()}
        originals, taken, new_last, new_first = {x.lower() for x in (*surnames, *given)}, set(), {}, {}
        for w in sorted(surnames):
            attempt = 0
            while (s := self._surname(w, attempt)).lower() in taken | originals:
                attempt += 1
            taken.add(s.lower())
            new_last[w] = s
        for w in sorted(given):
            # Given names are few: one that is taken is drawn anew while any is free, then made of syllables.
            for attempt in range(200):
                s = self._given(w, given[w], attempt)
                if s.lower() not in taken | originals:
                    break
            else:  # the pool is used up
                attempt = 0
                while (s := self._surname(f"{w} ", attempt)).lower() in taken | originals:
                    attempt += 1
            taken.add(s.lower())
            new_first[w] = s
        full = {}
        for x, (lead, first, last, turned) in split.items():
            own = [new_first[w] for w in first]
            full[x] = lead + (f"{new_last[last]}, {own[0]}" if turned else " ".join([*own, new_last[last]]))
        return full, new_last, new_first

    def __call__(self, text: str) -> tuple[str, list[str]]:
        """The text with surrogates, and the kinds of the entities found, in their order."""
        if not may_hold(text):
            return text, []
        found = [m for m in ENTITY.finditer(text) if self._is(m)]
        if not found:
            return text, []
        full = [m[0] for m in found if m.lastgroup == "name"]
        names, surnames, given = self.people(full) if full else ({}, {}, {})
        follow = self._follower(surnames, given)
        out, at = [], 0
        for m in found:
            out.append(follow(text[at : m.start()]))
            out.append(names[m[0]] if m.lastgroup == "name" else self.PLAIN[m.lastgroup](m[0], self.p))
            at = m.end()
        out.append(follow(text[at:]))
        return "".join(out), [m.lastgroup for m in found]

    @staticmethod
    def _is(m: re.Match) -> bool:
        if m.lastgroup == "labelled":
            return any(c in DIGITS for c in m[0]) or m[0][-1] in "\"'"
        if m.lastgroup == "ipv6" and "::" in m[0]:  # at most seven groups, and not a name in code
            groups = sum(map(bool, m[0].split(":")))
            return groups <= 7 and (groups > 2 or any(c in DIGITS for c in m[0]))
        return m.lastgroup != "phone" or 7 <= len(_digits(m[0])) <= 15

    @staticmethod
    def _follower(surnames: dict[str, str], given: dict[str, str]) -> Callable[[str], str]:
        """Replaces mentions of surnames outside the names found, and given names beside them."""
        alone = [w for w in surnames if len(w) > 2]
        if not alone:
            return lambda text: text

        def one_of(words) -> str:
            return "|".join(map(re.escape, sorted(words, key=len, reverse=True)))

        last = one_of(alone)
        first = one_of(given) or r"(?!)"
        mention = re.compile(rf"\b((?:(?:{first}) )*)({last})\b(?:, ({first})\b)?")

        def written(m: re.Match) -> str:
            before = "".join(f"{given[w]} " for w in m[1].split())
            return before + surnames[m[2]] + (f", {given[m[3]]}" if m[3] else "")

        return lambda text: mention.sub(written, text)


def with_surrogates(docs: DataFrame, key: bytes, counted: str | None = None) -> DataFrame:
    """docs with surrogates in text; n_chars, if there, follows; counted names a column for the kinds found.

    Null texts stay null, texts without entities stay as they are, rows are neither added nor dropped. Equal texts
    become equal texts.
    """
    names = [c for c in docs.columns if c != counted]
    inner = docs.select(*[F.col(f"`{c}`") for c in names]).toDF(*[f"_c{i}" for i in range(len(names))])
    text, n_chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None
    kind = inner.schema[n_chars].dataType.simpleString() if n_chars is not None else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replace = Surrogates(key)
        for batch in batches:
            found = [(None, []) if x is None else replace(x) for x in batch.column(text).to_pylist()]
            columns = list(batch.columns)
            columns[text] = pa.array([x for x, _ in found], pa.string())
            if n_chars is not None and kind in ("int", "bigint"):
                size = pa.array([None if x is None else len(x) for x, _ in found], columns[n_chars].type)
                columns[n_chars] = size
            own = {f"_c{i}": c for i, c in enumerate(columns)}
            yield as_batch(own | ({"_kinds": pa.array([k for _, k in found], pa.list_(pa.string()))} if counted else {}))

    fields = [f"_c{i} {inner.schema[f'_c{i}'].dataType.simpleString()}" for i in range(len(names))]
    out = inner.mapInArrow(run, ", ".join(fields + ["_kinds array<string>"] * bool(counted)))
    return out.toDF(*names, *[counted] * bool(counted))


def entities(docs: DataFrame) -> DataFrame:
    """(kind, entity) of everything that is replaced, one row per mention."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_entity = Surrogates._is
        for batch in batches:
            own = [m for x in bytes_of(batch.column("text")) for m in ENTITY.finditer(x.decode(errors="replace")) if is_entity(m)]
            yield as_batch({"kind": pa.array([m.lastgroup for m in own], pa.string()), "entity": pa.array([m[0] for m in own], pa.string())})

    return docs.select("text").mapInArrow(run, "kind string, entity string")


def collisions(docs: DataFrame, key: bytes) -> DataFrame:
    """(kind, surrogate, n): surrogates that several different entities of one kind share, over all documents.

    Only names and mail addresses that differ by case can be among them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replace = Surrogates(key)
        for batch in batches:
            kinds, own = batch.column("kind").to_pylist(), batch.column("entity").to_pylist()
            made = [replace.names([x])[x] if k == "name" else replace.PLAIN[k](x, replace.p) for k, x in zip(kinds, own, strict=True)]
            yield as_batch({"kind": batch.column("kind"), "surrogate": pa.array(made, pa.string())})

    made = entities(docs).distinct().mapInArrow(run, "kind string, surrogate string")
    return made.groupBy("kind", "surrogate").agg(F.count("*").alias("n")).where("n > 1")
