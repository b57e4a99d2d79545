"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors (at-signs, plus signs, digits, schemes and cue words, whatever
their case) in one pass over a text. A local parser at each anchor expands to the boundaries of the item
there and validates it. Kinds: email, ip, card (Luhn), phone, and beyond them account (IBAN of its
country's length with right check digits; after a cue, of any country), address (English: number, names,
kind of street; French: number, kind of street, names; German and Spanish: street, number), login
(scheme with user and password), secret (cue, sign, long value with digits) and ssn (after a cue in its
line).

Spans are code points, end exclusive, without overlaps within a kind. A null or empty text has none.
No parser scans a run of characters twice for two anchors that end alike, so a text takes time in
proportion to its length. Rows are handled one by one; other columns pass through untouched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lowered, text_chunks

BASE_KINDS = ["email", "ip", "card", "phone"]
KINDS = [*BASE_KINDS, "account", "address", "login", "secret", "ssn"]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
SECRET_CUES = ["api_key", "apikey", "api-key", "access_key", "auth_token", "token", "secret", "password", "passwd"]
ACCOUNT_CUES = ["iban"]
SSN_CUES = ["ssn", "social security"]

# Kinds of street, by where the number and the names stand.
STREET_LAST = "Street St Avenue Ave Boulevard Blvd Road Rd Lane Ln Drive Dr Court Ct Square Sq Terrace Crescent Parkway Highway".split()
SHORT = frozenset(["St", "Ave", "Blvd", "Rd", "Ln", "Dr", "Ct", "Sq"])
STREET_JOINED = "straße strasse str. weg platz allee gasse ufer damm".split()
STREET_MIDDLE = "rue avenue boulevard place chemin allée quai impasse cours".split()
STREET_FIRST = "Calle Avenida Plaza Paseo Camino Carrera Travesía".split()

# Lengths of international bank account numbers.
ACCOUNT_LENGTHS = {
    "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IL": 23,
    "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26, "AE": 23, "BR": 29, "SA": 24,
}

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP_RUN, CHAIN, PART = re.compile(r"[0-9.]+"), re.compile(r"[0-9]+(?:\.[0-9]+)*"), re.compile(r"[0-9]+")
CARD_RUN, CARD = re.compile(r"[0-9 -]+"), re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
SECRET = re.compile(r"[\"']?\s{0,3}[=:]\s{0,3}[\"']?([A-Za-z0-9_+/.-]{12,}={0,2})")
ACCOUNT = re.compile(r"\W{0,4}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})")
SSN = re.compile(r"([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])")
LOGIN = re.compile(r"://[^\s/:@]+:[^\s/@]+@[A-Za-z0-9.-]+")
NUMBER = r"[0-9]+(?: ?(?:[a-zA-Z]|bis|ter)\b)?(?:[-/][0-9]+[a-zA-Z]?)?"
BEHIND = re.compile(rf"\s?,?\s?{NUMBER}(?![0-9])")  # Hauptstraße 12b
NAMES = re.compile(r"(?: (?:de|del|d[eu]s?|la|las|le|les|los|el|et|y|(?:[ld]['’])?[A-ZÀ-Ý][\w'’.-]*))+")
TAIL = re.compile(rf",? (?:n\.?[ºo°] ?)?{NUMBER}(?![0-9])")  # Calle Mayor, 15
SCHEME = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+.-0123456789")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def check_digits(account: str) -> bool:
    turned = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def small(part: str) -> bool:
    """At most 255, without converting a long run."""
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


_made: list[ahocorasick.Automaton] = []


def automaton() -> ahocorasick.Automaton:
    if not _made:
        found = ahocorasick.Automaton()
        cues = {"@": {"at"}, "+": {"plus"}, "://": {"login"}} | {d: {"digit"} for d in "0123456789"}
        for kind, words in (("secret", SECRET_CUES), ("account", ACCOUNT_CUES), ("ssn", SSN_CUES)):
            for word in words:
                cues.setdefault(word, set()).add(kind)
        streets = [("last", f" {w}") for w in STREET_LAST] + [("joined", w) for w in STREET_JOINED] + [("middle", f" {w} ") for w in STREET_MIDDLE] + [("first", f"{w} ") for w in STREET_FIRST]
        for kind, word in streets:
            cues.setdefault(lowered(word), set()).add(kind)
        for cue, kinds in cues.items():
            found.add_word(cue, (sorted(kinds), len(cue)))
        found.make_automaton()
        _made.append(found)
    return _made[0]


class Spans:
    """What the parsers have found in one text, and how far each has read."""

    def __init__(self, text: str):
        self.text = text
        self.found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
        self.over = dict.fromkeys(KINDS, 0)  # what a kind has consumed
        self.ip_end = self.card_end = self.number_end = 0
        self.ssn_cue: int | None = None
        self.dead = 0  # no address begins with a number before this
        self.named = 0  # names up to here have been read after a kind of street

    def take(self, kind: str, start: int, end: int) -> None:
        if start >= self.over[kind]:
            self.found[kind].append((start, end))
            self.over[kind] = end

    def digit(self, start: int, end: int) -> None:
        text = self.text
        if start >= self.ip_end:
            self.ip_end = IP_RUN.match(text, start).end()
            for chain in CHAIN.finditer(text, start, self.ip_end) if self.ip_end - start >= 7 else ():
                parts = [m.span() for m in PART.finditer(text, *chain.span())]
                for k in range(0, len(parts) - 3, 4):
                    if all(small(text[a:b]) for a, b in parts[k : k + 4]):
                        self.take("ip", parts[k][0], parts[k + 3][1])
        if start >= self.card_end:
            self.card_end = CARD_RUN.match(text, start).end()
            for m in CARD.finditer(text, start, self.card_end) if self.card_end - start >= 16 else ():
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    self.take("card", *m.span())
        if start >= self.number_end:  # the first digit of a run
            self.number_end = PART.match(text, start).end()
            if self.ssn_cue is not None:
                near = "\n" not in text[self.ssn_cue : start]
                if near and (m := SSN.match(text, start)) and m[1][:3] not in ("000", "666") and m[1] < "900":
                    self.take("ssn", *m.span(1))
                self.ssn_cue = None
            if text[max(start - 2, 0) : start] in ACCOUNT_LENGTHS and not text[max(start - 3, 0) : start - 2].isalnum():
                self.listed_account(start - 2)

    def listed_account(self, start: int) -> None:
        """An account number of the length its country uses, in groups or not."""
        text, left, at = self.text, ACCOUNT_LENGTHS[self.text[start : start + 2]], start
        while left and at < len(text):
            c = text[at]
            if c.isascii() and (c.isdigit() or c.isupper()):
                left -= 1
            elif c != " " or text[at - 1] == " ":
                return
            at += 1
        if not left and not text[at : at + 1].isalnum() and check_digits(text[start:at].replace(" ", "")):
            self.take("account", start, at)

    def plus(self, start: int, end: int) -> None:
        if (m := PHONE.match(self.text, start)) and 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            self.take("phone", *m.span())

    def at(self, start: int, end: int) -> None:
        begin = start
        while begin > self.over["email"] and self.text[begin - 1] in LOCAL:
            begin -= 1
        if begin < start and (m := DOMAIN.match(self.text, end)):
            self.take("email", begin, m.end())

    def secret(self, start: int, end: int) -> None:
        if (m := SECRET.match(self.text, end)) and any(c.isdigit() for c in m[1]):
            self.take("secret", *m.span(1))

    def account(self, start: int, end: int) -> None:
        if (m := ACCOUNT.match(self.text, end)) and m[1][:2] not in ACCOUNT_LENGTHS and check_digits(m[1].replace(" ", "")):
            self.take("account", *m.span(1))

    def ssn(self, start: int, end: int) -> None:
        self.ssn_cue = end

    def login(self, start: int, end: int) -> None:
        if m := LOGIN.match(self.text, start):
            begin = start
            while begin > self.over["login"] and self.text[begin - 1] in SCHEME:
                begin -= 1
            if begin < start:
                self.take("login", begin, m.end())

    def last(self, start: int, end: int) -> None:
        """12 Old Mill Road: capitalised words back to a number. Where that fails, it fails for all
        streets further on that reach back as far."""
        text = self.text
        if text[end : end + 1].isalpha() or not text[start + 1].isupper():
            return
        floor, at, names = max(self.over["address"], self.dead), start, 0
        while at > floor:
            begin = at
            while begin > floor and (text[begin - 1].isalnum() or text[begin - 1] in "-'’."):
                begin -= 1
            word = text[begin:at]
            if names and word[:1].isdecimal() and word.isascii() and (word.isdecimal() or NUMBERED.fullmatch(word)):
                self.take("address", begin, end + (text[end : end + 1] == "." and text[start + 1 : end] in SHORT))
                return
            if not word[:1].isupper() or begin <= floor or text[begin - 1] != " ":
                break
            names, at = names + 1, begin - 1
        self.dead = start

    def joined(self, start: int, end: int) -> None:
        """Hauptstraße 12, Am Alten Platz 3: the word that holds the kind, and a number."""
        text, floor = self.text, self.over["address"]
        if (m := BEHIND.match(text, end)) and text[end : end + 1] in (" ", ","):
            begin = start
            while begin > floor and (text[begin - 1].isalpha() or text[begin - 1] == "-"):
                begin -= 1
            if text[begin : begin + 1].isupper() and (begin < start or text[start].isupper()):
                self.take("address", begin, m.end())

    def names(self, at: int) -> re.Match | None:
        """The names from here on. A run of names is read once: where it led to no address, it leads
        to none from a later word either."""
        if at < self.named:
            return None
        m = NAMES.match(self.text, at)
        self.named = m.end() if m else self.named
        return m

    def middle(self, start: int, end: int) -> None:
        """12 bis, rue de la Paix."""
        text, floor = self.text, self.over["address"]
        at = start
        while at > floor and text[at - 1] not in "0123456789" and start - at < 5:
            at -= 1
        begin = at
        while begin > floor and text[begin - 1] in "0123456789":
            begin -= 1
        if begin < at and not text[begin - 1 : begin].isalnum() and BETWEEN.fullmatch(text, at, start) and (m := self.names(end - 1)) and any(c.isupper() for c in m[0]):
            self.take("address", begin, m.end())

    def first(self, start: int, end: int) -> None:
        """Calle Mayor, 15."""
        if self.text[start].isupper() and not self.text[start - 1 : start].isalnum() and end > self.over["address"]:
            if (m := self.names(end - 1)) and (n := TAIL.match(self.text, m.end())):
                self.take("address", start, n.end())


NUMBERED = re.compile(r"[0-9]+(?:[a-zA-Z]|-[0-9]+)")
BETWEEN = re.compile(r" ?(?:bis|ter|[a-zA-Z])?,?")


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end), by kind as in KINDS, then by start."""
    spans = Spans(text)
    for last, (kinds, size) in automaton().iter(lowered(text)):
        for kind in kinds:
            getattr(spans, kind)(last - size + 1, last + 1)
    return [(k, a, b) for k in KINDS for a, b in spans.found[k]]


SPANS = "array<struct<kind: string, start: int, end: int>>"
_span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])


def _find_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_chunks(batches):
        spans = [[{"kind": k, "start": a, "end": b} for k, a, b in find_spans(t or "")] for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(_span))], ["doc_id", "spans"])


def find_personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) of each row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_find_batches, f"doc_id long, spans {SPANS}")


def redact_text(text: str) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans are one, named
    by the first."""
    merged: list[list] = []
    for kind, start, end in sorted(find_spans(text), key=lambda s: (s[1], -s[2])):
        if merged and start < merged[-1][2]:
            merged[-1][2] = max(end, merged[-1][2])
        else:
            merged.append([kind, start, end])
    out, at = [], 0
    for kind, start, end in merged:
        out += [text[at:start], f"[{kind}]"]
        at = end
    return "".join([*out, text[at:]])


def redacted(text: str) -> Column:
    """The redacted text of a column; null stays null."""

    @F.arrow_udf("string")
    def redact(texts: pa.Array) -> pa.Array:
        return pa.array([redact_text(t.as_py()) if t.is_valid else None for t in texts], pa.string())

    return redact(text)


def digests(found: DataFrame) -> DataFrame:
    """Counts and joined spans of the result of find_personal_data."""

    def shown(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind))

    base = F.filter("spans", lambda s: s["kind"].isin(BASE_KINDS))
    counts = [count(k).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))
