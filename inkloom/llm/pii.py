"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spans import SPAN, by_place, matches, text_scan
from .store import schema_of

KINDS = ("email", "ip", "card", "phone", "iban")
NEAR = 40  # characters of context on either side
LEAST = 0.5  # score that a span of a kind beyond the base needs

# Prior score by kind, and the context words that raise or lower it.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8}
RAISE = {"email": ("mail", "contact", "write"), "ip": ("ip", "host", "server", "address"),
         "card": ("card", "visa", "credit", "payment"), "phone": ("phone", "call", "tel", "mobile"),
         "iban": ("iban", "bank", "account", "transfer")}
LOWER = ("example", "sample", "version", "isbn", "order", "test")

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]")
_WORD = re.compile(r"[a-z]+")
# Digit runs are entered at their first digit only and never given back, so long runs cost one pass.
_IP = matches(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_DOTTED = re.compile(r"[0-9]\.[0-9]")
_CARD = matches(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = matches(r"\+[0-9][\x20().0-9-]+[0-9]")
_ACCOUNT = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}")
_REST = re.compile(r"(?:\x20?[A-Z0-9]){11,30}")


def luhn(digits: str) -> bool:
    """Whether the digits pass the Luhn check."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def mod97(account: str) -> bool:
    """Whether an account number without spaces passes the mod-97 check."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of local part, @ and a dotted domain. Only what stands before an @ is looked at, so long runs without
    one cost nothing: a match must begin where the run before its @ begins, or where the match before ended."""
    done = 0
    for m in _DOMAIN.finditer(text):
        at, width = m.start(), 64
        while True:
            low = max(done, at - width)
            run = _LOCAL.match(text[low:at][::-1])
            length = run.end() if run else 0
            if length < at - low or low == done:
                break
            width *= 4
        if length:
            yield at - length, m.end()
            done = m.end()


def accounts(text: str) -> Iterator[tuple[int, int]]:
    """Account numbers: a country code, two check digits and 11 to 30 letters and digits that pass mod-97, the longest that end with a
    word. Upper-case words may follow a number, so shorter ends are tried; each head is tried, but for those in a number."""
    done = 0
    for m in _ACCOUNT.finditer(text):
        rest = _REST.match(text, m.end()) if m.start() >= done else None
        for stop in range(rest.end(), m.end(), -1) if rest else ():
            last = stop == len(text) or not (text[stop].isascii() and text[stop].isalnum())
            number = text[m.start():stop].replace(" ", "")
            if last and text[stop - 1] != " " and len(number) >= 15 and mod97(number):
                yield m.start(), stop
                done = stop
                break


def _context(text: str, kind: str, start: int, stop: int) -> float:
    near = set(_WORD.findall(f"{text[max(0, start - NEAR):start]} {text[stop:stop + NEAR]}".lower()))
    score = PRIOR[kind] + 0.15 * bool(near.intersection(RAISE[kind])) - 0.35 * bool(near.intersection(LOWER))
    return round(min(1.0, max(0.0, score)), 2)


def _proposed(text: str) -> Iterator[tuple[str, int, int]]:
    if "@" in text:
        yield from (("email", a, b) for a, b in emails(text))
    if not _DIGITS.search(text):
        return
    if _DOTTED.search(text):
        for a, b, m in _IP(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                yield "ip", a, b
    for a, b, m in _CARD(text):
        if b - a >= 12 and 12 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            yield "card", a, b
    for a, b, m in _PHONE(text) if "+" in text else ():
        if 9 <= len(_DIGITS.findall(m[0])) <= 15:
            yield "phone", a, b
    yield from (("iban", a, b) for a, b in accounts(text))


def find(text: str) -> list[tuple]:
    """(kind, start, stop, score, base) of every confirmed span, by start, then by kind in the listed order."""
    out = []
    for kind, a, b in _proposed(text):
        score, base = _context(text, kind, a, b), kind != "iban"
        if base or score >= LEAST:
            out.append((kind, a, b, score, base))
    return by_place(out, KINDS)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans`` per input row; spans carry kind, start and stop in code points (stop exclusive), score, base.

    e-mail addresses, IPv4 addresses (parts up to 255), card numbers (12 to 19 digits, Luhn) and phone numbers (9 to 15
    digits) always stay and get a score; account numbers (mod-97) are added where their score is 0.5 or more. Words
    within 40 characters raise or lower the score. Matches are leftmost and non-overlapping per kind; a match that fails
    its check is dropped and its text is not tried again, but for
    account numbers, whose shorter ends are (see ``accounts``). Kinds may overlap each other. Whole texts are scanned in one
    pass per kind, in linear time, without a shuffle. Null and empty texts have no spans; repeated rows and null ids are
    kept; other columns are ignored.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(text_scan(find, 1), schema_of(docs, id_col, f"spans {SPAN}"))
