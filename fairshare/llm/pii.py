"""Personal data: an automaton finds anchors, small parsers grow and check what stands around them."""

from __future__ import annotations

import string
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIGITS = frozenset(string.digits)
LABEL = frozenset(string.ascii_letters + string.digits + "-")
LOCAL = LABEL | frozenset("._%+")
DIALLED = DIGITS | frozenset(" ().-")
SCHEME = frozenset(string.ascii_letters + string.digits + "+.-")
LETTERS = frozenset(string.ascii_letters)
ADDRESS_END = frozenset(" \t\n\r\v\f\"'<>`|\\^{}[]")

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "login", "secret", "account")

AT, DIGIT, PLUS, IBAN, LOGIN, SECRET, PASSWORD, ACCOUNT, KEY = range(9)
CUES = frozenset((IBAN, SECRET, PASSWORD, ACCOUNT))
#: Names that announce a credential, a password or an account number, in three letter cases each.
SECRET_CUES = (
    "token", "secret", "bearer", "api key", "api_key", "api-key", "apikey", "access key", "access_key", "access-key",
    "accesskey", "secret key", "secret_key", "secret-key", "private key", "private_key", "privatekey", "auth_key", "credential",
)
PASSWORD_CUES = ("password", "passwd", "passphrase", "pwd")
ACCOUNT_CUES = ("account", "acct", "account number", "account no", "acct no", "account_number", "account id", "account_id")
#: Beginnings of keys that tell by themselves, the least and most characters after them.
KEY_HEADS = {"AKIA": (16, 16), "ghp_": (36, 36), "gho_": (36, 36), "sk-": (20, 200), "xoxb-": (20, 200), "eyJ": (30, 4000)}
CREDENTIAL = frozenset(string.ascii_letters + string.digits + "+/_=.~-")
LEAST_SECRET, LEAST_PASSWORD, LEAST_DISTINCT = 16, 8, 6


class Span(NamedTuple):
    """Code points; ``end`` is exclusive."""

    kind: str
    start: int
    end: int


def automaton() -> ahocorasick.Automaton:
    """Finds at-signs, digits, dialling signs, account cues and schemes in one pass."""
    made = ahocorasick.Automaton()
    for kind, keys in ((AT, "@"), (DIGIT, string.digits), (PLUS, "+")):
        for key in keys:
            made.add_word(key, (kind, 1))
    for cue in ("IBAN", "iban", "Iban"):
        made.add_word(cue, (IBAN, len(cue)))
    made.add_word("://", (LOGIN, 3))
    for kind, cues in ((SECRET, SECRET_CUES), (PASSWORD, PASSWORD_CUES), (ACCOUNT, ACCOUNT_CUES)):
        for cue in cues:
            for form in (cue, cue.upper(), cue.title(), cue.capitalize()):
                made.add_word(form, (kind, len(form)))
    for head in KEY_HEADS:
        made.add_word(head, (KEY, len(head)))
    made.make_automaton()
    return made


def _run(text: str, at: int, chars: frozenset) -> int:
    """Where the characters of ``chars`` that begin at ``at`` end."""
    n = len(text)
    while at < n and text[at] in chars:
        at += 1
    return at


def _emails(text: str, anchors: list[int]) -> Iterator[Span]:
    done = 0
    for at in anchors:
        if at < done:
            continue
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        end = label = _run(text, at + 1, LABEL)
        if start == at or label == at + 1:
            continue
        while text[end : end + 1] == "." and (more := _run(text, end + 1, LABEL)) > end + 1:
            end = more
        if end > label:
            yield Span("email", start, end)
            done = end


def _is_byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def _addresses(text: str, anchors: list[int]) -> Iterator[Span]:
    done = 0
    for start in anchors:
        if start < done:
            continue
        parts, at = [], start
        end = done = _run(text, start, DIGITS)
        while True:
            parts.append(text[at:end])
            if len(parts) == 4 or text[end : end + 1] != "." or text[end + 1 : end + 2] not in DIGITS:
                break
            at = end + 1
            end = _run(text, at, DIGITS)
        if len(parts) == 4:
            done = end
            if all(map(_is_byte, parts)):
                yield Span("ip", start, end)


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number is right."""
    doubled = sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return (doubled + sum(map(int, digits[-1::-2]))) % 10 == 0


def _cards(text: str, anchors: list[int]) -> Iterator[Span]:
    done = 0
    for start in anchors:
        if start < done:
            continue
        end = _run(text, start, DIGITS)
        while text[end : end + 1] in (" ", "-") and text[end + 1 : end + 2] in DIGITS:
            end = _run(text, end + 1, DIGITS)
        done = end
        if end - start >= 16:
            digits = text[start:end].replace(" ", "").replace("-", "")
            if len(digits) <= 19 and len(digits) >= 16 and luhn(digits):
                yield Span("card", start, end)


def _phones(text: str, anchors: list[int]) -> Iterator[Span]:
    for start in anchors:
        if text[start + 1 : start + 2] not in DIGITS:
            continue
        end = _run(text, start + 2, DIALLED)
        while end > start + 3 and text[end - 1] not in DIGITS:
            end -= 1
        if end > start + 3 and 8 <= sum(c in DIGITS for c in text[start:end]) <= 15:
            yield Span("phone", start, end)


def _ibans(text: str, cues: list[int]) -> Iterator[Span]:
    """An account number after its cue: country, check digits, 11 to 30 more, remainder 1 by 97."""
    done = 0
    for cue in cues:
        start = cue
        while text[start : start + 1] in (":", " ", "#", "=") and start < cue + 4:
            start += 1
        if start < done:
            continue
        number, end = "", start
        while end < len(text) and len(number) < 34:
            if text[end] in LETTERS or text[end] in DIGITS:
                number += text[end].upper()
                end += 1
            elif text[end] == " " and text[end + 1 : end + 2] and len(number) % 4 == 0 and number:
                end += 1
            else:
                break
        # a word may follow the number; the longest beginning that is right counts
        while len(number) >= 15:
            if number[:2].isalpha() and number[2:4].isdigit():
                turned = "".join(str(int(c, 36)) for c in number[4:] + number[:4])
                if int(turned) % 97 == 1:
                    yield Span("iban", start, end)
                    done = end
                    break
            number = number[:-1]
            end -= 1
            while text[end - 1] == " ":
                end -= 1


def _logins(text: str, anchors: list[int]) -> Iterator[Span]:
    """Addresses with a scheme, a user and a password before the host."""
    done = 0
    for colon in anchors:
        start = colon
        while start > done and text[start - 1] in SCHEME:
            start -= 1
        while start < colon and text[start] not in LETTERS:
            start += 1
        end = colon + 3
        while end < len(text) and text[end] not in ADDRESS_END:
            end += 1
        authority = text[colon + 3 : end].split("/", 1)[0]
        user, at, host = authority.rpartition("@")
        if start < colon and start >= done and at and host and 0 < user.find(":") < len(user) - 1:
            yield Span("login", start, end)
            done = end


def _value_after(text: str, cue: int) -> int:
    """Where the value starts that a cue ending at ``cue`` announces: after ``=``, ``:`` or ``=>``; -1 without."""
    at = cue + (text[cue : cue + 1] in ('"', "'", "`", "]"))
    while at < cue + 4 and text[at : at + 1] in (" ", "\t"):
        at += 1
    mark = at
    while at < mark + 2 and text[at : at + 1] in ("=", ":", ">"):
        at += 1
    if at == mark:
        return -1
    done = at
    while at < done + 4 and text[at : at + 1] in (" ", "\t"):
        at += 1
    return at + (text[at : at + 1] in ('"', "'", "`"))


def _credential(value: str, least: int) -> bool:
    """Long enough, of letters and digits, and not one character over and over."""
    mixed = not DIGITS.isdisjoint(value) and not LETTERS.isdisjoint(value)
    return len(value) >= least and mixed and len(set(value)) >= LEAST_DISTINCT


def _secrets(text: str, at: tuple[list[int], ...]) -> Iterator[Span]:
    """Credentials after a cue, and keys that tell by their beginning; leftmost, without overlaps."""
    found = []
    for kind, least in ((SECRET, LEAST_SECRET), (PASSWORD, LEAST_PASSWORD)):
        for cue in at[kind]:
            start = _value_after(text, cue)
            if text[max(cue - 6, 0) : cue].lower() == "bearer" and text[cue : cue + 1] == " ":
                start = cue + 1
            if start >= 0 and text[start : start + 7].lower() == "bearer ":
                start += 7
            if start >= 0:
                end = _run(text, start, CREDENTIAL)
                while end > start and text[end - 1] == ".":
                    end -= 1
                if _credential(text[start:end], least):
                    found.append((start, end))
    for start in at[KEY]:
        if text[start - 1 : start] not in CREDENTIAL or start == 0:
            end = _run(text, start, CREDENTIAL)
            while end > start and text[end - 1] == ".":
                end -= 1
            head = next(h for h in KEY_HEADS if text.startswith(h, start))
            low, high = KEY_HEADS[head]
            if low <= end - start - len(head) <= high and _credential(text[start:end], LEAST_SECRET):
                found.append((start, end))
    done = 0
    for start, end in sorted(found):
        if start >= done:
            yield Span("secret", start, end)
            done = end


def _accounts(text: str, cues: list[int]) -> Iterator[Span]:
    """Six to 17 digits, single spaces or hyphens between them, after an account cue."""
    done = 0
    for cue in sorted(cues):
        start = _value_after(text, cue)
        if start < 0:
            start = cue
            while start < cue + 3 and text[start : start + 1] in (" ", "#", "."):
                start += 1
        if start < done:
            continue
        end = _run(text, start, DIGITS)
        while text[end : end + 1] in (" ", "-") and text[end + 1 : end + 2] in DIGITS and end > start:
            end = _run(text, end + 1, DIGITS)
        closed = text[end : end + 1] not in LETTERS or end == len(text)
        if closed and 6 <= sum(c in DIGITS for c in text[start:end]) <= 17:
            yield Span("account", start, end)
            done = end


def find(text: str, anchors: ahocorasick.Automaton) -> list[Span]:
    """All spans of the whole text, by kind as listed in ``KINDS``, then by start."""
    at: tuple[list[int], ...] = ([], [], [], [], [], [], [], [], [])
    for end, (kind, length) in anchors.iter(text):
        # cues are followed by what they announce; other anchors are places in it
        at[kind].append(end + 1 if kind in CUES else end + 1 - length)
    if not any(at):
        return []
    out = [*_emails(text, at[AT]), *_addresses(text, at[DIGIT]), *_cards(text, at[DIGIT])]
    out += [*_phones(text, at[PLUS]), *_ibans(text, at[IBAN]), *_logins(text, at[LOGIN])]
    return [*out, *_secrets(text, at), *_accounts(text, at[ACCOUNT])]


def mask(text: str, spans: list[Span]) -> str:
    """``text`` with every span, and what overlaps it, replaced by the kind in angle brackets."""
    parts, done = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s.start, -s.end, s.kind)):
        if start >= done:
            parts += [text[done:start], f"<{kind.upper()}>"]
        done = max(done, end)
    return "".join(parts) + text[done:]


def find_spans(docs: DataFrame, text: str = "text", into: str = "spans") -> DataFrame:
    """``docs`` with ``into``: an array of (kind, start, end) over the whole text.

    Base kinds (``BASE``) are leftmost and do not overlap within a kind; those that fail their check
    are dropped. Kinds may overlap each other. Null and empty texts have an empty array. A column
    named like ``into`` is replaced; all others and repeated rows stay.
    """

    @F.pandas_udf("array<struct<kind:string,start:long,end:long>>")
    def spans(texts: pd.Series) -> pd.Series:
        anchors = automaton()
        return pd.Series([[s._asdict() for s in find(t, anchors)] for t in texts], dtype=object)

    return docs.withColumn(into, spans(F.coalesce(F.col(f"`{text}`"), F.lit(""))))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text`` masked; null texts stay null."""

    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        anchors = automaton()
        return pd.Series([t and mask(t, find(t, anchors)) for t in texts], dtype=object)

    return docs.withColumn(text, masked(F.col(f"`{text}`")))
