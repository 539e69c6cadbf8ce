"""Personal data by anchors: one Aho-Corasick pass finds at-signs, plus signs, digits, schemes and identifier cues; a small
parser at each anchor expands to both sides and validates.

Kinds in the order in which spans of one start are listed:

* email, ip, card, phone: exactly the leftmost non-overlapping matches of the expressions in ``BASE``, of which those that
  fail their check (parts of an address, Luhn, number of digits) are dropped without another try;
* iban: two letters, two check digits and 11 to 30 letters or digits after the cue, modulo 97;
* ssn: ddd-dd-dddd soon after a cue;
* account: 6 to 20 digits soon after a cue for an account or passport;
* secret: an access key id, or the value, up to its delimiter, that is assigned to a password, token or key, quoted or not;
* login: user and password in front of the host of an address with a scheme.

Defined results: a null or empty text has no spans; repeated rows are searched each; a null id stays null; positions are code
points with the end excluded; extra columns are left out by ``find`` and kept by ``mask``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import documents, in_arrow, slices

#: The expressions whose matches the first four kinds are.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = (*BASE, "iban", "ssn", "account", "secret", "login")
PLACE = {k: i for i, k in enumerate(KINDS)}
FOUND = "doc_id long, spans array<struct<kind:string,start:int,end:int>>"
SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

SECRET_CUES = ("password", "passwd", "pwd", "token", "api_key", "apikey", "api-key", "secret", "access_key")
ACCOUNT_CUES = ("account", "acct", "konto", "compte", "cuenta", "passport")
SSN_CUES = ("ssn", "social security")
SCHEMES = ("http://", "https://", "ftp://", "ssh://")

DIGITS = frozenset("0123456789")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
PHONE_TAIL = re.compile(r"[ ().0-9-]+")
SECRET_SIGN = re.compile(r"""["']?\s{0,2}[=:]\s{0,2}["']?""")
SECRET_VALUE = re.compile(r"""[^\s"',;<>]*+""")
SECRET_LEAST = 6
ACCESS_KEY = re.compile(r"akia([a-z0-9]{16})(?![a-z0-9])")
IBAN_VALUE = re.compile(r"[^a-z0-9]{0,3}((?:[a-z]{2}[0-9]{2})(?: ?[a-z0-9]){11,30})")
SSN_VALUE = re.compile(r"[^0-9]{0,12}([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])")
ACCOUNT_VALUE = re.compile(r"[^0-9\n]{0,16}?([0-9](?:[ -]?[0-9]){5,19})(?![0-9])")
LOGIN = re.compile(r"([^\s/@:]++:[^\s/@]++)@")


@lru_cache(1)
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    words = {"@": "email", "+": "phone", "akia": "key", "iban": "iban"}
    words |= dict.fromkeys(DIGITS, "digit") | dict.fromkeys(SECRET_CUES, "secret") | dict.fromkeys(ACCOUNT_CUES, "account")
    words |= dict.fromkeys(SSN_CUES, "ssn") | dict.fromkeys(SCHEMES, "login")
    for word, kind in words.items():
        found.add_word(word, kind)
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def mod97(code: str) -> bool:
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def digit_spans(text: str, at: int) -> tuple[list[tuple[str, int, int]], int]:
    """Cards and addresses in the digits from ``at`` on, and where the digits with single separators end."""
    n, out = len(text), []
    runs = []
    end = at
    chain: list[tuple[int, int]] = []
    while True:  # runs of digits with one of ' ', '-' or '.' between them
        start = end
        while end < n and text[end] in DIGITS:
            end += 1
        runs.append((start, end))
        if end + 1 < n and text[end] in " -." and text[end + 1] in DIGITS:
            end += 1
        else:
            break
    for a, b in runs:
        if not chain or text[chain[-1][1]] != ".":
            chain = []
        chain.append((a, b))
        if len(chain) == 4:
            parts = [text[x:y].lstrip("0") for x, y in chain]
            if all(len(x) < 4 and int(x or 0) <= 255 for x in parts):
                out.append(("ip", chain[0][0], b))
            chain = []
    first = 0
    for i, (a, b) in enumerate(runs):
        if i + 1 == len(runs) or text[b] == ".":
            digits = [text[x:y] for x, y in runs[first : i + 1]]
            if 12 <= sum(map(len, digits)) <= 19 and luhn("".join(digits)):
                out.append(("card", runs[first][0], b))
            first = i + 1
    return out, end


def spans(text: str) -> list[tuple[str, int, int]]:
    """All spans of a text by start, then kind."""
    low = text if text.islower() and text.isascii() else text.encode().lower().decode()
    out: list[tuple[str, int, int]] = []
    mail_end = digits_end = phone_end = secret_end = 0
    for at, kind in automaton().iter(low):
        if kind == "digit":
            if at >= digits_end:
                more, digits_end = digit_spans(text, at)
                out += more
        elif kind == "email":
            start = at
            while start > mail_end and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                mail_end = m.end()
                out.append(("email", start, mail_end))
        elif kind == "phone":
            if at >= phone_end and at + 1 < len(text) and text[at + 1] in DIGITS and (m := PHONE_TAIL.match(text, at + 2)):
                tail = m[0].rstrip(" ().-")
                if len(tail) >= 2:
                    phone_end = at + 2 + len(tail)
                    if 9 <= 1 + sum(c in DIGITS for c in tail) <= 15:
                        out.append(("phone", at, phone_end))
        elif kind == "key":
            if m := ACCESS_KEY.match(low, at - 3):
                out.append(("secret", m.start(), m.end()))
        elif kind == "secret":
            if m := SECRET_SIGN.match(text, at + 1):
                if m.end() >= secret_end:  # a value inside another one ends with it
                    secret_end = SECRET_VALUE.match(text, m.end()).end()
                if secret_end - m.end() >= SECRET_LEAST:
                    out.append(("secret", m.end(), secret_end))
        elif kind == "iban":
            if m := IBAN_VALUE.match(low, at + 1):
                end = m.end(1)
                while end > m.start(1):  # the longest beginning that checks out
                    code = low[m.start(1) : end].replace(" ", "")
                    if len(code) < 15:
                        break
                    if low[end - 1] != " " and mod97(code):
                        out.append(("iban", m.start(1), end))
                        break
                    end -= 1
        elif kind == "ssn":
            if m := SSN_VALUE.match(text, at + 1):
                out.append(("ssn", m.start(1), m.end(1)))
        elif kind == "account":
            if m := ACCOUNT_VALUE.match(text, at + 1):
                out.append(("account", m.start(1), m.end(1)))
        elif m := LOGIN.match(text, at + 1):
            out.append(("login", m.start(1), m.end(1)))
    return sorted(set(out), key=lambda s: (s[1], PLACE[s[0]], s[2]))


def find(docs: DataFrame) -> DataFrame:
    """doc_id and the spans of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch):
                found = [[dict(zip(("kind", "start", "end"), s)) for s in spans(t.decode())] if t else [] for t in texts]
                yield pa.record_batch([batch.column("doc_id").slice(at, len(texts)), pa.array(found, SPANS)], ["doc_id", "spans"])

    return in_arrow(documents(docs), run, FOUND)


def masked(text: str) -> str:
    """The text with a mark in place of each run of overlapping spans, named after its first."""
    out, at, name = [], 0, ""
    for kind, start, end in spans(text):
        if start >= at or not name:
            out += [text[at:start], f"<{kind.upper()}>"]
            at, name = end, kind
        else:
            at = max(at, end)
    return "".join(out) + text[at:] if name else text


def mask(docs: DataFrame) -> DataFrame:
    """All rows and columns, with personal data replaced in ``text``; a null text stays null."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch):
                part = batch.slice(at, len(texts))
                new = pa.array([t if t is None else masked(t.decode()) for t in texts], pa.string())
                yield part.set_column(names.index("text"), part.schema.field("text"), new)

    return in_arrow(docs.select(*(F.col(f"`{c}`") for c in names)), run, docs.schema)
