"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust a score.

Base kinds (email, ip, card, phone) are reported as their pattern and check decide. The method
adds kinds that need more evidence: bank accounts (their country's length and mod-97), phone and
social security numbers without a plus sign, which count only near a word that announces them,
and secrets: keys of known forms, and random strings that are given as somebody's token or
password.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "national_phone", "ssn", "secret")
REPORT_FROM = 0.5
NEAR = 40  # characters before and behind a span in which a word may announce it
RANDOM_BITS = 3.0  # entropy per character from which a string looks drawn at random

Span = tuple[int, int, float]

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits is entered at its first digit only; a later one could not match either.
_IP = re.compile(r"[0-9](?<![0-9]{2})[0-9]*+(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}")
_NATIONAL = re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9.-])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")

# Keys and tokens by their published forms, and blocks of private keys.
_KEY_FORMS = re.compile(
    r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,72}"
    r"|sk_live_[A-Za-z0-9]{24,64}|AIza[A-Za-z0-9_-]{35}"
    r"|eyJ[A-Za-z0-9_-]{10,1000}\.eyJ[A-Za-z0-9_-]{10,2000}\.[A-Za-z0-9_-]{10,1000})(?![A-Za-z0-9])"
    r"|-----BEGIN (?:[A-Z]{2,10} )?PRIVATE KEY-----"
)
_RANDOM = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,256}={0,2}(?![A-Za-z0-9+/_=-])")

# The length of a bank account by country (ISO 13616).
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22,
    "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28,
    "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23,
    "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26,
    "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20,
    "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30,
    "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22,
    "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23,
    "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}

CONTEXT = {
    "email": ("mail", "email", "e-mail", "contact", "write"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "payment", "credit"),
    "phone": ("phone", "tel", "telephone", "call", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "transfer"),
    "national_phone": ("phone", "tel", "telephone", "call", "mobile", "fax"),
    "ssn": ("ssn", "social security"),
    "secret": ("token", "secret", "password", "passwd", "key", "apikey", "credential", "credentials", "auth"),
}
# Whole words; an underscore parts words, so that "api_key" holds a key.
_ANNOUNCES = {
    kind: re.compile(rf"(?<![A-Za-z])(?:{'|'.join(words)})(?![A-Za-z])", re.IGNORECASE)
    for kind, words in CONTEXT.items()
}
_LONGEST_WORD = max(len(w) for words in CONTEXT.values() for w in words)
# Before any context: (score, gain of a context word). The base kinds report without one.
_PRIOR = {
    "email": (0.9, 0.1),
    "ip": (0.6, 0.3),
    "card": (0.8, 0.2),
    "phone": (0.7, 0.3),
    "iban": (0.9, 0.1),
    "national_phone": (0.3, 0.4),
    "ssn": (0.3, 0.5),
    "secret": (0.3, 0.4),
}
_KNOWN_FORM = 0.9  # score of a secret of a published form


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    """The mod-10 checksum of card numbers."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def mod97(account: str) -> bool:
    """The checksum of international bank accounts (ISO 13616)."""
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _account_end(text: str, start: int) -> int:
    """Where the account that starts here ends, 0 if there is none.

    It has the length of its country, alone or in groups of four, and what follows is no more
    of it.
    """
    size, at, account = IBAN_LENGTHS.get(text[start : start + 2], 0), start, ""
    while len(account) < size:
        if account and len(account) % 4 == 0 and text[at : at + 1] == " ":
            at += 1
        c = text[at : at + 1]
        if not ("0" <= c <= "9" or "A" <= c <= "Z"):
            return 0
        account, at = account + c, at + 1
    follows = text[at : at + 1]
    return at if account and not (follows.isascii() and follows.isalnum()) and mod97(account) else 0


def looks_random(text: str) -> bool:
    """Letters and digits without the pattern of words: at least RANDOM_BITS per character."""
    if not any(c.isdigit() for c in text) or not any(c.isalpha() for c in text):
        return False
    counts = Counter(text).values()
    return -sum(n / len(text) * math.log2(n / len(text)) for n in counts) >= RANDOM_BITS


def _announced(kind: str, text: str, start: int, end: int) -> bool:
    """Whether a whole word near the span announces its kind."""
    pattern = _ANNOUNCES[kind]
    if pattern.search(text, max(0, start - NEAR), start):
        return True
    # The text is not cut inside a word, but the word has to begin near the span.
    found = pattern.search(text, end, end + NEAR + _LONGEST_WORD + 1)
    return found is not None and found.start() < end + NEAR


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local@domain.domain, found from each @ backwards.

    The local part before an @ is the longest run of its characters that no earlier match
    took; whether the rest matches depends on what follows the @ alone.
    """
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at) if start < at else None
        if match:
            free = match.end()
            yield start, free
        else:
            free = at + 1
        at = text.find("@", max(free, at + 1))


def _is_ip(part: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in part.split("."))


def _matches(kind: str, text: str) -> Iterator[tuple[int, int]]:
    """Spans of a kind that pass its check."""
    if kind == "email":
        yield from _emails(text)
    elif kind == "ip":
        yield from (m.span() for m in _IP.finditer(text) if _is_ip(m[0]))
    elif kind == "card":
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13 and 13 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
                yield m.span()
    elif kind == "phone":
        yield from (m.span() for m in _PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15)
    elif kind == "iban":
        for m in _IBAN.finditer(text):
            if end := _account_end(text, m.start()):
                yield m.start(), end
    elif kind == "secret":
        yield from (m.span() for m in _KEY_FORMS.finditer(text))
        yield from (m.span() for m in _RANDOM.finditer(text) if looks_random(m[0]))
    else:
        yield from (m.span() for m in {"national_phone": _NATIONAL, "ssn": _SSN}[kind].finditer(text))


def find_spans(text: str | None) -> dict[str, list[Span]]:
    """Confirmed spans of every kind as (start, end, score), in code points, end exclusive.

    The score starts from the kind's prior, gains near a context word on either side, and a
    span of the added kinds is dropped below REPORT_FROM. A number or secret inside a base span
    is no further one.
    """
    found: dict[str, list[Span]] = {k: [] for k in KINDS}
    if not text:
        return found
    taken: list[tuple[int, int]] = []
    for kind in KINDS:
        prior, gain = _PRIOR[kind]
        for start, end in _matches(kind, text):
            score = min(1.0, prior + gain * _announced(kind, text, start, end))
            if kind == "secret" and _KEY_FORMS.match(text, start):
                score = _KNOWN_FORM
            if kind in BASE:
                taken.append((start, end))
            elif score < REPORT_FROM or (
                kind != "iban" and any(a < end and start < b for a, b in taken)
            ):
                continue
            found[kind].append((start, end, score))
            if kind == "secret":
                taken.append((start, end))  # a known form is no further random string
    found["secret"].sort()
    return found


def _listed(found: dict[str, list[Span]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b, _ in found[k])


SPANS = "array<struct<kind string, start int, end int, score double>>"


def find_pii(docs: DataFrame, digest: bool = False) -> DataFrame:
    """doc_id and the array ``spans`` of (kind, start, end, score) per document.

    With ``digest``: the counts of the base kinds, the hash of the base spans, all spans as
    text, their number and their scores in the same order. Null is an empty text; repeated
    rows are searched one by one.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"n_{k} bigint" for k in BASE)
    last = "base_sha256 string, spans string, n_spans bigint, scores string"
    schema = f"{counts}, {last}" if digest else f"spans {SPANS}"
    item = pa.struct(
        [("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find_spans(t.as_py()) for t in batch.column("text")]
            arrays, names = [batch.column("doc_id")], ["doc_id"]
            if digest:
                for k in BASE:
                    arrays.append(pa.array([len(f[k]) for f in found], pa.int64()))
                    names.append(f"n_{k}")
                base = [hashlib.sha256(_listed(f, BASE).encode()).hexdigest() for f in found]
                arrays += [pa.array(base), pa.array([_listed(f, KINDS) for f in found], pa.string())]
                names += ["base_sha256", "spans", "n_spans", "scores"]
                scores = [[f"{x:.1f}" for k in KINDS for _, _, x in f[k]] for f in found]
                arrays += [pa.array(list(map(len, scores)), pa.int64())]
                arrays += [pa.array([",".join(x) for x in scores], pa.string())]
            else:
                rows = [
                    [dict(kind=k, start=a, end=b, score=s) for k in KINDS for a, b, s in f[k]]
                    for f in found
                ]
                arrays.append(pa.array(rows, pa.list_(item)))
                names.append("spans")
            yield pa.RecordBatch.from_arrays(arrays, names)

    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, f"doc_id {kind}, {schema}")
