"""Personal data (9): regular expressions propose spans, checksum validators confirm, context words adjust the score.

Base kinds, leftmost and non-overlapping per kind, failing matches dropped without a retry:

* ``email``  ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``
* ``ip``     four dotted numbers of at most 255
* ``card``   ``[0-9]([\\x20-]?[0-9])+`` with 12 to 19 digits that pass Luhn
* ``phone``  ``\\+[0-9][\\x20().0-9-]+[0-9]`` with 9 to 15 digits

Added kinds: ``iban`` (mod-97), ``ssn`` (3-2-4 digits with valid area, group and serial; reported only where a context
word stands nearby), ``secret`` (a value of at least 16 characters, letters and digits mixed at random, that is assigned
to a name such as token, password or api_key, or has the form of a known service's key), ``private_key`` (the block, or
what follows its first line where it has no end) and ``login`` (user and password in an address).  Candidates are proposed
in time linear in the text: emails around each ``@``, numbers in islands of digits and their separators, secrets behind
their names, so megabytes of one character class cost no more than prose.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillrank.llm.common import slices

#: Kinds in the order that breaks ties of the start position.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "secret", "private_key", "login")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_ISLAND = re.compile(r"[0-9][0-9. -]*[0-9]")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")

_ASSIGNED = re.compile(
    r"(?:token|secret|passw(?:or)?d|passphrase|api[_-]?key|access[_-]?key|auth[_-]?key|client[_-]?key|bearer|credential)"
    r"""[\w-]{0,16}["']?[ \t]{0,4}(?:=>|:=|[=:]|[ \t])[ \t]{0,4}["'`]?([A-Za-z0-9+/_.~-]{16,}+={0,2})""",
    re.I,
)
# Forms of keys that services give out.
_SERVICE = re.compile(
    r"(?<![A-Za-z0-9_])(?:A[KS]IA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,255}+|xox[abprs]-[A-Za-z0-9-]{10,255}+|AIza[A-Za-z0-9_-]{35}"
    r"|sk_live_[A-Za-z0-9]{16,255}+|eyJ[A-Za-z0-9_-]{8,4096}+\.eyJ[A-Za-z0-9_-]{8,4096}+\.[A-Za-z0-9_-]{8,4096}+)(?![A-Za-z0-9_])"
)
# What every match of the two patterns above holds (names in lower case; "key" and "pass" cover several).
_NAMES = ("token", "secret", "pass", "key", "bearer", "credential")
_MARKS = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "AIza", "sk_live_", "eyJ")
_KEY_BLOCK = re.compile(r"-----BEGIN ([A-Z]{0,12} ?)PRIVATE KEY-----")
_LOGIN = re.compile(r"(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]{1,20}://([^\s:/@]{1,64}+:[^\s:/@]{1,128}+)@")

#: Score of a confirmed span before its context, and context words by kind.
_SCORES = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.8, "ssn": 0.3, "secret": 0.6, "private_key": 0.9, "login": 0.7}
_CONTEXT = {
    "email": re.compile(r"\b(?:e-?mail|mail|contact|write|address)\b", re.I),
    "ip": re.compile(r"\b(?:ip|host|server|address|login|addr)\b", re.I),
    "card": re.compile(r"\b(?:card|credit|debit|visa|mastercard|amex|payment|pay)\b", re.I),
    "phone": re.compile(r"\b(?:phone|tel|telephone|call|mobile|fax|cell)\b", re.I),
    "iban": re.compile(r"\b(?:iban|bank|account|transfer)\b", re.I),
    "ssn": re.compile(r"\b(?:ssn|social security|tax id|taxpayer)\b", re.I),
    "secret": re.compile(r"(?:token|secret|passw|key|auth|credential|export|config)", re.I),
    "private_key": re.compile(r"\b(?:rsa|ssh|pem|certificate|key)\b", re.I),
    "login": re.compile(r"\b(?:host|server|database|db|url|connect|login)\b", re.I),
}
_CONTEXT_GAIN, _NEAR, _REPORTED = 0.2, 40, 0.5
#: Bits a character that the value of a secret has at least; words and repeated characters have fewer or no digits.
_RANDOM_BITS = 3.0


def luhn(digits: str) -> bool:
    """Whether a digit string passes the Luhn check."""
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = ord(digit) - 48
        if place % 2:
            value = value * 2 - 9 * (value > 4)
        total += value
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Whether an IBAN of 15 to 34 characters leaves 1 modulo 97."""
    plain = iban.replace(" ", "")
    if not 15 <= len(plain) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _numbers(text: str) -> Iterator[tuple[str, int, int]]:
    for island in _ISLAND.finditer(text):
        low, high = island.span()
        if low >= 2 and "A" <= text[low - 1] <= "Z" and "A" <= text[low - 2] <= "Z":
            iban = _IBAN.match(text, low - 2)
            if iban and mod97(iban.group()):
                yield "iban", *iban.span()
        if high - low < 7:
            continue
        if text.count(".", low, high) >= 3:
            for m in _IP.finditer(text, low, high):
                if all(len(part := g.lstrip("0")) <= 3 and int(part or "0") <= 255 for g in m.groups()):
                    yield "ip", *m.span()
        if high - low >= 12:
            for m in _CARD.finditer(text, low, high):
                digits = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    yield "card", *m.span()
        if text.count("-", low, high) >= 2:
            for m in _SSN.finditer(text, low, high):
                area, group, serial = m.groups()
                if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
                    yield "ssn", *m.span()


def at_random(value: str) -> bool:
    """Whether a value mixes letters and digits with the entropy of random characters."""
    head = value[:256]
    bits = -sum(n / len(head) * math.log2(n / len(head)) for n in Counter(head).values())
    return bits >= _RANDOM_BITS and any(c.isdigit() for c in head) and any(c.isalpha() for c in head)


def _secrets(text: str) -> Iterator[tuple[str, int, int]]:
    done = 0
    # Most texts hold none of the words that the patterns need, which plain search tells sooner.
    folded = text.lower()
    assigned = []
    if any(name in folded for name in _NAMES):
        assigned = [m.span(1) for m in _ASSIGNED.finditer(text) if at_random(m.group(1))]
    given = any(mark in text for mark in _MARKS)
    for start, end in sorted(assigned + ([m.span() for m in _SERVICE.finditer(text)] if given else [])):
        if start >= done:
            yield "secret", start, end
            done = end
    if "PRIVATE KEY-----" in text:
        end, open_ended = 0, set()
        for m in _KEY_BLOCK.finditer(text):
            if m.start() < end:
                continue
            label = m.group(1)
            close = -1 if label in open_ended else text.find(f"-----END {label}PRIVATE KEY-----", m.end())
            if close < 0:
                open_ended.add(label)
            end = close + len(m.group()) - 2 if close >= 0 else m.end()
            yield "private_key", m.start(), end
    if "://" in text:
        for m in _LOGIN.finditer(text):
            yield "login", *m.span(1)


def find_spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """All reported spans (kind, start, end, score) of a whole text by start, then kind; ends are exclusive."""
    if not text:
        return []
    found = [("email", s, e) for s, e in _emails(text)]
    found += _numbers(text)
    found += _secrets(text)
    if "+" in text:
        found += [
            ("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15
        ]
    out = []
    for kind, start, end in found:
        near = _CONTEXT[kind].search(text[max(start - _NEAR, 0) : start]) or _CONTEXT[kind].search(text[end : end + _NEAR])
        score = min(_SCORES[kind] + _CONTEXT_GAIN * bool(near), 1.0)
        if kind in BASE_KINDS or score >= _REPORTED:
            out.append((kind, start, end, round(score, 2)))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, spans`` per row; spans is an array of struct(kind, start, end, score) in code points.

    The operator is map-only.  Very long texts are read whole, in time linear in their length.  Null and empty texts have no spans, repeated rows repeat their result, null ids stay
    null, an empty table gives an empty result; other columns are ignored.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(
            pa.struct({"kind": pa.string(), "start": pa.int32(), "end": pa.int32(), "score": pa.float64()})
        )
        for batch in slices(batches, "text"):
            spans = [
                [dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in find_spans(text.as_py())]
                for text in batch.column("text")
            ]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(spans, kind)], ["id", "spans"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, spans array<struct<kind:string,start:int,end:int,score:double>>"
    return rows.mapInArrow(find, schema).select(F.col("id").alias(id_col), "spans")


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
