"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust a score.

Base kinds (email, ip, card, phone) are kept by the pattern and its check
alone.  The extra kinds (iban, ssn) are weaker patterns, so they are kept only
when a checksum (mod 97) and context words lift their score to ``min_score``.
Scores are worked out in hundredths; context words count as whole words.

Every scan is linear in the text: patterns consume whole runs with possessive
quantifiers, and e-mail addresses are found from their ``@`` outwards.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from churnkit.llm.textkit import keyed_text

BASE_KINDS = ("email", "ip", "card", "phone")
EXTRA_KINDS = ("iban", "ssn")
KINDS = BASE_KINDS + EXTRA_KINDS
MIN_SCORE = 0.5
CONTEXT_CHARS = 40

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# the run of digits is always consumed; the group is there only for four dotted parts
DOTTED = re.compile(r"[0-9]++((?:\.[0-9]++){3})?")
DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])(?!000|666|9[0-9]{2})[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
ANY_DIGIT = re.compile(r"[0-9]")

# Words near a span that speak for its kind, and words that speak against personal data.
SUPPORTING = {
    "email": ("mail", "contact", "write", "reach"),
    "ip": ("address", "host", "server", "login", "ip"),
    "card": ("card", "visa", "mastercard", "credit", "payment", "pay"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "contact"),
    "iban": ("iban", "bank", "account", "transfer", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social security", "tax id", "taxpayer"),
}
OPPOSING = ("example", "sample", "dummy", "version", "isbn", "order", "invoice", "test")
PRIOR = {"email": 80, "ip": 60, "card": 80, "phone": 60, "iban": 70, "ssn": 30}  # hundredths
LIFT = {"email": 20, "ip": 20, "card": 20, "phone": 20, "iban": 20, "ssn": 40}
DROP = 20


def _any_word(words: tuple[str, ...]) -> re.Pattern:
    return re.compile(r"(?<![^\W_])(?:" + "|".join(words) + r")(?![^\W_])", re.IGNORECASE)


_SUPPORTING = {kind: _any_word(words) for kind, words in SUPPORTING.items()}
_OPPOSING = _any_word(OPPOSING)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(value: str) -> bool:
    moved = value[4:] + value[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and (not part or int(part) <= 255)


def emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            yield start, done
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def ips(text: str) -> Iterator[tuple[int, int]]:
    for m in DOTTED.finditer(text):
        if m.group(1) and all(map(_octet, m.group().split("."))):
            yield m.span()


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in DIGITS.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
            yield m.span()


def ibans(text: str) -> Iterator[tuple[int, int]]:
    for m in IBAN.finditer(text):
        value = m.group().replace(" ", "")
        if 15 <= len(value) <= 34 and mod97(value):
            yield m.span()


def ssns(text: str) -> Iterator[tuple[int, int]]:
    for m in SSN.finditer(text):
        yield m.span()


def score(text: str, kind: str, start: int, end: int) -> int:
    """Prior of the confirmed pattern in hundredths, moved by whole words within CONTEXT_CHARS on both sides."""
    low, high = max(0, start - CONTEXT_CHARS), min(len(text), end + CONTEXT_CHARS)

    def whole(words):  # a word that the window cuts is none
        m = words.search(text, low, start)
        while m and m.start() == low and low and text[low - 1].isalnum():
            m = words.search(text, m.end(), start)
        if m:
            return True
        m = words.search(text, end, high)
        while m and m.end() == high and high < len(text) and text[high].isalnum():
            m = words.search(text, m.end(), high)
        return bool(m)

    s = PRIOR[kind] + (LIFT[kind] if whole(_SUPPORTING[kind]) else 0) - (DROP if whole(_OPPOSING) else 0)
    return min(100, max(0, s))


def find_spans(text: str | None, min_score: float = MIN_SCORE) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) in code points, by kind as in KINDS, then start.  Null or empty text: none."""
    if not text:
        return []
    found = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if ANY_DIGIT.search(text):
        found += [("ip", a, b) for a, b in ips(text)] if "." in text else []
        found += [("card", a, b) for a, b in cards(text)]
        found += [("phone", a, b) for a, b in phones(text)] if "+" in text else []
        found += [("iban", a, b) for a, b in ibans(text)]
        found += [("ssn", a, b) for a, b in ssns(text)] if "-" in text else []
    out = []
    for kind, a, b in found:
        s = score(text, kind, a, b)
        if kind in BASE_KINDS or s >= round(100 * min_score):
            out.append((kind, a, b, s / 100))
    return out


def redact(text: str | None, spans: Iterable[tuple[str, int, int, float]]) -> str | None:
    """Replace spans by ``<KIND>``; of overlapping spans the one that starts first, then the longer, wins."""
    if not text:
        return text
    out, at = [], 0
    for kind, a, b, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a < at:
            # what an earlier span left uncovered of this one goes too
            at = max(at, b)
            continue
        out += [text[at:a], f"<{kind.upper()}>"]
        at = b
    return "".join(out) + text[at:]


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])


def pii_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """One row per input row: doc_id and ``found``, an array of (kind, start, end, score).

    Null and empty texts have an empty array.  Repeated rows and null ids are
    kept as they come; no shuffle.
    """
    docs = keyed_text(df, id_col, text_col)

    def run(batches):
        for b in batches:
            found = [[{"kind": k, "start": a, "end": e, "score": s} for k, a, e, s in find_spans(t, min_score)]
                     for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, pa.list_(SPAN))], ["doc_id", "found"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " \
             "found array<struct<kind:string,start:bigint,end:bigint,score:double>>"
    return docs.mapInArrow(run, schema)


def redact_pii(df: DataFrame, text_col: str = "text", min_score: float = MIN_SCORE,
               length_col: str | None = None) -> DataFrame:
    """The same rows and columns with every span replaced by its kind in angle brackets.

    ``length_col`` names a column that holds the text's length and follows the
    change.  Rows without a span, null texts among them, are returned untouched.
    """
    schema = df.schema

    def run(batches):
        for b in batches:
            texts = b.column(text_col).to_pylist()
            new, changed = [], []
            for t in texts:
                spans = find_spans(t, min_score)
                new.append(redact(t, spans) if spans else t)
                changed.append(bool(spans))
            if any(changed):
                i = b.schema.get_field_index(text_col)
                b = b.set_column(i, b.schema.field(i), pa.array(new, b.schema.field(i).type))
                if length_col:
                    j = b.schema.get_field_index(length_col)
                    old = b.column(j).to_pylist()
                    b = b.set_column(j, b.schema.field(j), pa.array(
                        [len(n) if c else o for n, c, o in zip(new, changed, old)], b.schema.field(j).type))
            yield b

    return df.mapInArrow(run, schema)


def joined(spans) -> str:
    return ",".join(f"{s[0]}:{s[1]}:{s[2]}" for s in spans)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
