"""Secret scans: keyword prefilter, anchored expressions near the hits, checksums.

An Aho-Corasick automaton reads a text once, in lower case, for the keywords of all kinds. Expressions are only
tried where a keyword begins, in the order of the text, so each kind's matches are leftmost and non-overlapping. Runs
of hexadecimal digits have no keyword; one expression finds the runs that are long enough.

Kinds, in the order of the spans: assign, access and hex as agreed, then those that carry proof of
their own and are dropped without it:

* ``hub``: a prefixed service token of 36 letters and digits, the last six of which are the CRC-32 of the rest in base 62;
* ``pack``: a package registry token of the same make;
* ``jwt``: a signed web token whose first two parts are base64url JSON objects, the first with an "alg";
* ``pem``: a private key block whose body is base64 of a DER sequence of just that length.

Positions are code points, ends exclusive. Defined results: a null or empty text has no spans; null ids and
repeated rows pass through; other columns are ignored. Texts are held whole by one task; no step is quadratic in a text.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from newsweft.llm.common import texts

KINDS = ["assign", "access", "hex", "hub", "pack", "jwt", "pem"]
# fixed values: keywords by kind and the expressions tried at them
KEYWORDS = {
    "password": "assign",
    "passwd": "assign",
    "secret": "assign",
    "token": "assign",
    "apikey": "assign",
    "api_key": "assign",
    "akia": "access",
    "ghp_": "hub",
    "gho_": "hub",
    "ghu_": "hub",
    "ghs_": "hub",
    "ghr_": "hub",
    "npm_": "pack",
    "eyj": "jwt",
    "-----begin ": "pem",
}
EXPRESSIONS = {
    "assign": re.compile(r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hub": re.compile(r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    "pack": re.compile(r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    "jwt": re.compile(r"eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++"),
    "pem": re.compile(r"-----BEGIN ([A-Z]+ )?PRIVATE KEY-----([A-Za-z0-9+/=\s]++)-----END \1?PRIVATE KEY-----"),
}
# what a failed web token has read; no other token begins in it
PARTS = re.compile(r"[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]++)?")
HEX = re.compile(r"[0-9a-f]{24,}")
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
SPANS = "array<struct<kind:string,start:int,end:int>>"


def base62(value: int, length: int) -> str:
    out = ""
    while value:
        value, digit = divmod(value, 62)
        out = DIGITS[digit] + out
    return out.rjust(length, "0")


def _checked(body: str) -> bool:
    """Whether the last six characters are the checksum of what comes before."""
    return base62(zlib.crc32(body[:-6].encode()), 6) == body[-6:]


def _object(part: str) -> dict | None:
    try:
        value = json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (ValueError, binascii.Error, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def _sequence(body: str) -> bool:
    """Whether base64 text is one DER sequence from end to end."""
    try:
        data = base64.b64decode("".join(body.split()), validate=True)
    except (ValueError, binascii.Error):
        return False
    if len(data) < 4 or data[0] != 0x30:
        return False
    if data[1] < 0x80:
        return len(data) == 2 + data[1]
    size = data[1] & 0x7F
    return size <= 4 and len(data) == 2 + size + int.from_bytes(data[2 : 2 + size], "big")


def _proven(kind: str, match: re.Match) -> bool:
    if kind == "assign":
        return len(match[2]) >= 6
    if kind == "access":
        return match.end() - match.start() >= 20
    if kind in ("hub", "pack"):
        return _checked(match[0][4:])
    if kind == "jwt":
        head, body, _ = match[0].split(".")
        first = _object(head)
        return first is not None and "alg" in first and _object(body) is not None
    return _sequence(match[2])


class Scanner:
    _made: Scanner | None = None

    def __init__(self) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for word, kind in KEYWORDS.items():
            self.automaton.add_word(word, (kind, len(word)))
        self.automaton.make_automaton()

    @classmethod
    def of(cls) -> Scanner:
        cls._made = cls._made or cls()
        return cls._made

    def scan(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, start, end) by start, then kind as listed."""
        low = text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
        found: list[tuple[str, int, int]] = []
        over: dict[str, int] = {}
        for end, (kind, length) in self.automaton.iter(low):
            start = end + 1 - length
            if start < over.get(kind, 0):
                continue
            match = EXPRESSIONS[kind].match(text, start)
            if match:
                over[kind] = match.end()
                if _proven(kind, match):
                    found.append((kind, start, match.end()))
            elif kind == "jwt":
                over[kind] = PARTS.match(text, start).end() if text.startswith("eyJ", start) else start + 1
        found.extend(("hex", m.start(), m.end()) for m in HEX.finditer(text))
        return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner.of()
    kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    for batch in batches:
        rows = [[{"kind": k, "start": a, "end": b} for k, a, b in scanner.scan(t)] for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(kind))], names=["doc_id", "spans"])


def secrets(documents: DataFrame) -> DataFrame:
    """(doc_id, spans): every span of every text, one row per input row."""
    return texts(documents).mapInArrow(_scan, f"doc_id long, spans {SPANS}")
