"""Secret scans with structural confirmation.

Base kinds are patterns with a least length (assign, access, hex). The method adds spans that stand up to parsing:
  der   base64 or hex that decodes to DER: a SEQUENCE whose length and nested lengths fill it exactly and that has a key's shape
        (an INTEGER version or an algorithm's OBJECT IDENTIFIER first)
  ssh   base64 that decodes to an OpenSSH key: length-prefixed fields that fill it exactly, after a key type or the magic word
  jwt   signed-token: header and payload are base64url JSON objects, the header names an algorithm, a signature follows

Each is reported only if the decoded structure holds, so long random or encoded prose is left alone. Offsets are code points, ends exclusive.

Defined results: null and empty texts have no spans (base_sha256 is of the empty string); repeated rows, null doc_ids and extra columns pass.
Base64 is tried at each place where a key's header can begin. Texts without any trace of a kind are told apart by searches for fixed words and by run lengths, before any pattern is tried.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, map_arrow, text_rows

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{32,}")
NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
JWT = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{8,}+)\.([A-Za-z0-9_-]{2,}+)\.([A-Za-z0-9_-]{16,}+)")
#: What every signed token holds from its first dot on.
DOTTED = re.compile(rb"\.[A-Za-z0-9_-]{2,}+\.[A-Za-z0-9_-]{16}")
#: Where a DER SEQUENCE or an OpenSSH key can begin in base64, whatever stands before it (a name and '=', an escaped line end).
HEADER = re.compile(r"M(?=[C-H]|I[E-T])|AAAA(?=[B-P])|b3BlbnNzaC1rZXktdjE")
#: What follows: base64 or its form for URLs, whose lines may be folded, as in armoured files, indented, or end in an escaped \n, as in JSON.
FOLD = r"[ \t]*(?:(?:\\+r)?\\+n|\r\n?|\n)[ \t]*"
BASE64 = re.compile(rf"[A-Za-z0-9+/]+(?:(?:{FOLD})+[A-Za-z0-9+/]+)*+={{0,2}}")
URL_BASE64 = re.compile(rf"[A-Za-z0-9_-]+(?:(?:{FOLD})+[A-Za-z0-9_-]+)*+={{0,2}}")
FOLDS = re.compile(rf"(?:{FOLD})+")
HEX_BYTES = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){32,}(?![0-9A-Za-z])")
KINDS = ("assign", "access", "hex", "der", "ssh", "jwt")
SSH_TYPES = re.compile(rb"(?:ssh|ecdsa|sk-ssh|sk-ecdsa)-[a-z0-9@.-]+\Z")
_RUN = np.zeros(256, bool)
_RUN[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"]] = True
_HEXCHAR = np.zeros(256, bool)
_HEXCHAR[[*b"0123456789abcdef"]] = True
#: Deepest nesting that a DER structure is followed to, far beyond any key's (under 10), so that hostile bytes end the search and not the task.
DEPTH = 100


def der_elements(data: bytes, depth: int = 0) -> list[tuple[int, bytes]] | None:
    """(tag, content) of elements that fill data exactly, constructed ones checked within; None if they don't."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data) or depth > DEPTH:
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size >= 0x80:
            wide = size & 0x7F
            if not 1 <= wide <= 4 or at + wide > len(data) or data[at] == 0:
                return None
            size = int.from_bytes(data[at : at + wide], "big")
            at += wide
            if size < 0x80:
                return None
        if at + size > len(data):
            return None
        body = data[at : at + size]
        if tag & 0x20 and der_elements(body, depth + 1) is None:
            return None
        out.append((tag, body))
        at += size
    return out


def is_der_key(data: bytes) -> bool:
    """One SEQUENCE, and in it what private or public keys begin with."""
    if len(data) < 32 or data[0] != 0x30:
        return False
    top = der_elements(data)
    if top is None or len(top) != 1:
        return False
    inner = der_elements(top[0][1]) or []
    if len(inner) < 2:
        return False
    tag, body = inner[0]
    if tag == 0x02 and len(body) == 1 and body[0] <= 3:  # version, then numbers, an algorithm or octets
        return inner[1][0] in (0x02, 0x30, 0x04)
    if tag == 0x30:  # algorithm, then the key as bits or octets
        first = der_elements(body) or [(0, b"")]
        return first[0][0] == 0x06 and inner[1][0] in (0x03, 0x04)
    return False


def der_size(data: bytes) -> int:
    """Bytes of the element that data begins with, 0 if it begins with none."""
    if len(data) < 2 or data[0] != 0x30:
        return 0
    wide = data[1] & 0x7F if data[1] >= 0x80 else 0
    return 2 + wide + (int.from_bytes(data[2 : 2 + wide], "big") if wide else data[1]) if wide <= 4 else 0


def ssh_ends(data: bytes) -> set[int]:
    """Where an OpenSSH key that data begins with may end: after two fields or more of a public key, or four of a private one."""
    private = data.startswith(b"openssh-key-v1\0")
    at, fields, out = 15 if private else 0, 0, set()
    while at + 4 <= len(data):
        if private and fields == 3:  # the number of keys stands between the fields
            at, fields = at + 4, fields + 1
            continue
        (n,) = struct.unpack_from(">I", data, at)
        if at + 4 + n > len(data) or not private and not fields and not SSH_TYPES.match(data[4 : 4 + n]):
            break
        at, fields = at + 4 + n, fields + 1
        if fields >= (6 if private else 2):
            out.add(at)
    return out


class Folded:
    """Base64 from start on, its lines joined."""

    def __init__(self, m: re.Match):
        self.start, self.end = m.start(), m.end()
        body = m[0].rstrip("=")
        self.places, self.ends, parts, size, at = [], {}, [], 0, 0  # (joined offset, text offset) of lines; end in the text by joined end
        for fold in [*((f.start(), f.end()) for f in FOLDS.finditer(body)), (len(body), len(body))]:
            self.places.append((size, self.start + at))
            parts.append(body[at : fold[0]])
            size += fold[0] - at
            self.ends[size] = self.start + fold[0]
            at = fold[1]
        self.ends[size] = self.end
        self.joined = "".join(parts)

    def offset(self, place: int) -> int:
        """The joined offset of a place in the text, which is in one of the lines."""
        size, at = self.places[bisect_right(self.places, place, key=lambda x: x[1]) - 1]
        return size + place - at


def key_at(body: Folded, at: int, url: bool) -> tuple[int, int] | None:
    """(kind's place, end in the text) of a key that begins at the joined offset and ends where one of the lines does."""
    if body.joined[at] == "M":
        size = der_size(unbase64(body.joined[at : at + 8], url) or b"")
        end = at + -(-4 * size // 3)
        if end in body.ends and is_der_key(unbase64(body.joined[at:end], url) or b""):
            return 3, body.ends[end]
        return None
    wide = 4096
    while True:
        taken = body.joined[at : at + wide]
        data = unbase64(taken[: len(taken) // 4 * 4] if len(taken) % 4 == 1 else taken, url) or b""
        for n in sorted(ssh_ends(data)):
            end = at + -(-4 * n // 3)
            if n >= 30 and end in body.ends:
                return 4, body.ends[end]
        if at + wide >= len(body.joined) or not (data.startswith(b"openssh-key-v1\0") or SSH_TYPES.match(data[4 : 4 + int.from_bytes(data[:4], "big")])):
            return None
        wide *= 2


def encoded_keys(text: str, pattern: re.Pattern, url: bool = False):
    """(start, kind's place, end) of keys in base64; one inside another is not told."""
    body, done = None, 0
    for m in HEADER.finditer(text):
        if m.start() < done:
            continue
        if body is None or m.start() >= body.end:
            body = Folded(pattern.match(text, m.start()))
        found = key_at(body, body.offset(m.start()), url)
        if found:
            done = found[1]
            yield m.start(), *found


def unbase64(s: str, url: bool = False) -> bytes | None:
    s = s.replace("\r", "").replace("\n", "").rstrip("=")
    if len(s) % 4 == 1:
        return None
    try:
        return base64.b64decode((s if not url else s.replace("-", "+").replace("_", "/")) + "=" * (-len(s) % 4), validate=True)
    except ValueError:
        return None


def is_token_header(head: str, body: str) -> bool:
    for k, part in enumerate((head, body)):
        raw = unbase64(part, url=True)
        if raw is None or not raw.startswith(b"{"):
            return False
        try:
            found = json.loads(raw)
        except (ValueError, RecursionError):
            return False
        if not isinstance(found, dict) or not k and not isinstance(found.get("alg"), str):
            return False
    return True


def base_spans(text: str, raw: bytes) -> list[tuple[int, int, str]]:
    """(start, kind's place, end) in contract order."""
    out = []
    low = raw.lower()
    if any(n in low for n in NAMES):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if b"AKIA" in raw:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    if _long_run(raw, _HEXCHAR, 4, 7):
        out += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
    return sorted(out)


def _long_run(raw: bytes, table: np.ndarray, step: int, need: int) -> bool:
    """Whether `need` bytes in a row, every step-th looked at, are in table."""
    hit = table[np.frombuffer(raw, np.uint8)[::step]]
    if len(hit) < need:
        return False
    gap = np.flatnonzero(~hit)
    return bool(len(hit) - 1 - gap[-1] >= need or gap[0] >= need or (np.diff(gap) > need).any()) if len(gap) else True


def confirmed_spans(text: str, raw: bytes) -> list[tuple[int, int, str]]:
    out = []
    if HEADER.search(text):
        for pattern, url in ((BASE64, False), (URL_BASE64, True)):
            out += encoded_keys(text, pattern, url)
    if _long_run(raw, _RUN, 2, 19):
        out += [(m.start(), 3, m.end()) for m in HEX_BYTES.finditer(text) if is_der_key(bytes.fromhex(m[0]))]
    if DOTTED.search(raw):
        out += signed_tokens(text)
    return sorted(set(out))


def signed_tokens(text: str):
    """Spans of tokens, leftmost first; where three parts are none, the next ones may begin with the second of them."""
    m = JWT.search(text)
    while m:
        good = is_token_header(m[1], m[2])
        if good:
            yield m.start(), 5, m.end()
        m = JWT.search(text, m.end() if good else m.end(1) + 1)


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(raw: bytes) -> tuple[list, list]:
    """Base spans and all spans of a text."""
    text = raw.decode("utf-8", "replace")
    base = base_spans(text, raw)
    return base, sorted(base + confirmed_spans(text, raw))


def find_secrets(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS[:3]), ("base_sha256", pa.string()), ("spans", pa.string())])

    def rows(batches):
        for b in batches:
            found = [scan(t) for t in b.column("text").to_pylist()]
            counts = [[sum(k == x for _, k, _ in base) for base, _ in found] for x in range(3)]
            yield batch(schema, b.column("doc_id"), *counts, [hashlib.sha256(shown(base).encode()).hexdigest() for base, _ in found], [shown(every) for _, every in found])

    return map_arrow(text_rows(docs, F.col("doc_id").cast("long").alias("doc_id")), rows, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
