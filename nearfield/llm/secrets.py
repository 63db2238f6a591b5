"""Secret scans with structural confirmation.

Base patterns are found in each whole text: assignments of a secret, access keys and runs of hex digits.
Structural confirmation then decodes candidates and parses them before it reports spans of its own:

- ``jwt``: three base64url parts whose first decodes to a JSON object with an ``alg`` and whose second
  decodes to a JSON object; other letters may stand right before it;
- ``der``: base64 or hex that decodes to ASN.1 whose nested lengths fill it exactly, with a key's shape (a
  sequence that holds integers, bit strings, octet strings or object identifiers);
- ``ssh``: base64 that decodes to the magic of a private key file, or to length-prefixed fields that fill it
  exactly and begin with the name of a key type.

Keys may begin inside a run: base64 after a ``/``, hex at any digit.  Base64 of a text that begins as an armoured key
or a token does is decoded and searched in turn, once; the span is that of the outer base64.

Confirmed spans are added to the base ones, which stay as they are.

Defined results: a null text is empty; offsets are code points, the end exclusive; spans of one kind never
overlap, those of different kinds may; repeated rows are scanned alike; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds in the order of the report.
BASE_KINDS, ADDED_KINDS = ("assign", "access", "hex"), ("jwt", "der", "ssh")
#: Letters match in either case within ASCII alone.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
MIN_ASSIGNED = 12
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{8,})\.[A-Za-z0-9_-]{3,}\.[A-Za-z0-9_-]*")
#: Base64url that can begin a JSON object, white space before it included.
TOKEN_START = re.compile(r"e[w-z0-9_-]|[CDI][A-Za-z0-9_-]")
#: Base64 that can begin a key (0x30, the start of the magic, or a field of under 256 bytes), and one line of it.
B64_START = re.compile(r"[MbA](?<![A-Za-z0-9+].)(?:(?<=M)[A-P][A-Za-z0-9+/]{2}|(?<=b)3Bl|(?<=A)AAA)[A-Za-z0-9+/]{20}")
#: Base64 of a text that begins with ``-----BEGIN`` or ``eyJ``.
B64_TEXT = re.compile(r"(?<![A-Za-z0-9+/])(?:LS0tLS1CRUdJT|ZXlK)[A-Za-z0-9+/]{20}")
B64_LINE = re.compile(r"[A-Za-z0-9+/]+")
NEXT_LINE = re.compile(r"\r?\n(?=[A-Za-z0-9+/])")
MIN_B64 = 24
LONG_HEX = re.compile(r"[0-9A-Fa-f]{32,}")
SSH_MAGIC = b"openssh-key-v1\0"
SSH_NAMES = (b"ssh-", b"ecdsa-", b"sk-")
SSH_HEADS = (b"open", b"\0\0\0\x07", b"\0\0\0\x0b", b"\0\0\0\x13", b"\0\0\0\x1a", b"\0\0\0\x22")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each base kind; those too short are dropped."""
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGNED]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text)]
    return out + [("hex", *m.span()) for m in HEX.finditer(text)]


def der_fills(data: bytes, depth: int = 0, most: int = 32) -> tuple[bool, set[int]]:
    """Whether ASN.1 elements fill ``data`` exactly, and which tags occur."""
    at, tags = 0, set()
    while at < len(data):
        if at + 2 > len(data):
            return False, tags
        tag, size, at = data[at], data[at + 1], at + 2
        if size == 0x80:
            return False, tags
        if size > 0x80:
            n = size & 0x7F
            if n > 4 or at + n > len(data):
                return False, tags
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
        if at + size > len(data):
            return False, tags
        tags.add(tag)
        if tag & 0x20:
            if depth >= most:
                return False, tags
            ok, inner = der_fills(data[at : at + size], depth + 1, most)
            tags |= inner
            if not ok:
                return False, tags
        at += size
    return True, tags


def element_end(data: bytes, at: int) -> int | None:
    """Where the ASN.1 element at ``at`` ends by its length, or None: malformed or cut within the length."""
    n = data[at + 1] & 0x7F if at + 1 < len(data) and data[at + 1] & 0x80 else 0
    if at + 2 + n > len(data) or n > 4 or data[at + 1] == 0x80:
        return None
    return at + 2 + n + int.from_bytes(data[at + 2 : at + 2 + n], "big") if n else at + 2 + data[at + 1]


def field_end(data: bytes, at: int) -> int | None:
    """Where the length-prefixed field at ``at`` ends, or None: cut within the length."""
    return at + 4 + int.from_bytes(data[at : at + 4], "big") if at + 4 <= len(data) else None


def is_der_key(data: bytes) -> bool:
    if len(data) < 16 or data[0] != 0x30:
        return False
    ok, tags = der_fills(data)
    return ok and len(tags & {0x02, 0x03, 0x04, 0x06}) >= 2 or ok and tags == {0x30, 0x02}


def is_ssh_key(data: bytes) -> bool:
    """Whether length-prefixed fields fill ``data`` exactly and begin with the name of a key type."""
    at, first = 0, b""
    while at < len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data) or at + 4 > len(data):
            return False
        first = first or data[at + 4 : at + 4 + size]
        at += 4 + size
    return first.startswith(SSH_NAMES)


def decode64(s: str, url: bool = False) -> bytes | None:
    s = "".join(s.split()).rstrip("=")
    if len(s) % 4 == 1:
        return None
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), altchars=b"-_" if url else None, validate=True)
    except (binascii.Error, ValueError):
        return None


class Wrapped:
    """Base64 lines from a start, read as far as asked; the first has 24 characters or more, the others any number."""

    def __init__(self, text: str, start: int):
        self.text, self.left, self.data = text, "", bytearray()
        self.ends: dict[int, int] = {}  # by bytes: where the text of the line ends
        self.lines: list[tuple[int, int]] = []  # (characters, end of the text) of each line
        self.next: int | None = start

    def read(self) -> bool:
        """One more line; characters beyond groups of four give what bytes they hold until more follow."""
        if self.next is None:
            return False
        line = B64_LINE.match(self.text, self.next)
        if len(self.left) > 1:
            del self.data[1 - len(self.left) :]
        chars = self.left + line[0]
        self.left = chars[len(chars) // 4 * 4 :]
        self.data += base64.b64decode(chars + "=" * (-len(chars) % 4) if len(self.left) != 1 else chars[:-1])
        self.lines.append((len(line[0]), line.end()))
        if len(self.left) != 1:
            self.ends[len(self.data)] = line.end()
        more = NEXT_LINE.match(self.text, line.end())
        self.next = more.end() if more else None
        return True

    def upto(self, size: int) -> bytearray:
        """The bytes read once there are ``size`` of them, or all."""
        while len(self.data) < size and self.read():
            pass
        return self.data

    def padded(self, end: int, size: int) -> int:
        """The end with padding; on a line of its own only what ``size`` bytes need."""
        need, had = -size % 3, 0
        while had < 2 and self.text[end + had : end + had + 1] == "=":
            had += 1
        if had < need:
            rest = re.compile(rf"\r?\n={{{need - had}}}(?![=A-Za-z0-9+/])").match(self.text, end + had)
            return rest.end() if rest else end + had
        return end + had


def der_span(run: Wrapped) -> int | None:
    """The end of the text of an ASN.1 key that ends where a line does."""
    at = 0
    while (end := element_end(run.upto(at + 6), at)) is not None and end <= len(data := run.upto(end)):
        if end in run.ends and is_der_key(bytes(data[:end])):
            return run.padded(run.ends[end], end)
        at = end
    return None


def ssh_span(run: Wrapped) -> int | None:
    """The end of the text of a key of length-prefixed fields that end where a line does.

    A private key file whose fields after the first three do not parse is taken by its lines: those of the
    minimum or more and one shorter.
    """
    if not run.upto(len(SSH_MAGIC)).startswith(SSH_MAGIC):
        at, last = 0, None
        if not bytes(run.upto(10)[4:10]).startswith(SSH_NAMES):
            return None
        while (end := field_end(run.upto(at + 4), at)) is not None and end <= len(run.upto(end)):
            last, at = (end if end in run.ends else last), end
        return run.padded(run.ends[last], last) if last is not None and is_ssh_key(bytes(run.data[:last])) else None
    at, left = len(SSH_MAGIC), 3  # cipher, kdf, options; then a count, so many public keys and the private part
    while left and (end := field_end(run.upto(at + 4), at)) is not None and end <= len(run.upto(end)):
        at, left = end, left - 1
    if left:
        return None
    head = run.upto(at + 4)
    left = 1 + int.from_bytes(head[at : at + 4], "big")
    at += 4
    while left and (end := field_end(run.upto(at + 4), at)) is not None and end <= len(run.upto(end)):
        at, left = end, left - 1
    if not left and at in run.ends:
        return run.padded(run.ends[at], at)
    i, chars = 0, run.lines[0][0]
    while run.lines[i][0] >= MIN_B64 and (i + 1 < len(run.lines) or run.read()):
        i, chars = i + 1, chars + run.lines[i + 1][0]
    return run.padded(run.lines[i][1], chars * 3 // 4)


def is_signed_token(s: str) -> bool:
    """Whether the header of a signed token parses: an object with ``alg``; and its claims: an object."""
    try:
        head, claims = (json.loads(decode64(p, True) or b"") for p in s.split(".")[:2])
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(claims, dict)


def token_spans(text: str) -> Iterator[tuple[str, int, int]]:
    """Signed tokens; each place in the first part where a JSON object can begin is tried."""
    if text.count(".") < 2:
        return
    at = 0
    while m := TOKEN.search(text, at):
        at = m.end()
        for start in TOKEN_START.finditer(text, m.start(1), m.end(1) - 6):
            head = decode64(text[start.start() : min(m.end(1), start.start() + 8)], True)
            if head is not None and head.lstrip()[:1] == b"{" and is_signed_token(text[start.start() : m.end()]):
                yield ("jwt", start.start(), m.end())
                break
        else:
            at = m.end(1) + 1  # the second part may be the first of a token


def hex_spans(text: str) -> Iterator[tuple[str, int, int]]:
    """ASN.1 keys in hex, from any digit of a run on."""
    for m in LONG_HEX.finditer(text):
        run, at = m[0], m[0].find("30")
        while 0 <= at <= len(run) - 32:
            end = element_end(bytes.fromhex(run[at : at + 12]), 0)
            if end is not None and 16 <= end <= (len(run) - at) // 2 and is_der_key(bytes.fromhex(run[at : at + 2 * end])):
                yield ("der", m.start() + at, m.start() + at + 2 * end)
                at += 2 * end - 1
            at = run.find("30", at + 1)


def encoded_spans(text: str) -> Iterator[tuple[str, int, int]]:
    """Base64 of texts that hold a key or token: lines of one length and a last one."""
    at = 0
    while m := B64_TEXT.search(text, at):
        run = Wrapped(text, m.start())
        run.read()
        while run.lines[-1][0] == run.lines[0][0] and run.read():
            pass
        at = run.padded(run.lines[-1][1], len(run.data))
        inner = confirmed_spans(run.data.decode("latin-1"), False)
        if inner:
            yield (inner[0][0], m.start(), at)


def confirmed_spans(text: str, decode_texts: bool = True) -> list[tuple[str, int, int]]:
    """Spans of candidates that decode and parse as what they look like."""
    out = list(token_spans(text))
    at = 0
    while m := B64_START.search(text, at):
        run, kind, end = Wrapped(text, m.start()), "der", None
        head = base64.b64decode(text[m.start() : m.start() + 8])
        if head[:1] == b"\x30":
            end = der_span(run)
        elif head[:4] in SSH_HEADS:
            kind, end = "ssh", ssh_span(run)
        if end is not None:
            out.append((kind, m.start(), end))
        at = m.start() + 1 if end is None else end
    out += hex_spans(text)
    if decode_texts:
        out += encoded_spans(text)
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    rank = {k: i for i, k in enumerate(BASE_KINDS + ADDED_KINDS)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(set(spans), key=lambda s: (s[1], rank[s[0]], s[2])))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_confirmed of every document."""
    import pyarrow as pa

    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_confirmed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[list] = [[] for _ in names[1:]]
            for text in b.column(1).to_pylist():
                text = text or ""
                base = base_spans(text)
                more = confirmed_spans(text)
                kinds = [k for k, _, _ in base]
                for col, v in zip(rows, (kinds.count("assign"), kinds.count("access"), kinds.count("hex"), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more), len(more)), strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, rows[:3], [pa.int64()] * 3), *map(pa.array, rows[3:5], [pa.string()] * 2), pa.array(rows[5], pa.int64())], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long")
