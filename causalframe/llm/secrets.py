"""Secret scan with structural confirmation.

The base patterns (assignments, access ids, hex runs) are reported as they match.
Beyond them, every base64 or hex candidate of a text is decoded and is reported
only if its structure proves what it is: a signed token whose header is a JSON
object with an algorithm, a DER key whose nested lengths all add up, an OpenSSH key
whose length-prefixed fields fill it, the body of an armoured key block.

Defined results: null text is empty and has no spans; rows that repeat are scanned
each; a null doc_id is kept; extra columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

from pyspark.sql import DataFrame, SparkSession

from causalframe.llm import common
from causalframe.llm.scan_rows import Span, scan

BASE = ("assign", "access", "hex")
CONFIRMED = ("signed_token", "der_key", "ssh_key", "armoured_key")
#: Bytes of the shortest encoding that is confirmed (a DER key of 128 bits), so that no
#: shorter run needs a look.
LEAST_BYTES = 25
LEAST_RUN = -(-LEAST_BYTES * 8 // 6)

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_SIGNED = re.compile(r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}={0,2}" % LEAST_RUN)
#: How a DER sequence or an OpenSSH key starts in base64, at the start of a run or after
#: a character of it that may part words.
_HEAD = re.compile(r"(?:^|(?<=[/+_-]))(?:M[A-I]|b3BlbnNzaC1rZXktdjEA)")
_HEX_RUN = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){%d,}(?![0-9A-Fa-f])" % LEAST_BYTES)
#: Lines of an armoured block may be parted by line ends as they are, or as a string writes them.
_ARMOUR = re.compile(r"-----BEGIN ([A-Z ]*PRIVATE KEY)-----((?:[A-Za-z0-9+/=\s]++|\\[nr])+)-----END \1-----")
_LINE_END = re.compile(r"\\[nr]|\s+")

HINTS = {
    "assign": r"""(?i)(password|passwd|secret|token|api_?key)["']? *[:=]""",
    "access": r"AKIA[A-Z0-9]{16}",
    "hex": r"[0-9a-f]{24}",
    "run": r"[A-Za-z0-9+/_-]{%d}" % LEAST_RUN,
    "signed": r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.",
    "armour": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
}

_SSH_MAGIC = b"openssh-key-v1\0"
#: Object identifiers of password-based encryption (PKCS 5 and PKCS 12), as DER has them.
_PASSWORD_BASED = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))


def decode(text: str) -> bytes | None:
    """The bytes of a base64 run of either alphabet, padded or not."""
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def signed_header(text: str) -> bool:
    """Header and payload of a signed token: JSON objects, the header names an algorithm."""
    head, body, _ = text.split(".", 2)
    try:
        first, second = (json.loads(decode(x) or b"") for x in (head, body))
    except (ValueError, RecursionError):
        return False
    return isinstance(first, dict) and isinstance(first.get("alg"), str) and isinstance(second, dict)


def der_items(data: bytes, depth: int = 0) -> list | None:
    """(tag, content or nested items) if all lengths nest exactly, else None."""
    items, at = [], 0
    while at < len(data):
        if at + 2 > len(data) or depth > 12:
            return None
        tag, n = data[at], data[at + 1]
        at += 2
        if n & 0x80:
            size = n & 0x7F
            if not 1 <= size <= 4 or at + size > len(data) or data[at] == 0:
                return None
            n = int.from_bytes(data[at : at + size], "big")
            at += size
            if n < 0x80:
                return None
        if at + n > len(data):
            return None
        body = data[at : at + n]
        at += n
        if tag & 0x20:
            nested = der_items(body, depth + 1)
            if nested is None:
                return None
            items.append((tag, nested))
        else:
            items.append((tag, body))
    return items


def der_key(data: bytes) -> bool:
    """A private key in one of its DER forms: one sequence, first a small version, then
    integers (RSA, DSA), an algorithm and octets (PKCS 8) or octets (EC); or an encrypted
    PKCS 8 key: an algorithm of password-based encryption and octets."""
    items = der_items(data) if data[:1] == b"\x30" else None
    if not items or len(items) != 1 or not isinstance(items[0][1], list):
        return False
    parts = items[0][1]
    tags = [t for t, _ in parts]
    if tags == [0x30, 0x04]:
        oid = parts[0][1][0] if parts[0][1] else (0, b"")
        return oid[0] == 0x06 and oid[1].startswith(_PASSWORD_BASED) and len(parts[1][1]) >= 16
    if len(parts) < 3 or tags[0] != 0x02 or parts[0][1] not in (b"\x00", b"\x01"):
        return False
    if all(t == 0x02 for t in tags):
        return len(tags) >= 6 and max(len(x) for _, x in parts) >= 16
    if tags[1] == 0x30 and tags[2] == 0x04:
        return bool(parts[1][1]) and parts[1][1][0][0] == 0x06
    return tags[1] == 0x04 and len(parts[1][1]) >= 16


def ssh_fields(data: bytes, most: int | None = None) -> tuple[list[bytes], bytes] | None:
    """Fields with a length of four bytes in front of each, up to `most` of them, and what is
    left; None if a field does not fit."""
    fields, at = [], 0
    while at < len(data) and len(fields) != most:
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + n > len(data):
            return None
        fields.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return None if most is not None and len(fields) < most else (fields, data[at:])


def _printable(name: bytes) -> bool:
    return 0 < len(name) <= 64 and all(0x21 <= c < 0x7F for c in name)


def ssh_key(data: bytes) -> bool:
    """An OpenSSH private key: the container's cipher, key derivation, number of keys, every
    public key and the private part, which fill it. A private part that is not encrypted
    starts with the same four bytes twice and the kind that the public key names."""
    if not data.startswith(_SSH_MAGIC):
        return False
    head = ssh_fields(data[len(_SSH_MAGIC) :], 3)
    if head is None:
        return False
    (cipher, derivation, options), rest = head
    n = int.from_bytes(rest[:4], "big")
    if not _printable(cipher) or not _printable(derivation) or not 1 <= n <= len(rest) // 8:
        return False
    body = ssh_fields(rest[4:], n + 1)
    if body is None or body[1]:
        return False
    *public, private = body[0]
    kinds = []
    for key in public:
        fields = ssh_fields(key)
        if fields is None or fields[1] or len(fields[0]) < 2 or not _printable(fields[0][0]):
            return False
        kinds.append(fields[0][0])
    if len(private) < 16 or len(private) % 8:
        return False
    if cipher != b"none":
        return derivation != b"none" and bool(options)
    first = ssh_fields(private[8:], 1)
    return derivation == b"none" and not options and private[:4] == private[4:8] and first is not None and first[0][0] == kinds[0]


def kind_of(data: bytes | None) -> str | None:
    return None if not data else "der_key" if der_key(data) else "ssh_key" if ssh_key(data) else None


def run_keys(run: str) -> list[Span]:
    """Keys of a base64 run: the whole of it, or else its parts from where a key may start,
    to the end that a DER length gives or to the end of the run."""
    kind = kind_of(decode(run))
    if kind:
        return [(kind, 0, len(run))]
    found: list[Span] = []
    n, last = len(run.rstrip("=")), 0
    for m in _HEAD.finditer(run):
        at, stop = m.start(), n
        if run[at] == "M":
            head = decode(run[at : at + 8]) or b""
            long = head[1] & 0x7F if len(head) > 1 and head[1] & 0x80 else 0
            if len(head) < 6 or long > 4:
                continue
            size = 2 + long + int.from_bytes(head[2 : 2 + long], "big") if long else 2 + head[1]
            stop = at - (-4 * size // 3)
        if at < last or stop > n or stop - at < LEAST_RUN or (stop < n and run[stop] not in "/+_-"):
            continue
        kind = kind_of(decode(run[at:stop]))
        if kind:
            last = len(run) if stop == n else stop
            found.append((kind, at, last))
    return found


def find(text: str, hint: dict[str, bool]) -> tuple[list[Span], list[Span]]:
    """Base spans of a text and confirmed ones, unordered."""
    spans: list[Span] = []
    confirmed: list[Span] = []
    if hint["assign"]:
        spans += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if hint["access"]:
        spans += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    if hint["hex"]:
        spans += [("hex", *m.span()) for m in _HEX.finditer(text)]
    if hint["armour"]:
        for m in _ARMOUR.finditer(text):
            data = decode(_LINE_END.sub("", m[2]))
            if data and (der_key(data) or ssh_key(data)):
                confirmed.append(("armoured_key", *m.span()))
    if hint["signed"]:
        confirmed += [("signed_token", *m.span()) for m in _SIGNED.finditer(text) if signed_header(m[0])]
    if hint["run"]:
        for m in _RUN.finditer(text):
            confirmed += [(kind, m.start() + a, m.start() + b) for kind, a, b in run_keys(m[0])]
        for m in _HEX_RUN.finditer(text):
            kind = kind_of(bytes.fromhex(m[0]))
            if kind:
                confirmed.append((kind, *m.span()))
    return spans, confirmed


def secret_scan(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_assign, n_access, n_hex,
    base_sha256, spans (text), n_spans, found (kind, start, end, value). Offsets are code points."""
    common.tune(spark)
    return scan(docs, find, BASE, CONFIRMED, HINTS)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents."""
    return secret_scan(spark, spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("found")
