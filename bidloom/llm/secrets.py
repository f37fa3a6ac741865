"""Secret scans with structural confirmation.

Base rules name candidates; beyond them, base64 or hex candidates are decoded and reported only when what they hold parses:
DER key encodings with nested lengths that add up, SSH wire formats, PEM blocks and signed-token headers.

One pass, no shuffle. A null text counts as empty; empty tables give empty results; repeated rows each give a row; only id
and text are read. All scans are linear in the text.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, scalars, table
from .pii import digest

#: Order of kinds that start at the same place: the base kinds, then the confirmed structures.
KINDS = ("assign", "access", "hex", "jwt", "der", "ssh", "pem")
_ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]*)?")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}")
_LONG_HEX = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){32,}(?![0-9A-Fa-f])")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{1,40})-----([A-Za-z0-9+/=\s]+)-----END \1-----")


def _unbase64(s: str) -> bytes:
    s = s.rstrip("=").translate(str.maketrans("-_", "+/"))
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return b""


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """The tag-length-value items that fill ``data`` exactly, or None."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, n = data[at], data[at + 1]
        at += 2
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or at + k > len(data):
                return None
            n = int.from_bytes(data[at : at + k], "big")
            at += k
        if at + n > len(data):
            return None
        out.append((tag, data[at : at + n]))
        at += n
    return out


def is_der_key(data: bytes) -> bool:
    """A key in DER: PKCS#1 and DSA integers, SEC1, PKCS#8 or a public-key info; all nested lengths must add up."""
    outer = der_items(data)
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    inner = der_items(outer[0][1])
    if not inner or len(inner) < 2:
        return False
    tags = [t for t, _ in inner]

    def algorithm(body: bytes) -> bool:
        items = der_items(body)
        return bool(items) and items[0][0] == 0x06 and len(items[0][1]) >= 3

    if tags[0] == 0x02 and len(inner[0][1]) == 1:
        if tags[:9] == [0x02] * 9 or tags == [0x02] * 6:
            return True
        if tags[1] == 0x04 and len(inner[1][1]) >= 16:
            return all(t in (0xA0, 0xA1) for t in tags[2:])
        return len(tags) >= 3 and tags[1] == 0x30 and tags[2] == 0x04 and algorithm(inner[1][1])
    if tags == [0x30, 0x03]:
        return algorithm(inner[0][1])
    return tags == [0x02, 0x02] and len(inner[0][1]) >= 64 and len(inner[1][1]) <= 8


def is_ssh_key(data: bytes) -> bool:
    """An OpenSSH private key file, or length-prefixed strings from a key-type name to the very end."""
    if data.startswith(b"openssh-key-v1\0"):
        data, parts = data[15:], 3
    else:
        parts = 0
    fields = []
    while data and (not parts or len(fields) < parts):
        n = int.from_bytes(data[:4], "big")
        if len(data) < 4 or 4 + n > len(data):
            return False
        fields.append(data[4 : 4 + n])
        data = data[4 + n :]
    if parts:
        return len(fields) == parts and len(data) >= 4
    return len(fields) >= 2 and re.fullmatch(rb"(ssh|ecdsa|sk)-[a-z0-9@.-]{3,40}", fields[0]) is not None


def is_signed_token(token: str) -> bool:
    """Three dot-joined parts (the last may be empty), with a JSON header that names an algorithm and a JSON object after it."""
    parts = token.split(".")
    try:
        header, body = (json.loads(_unbase64(p)) for p in parts[:2])
    except (ValueError, RecursionError):
        # no JSON, or nested deeper than any token is
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str) and isinstance(body, dict) and len(parts) == 3


def secret_spans(text: str) -> list[tuple[str, int, int, bool]]:
    out = []
    if "=" in text or ":" in text:
        out = [("assign", m.start(), m.end(), True) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), True) for m in _ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end(), True) for m in _HEX.finditer(text)]
    if "eyJ" in text:
        out += [("jwt", m.start(), m.end(), False) for m in _JWT.finditer(text) if is_signed_token(m.group())]
    if "-----BEGIN" in text:
        for m in _PEM.finditer(text):
            data = _unbase64("".join(m.group(2).split()))
            if is_der_key(data) or is_ssh_key(data):
                out.append(("pem", m.start(), m.end(), False))
    for m in _BASE64.finditer(text):
        data = _unbase64(m.group())
        if data[:1] == b"\x30" and is_der_key(data):
            out.append(("der", m.start(), m.end(), False))
        elif data[:2] in (b"\0\0", b"op") and is_ssh_key(data):
            out.append(("ssh", m.start(), m.end(), False))
    for m in _LONG_HEX.finditer(text):
        if m.group()[:2] == "30" and is_der_key(bytes.fromhex(m.group())):
            out.append(("der", m.start(), m.end(), False))
    return out


def scan(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id and ``found``, an array of (kind, start, end, score, base); code points, end exclusive."""

    def rows(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield {"id": part.column(0), "found": [[{"kind": k, "start": s, "end": e, "score": 1.0, "base": b} for k, s, e, b in secret_spans(t or "")] for t in scalars(part.column(1))]}

    picked = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(picked, rows, "id long, found array<struct<kind:string,start:int,end:int,score:double,base:boolean>>").withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan(table(spark, sf_dir, "documents")), KINDS, KINDS[:3], by_start=True)
