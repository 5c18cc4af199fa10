"""Secret scans with structural confirmation.

Base spans are plain patterns.  The method adds spans whose content is decoded
and parsed before it is reported: base64 (in one run, or wrapped over lines) or
hexadecimal candidates must hold a private key, encrypted or not, whose nested
lengths fill its encoding to the last byte, an OpenSSH private key, or text with a
secret of its own, up to DEPTH encodings deep; framed keys must hold such a key,
or whole cipher blocks below a header that names their cipher; signed tokens must
have a header that names an algorithm and a payload that is an object.

Each text is scanned as a whole by an Arrow function that ships nothing but the
text; there is no shuffle, so the size of sources or groups of copies does not
matter.  Defined results: a null or empty text has no spans; repeated rows each
get their own result; an empty table gives an empty table; other columns pass
through, and a column already named like the output is replaced.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

#: Base kinds, in their order, with the pattern and the least length of the named group (fixed values).
BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I), 2, 12),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 16),
}
#: The same, for scanning: a run of hexadecimal digits is found as fast as it is long enough.
_SCAN = BASE | {"hex": (re.compile(r"[0-9a-f]{16,}"), 0, 16)}
#: Kinds that the method adds, in their order.
CONFIRMED = ("pem", "jwt", "key_base64", "key_hex", "encoded")
KINDS = (*BASE, *CONFIRMED)

#: Encodings within encodings that are looked into.
DEPTH = 3
_BEGIN = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----")
_END = re.compile(r"-----END ([A-Z0-9 ]*PRIVATE KEY)-----")
_CIPHER = re.compile(r"DEK-Info:\x20*(DES|AES|CAMELLIA|SEED|RC2)[A-Z0-9-]*,[0-9A-Fa-f]+\s+")
#: A brace and what may follow it, encoded: the header of a token.
_JWT = re.compile(r"(?:eyJ|(?<![A-Za-z0-9_-])e[w-z])[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]*")
#: Lines of base64 in a row, and one line more, which may be short.
_LINES = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}+(?:\r?\n[A-Za-z0-9+/_-]{24,}+)*+={0,2}+")
_TAIL = re.compile(r"\r?\n[A-Za-z0-9+/_-]++={0,2}+(?![A-Za-z0-9+/_=-])")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{24,}={0,2}")
_HEX = re.compile(r"[0-9a-f]{48,}|[0-9A-F]{48,}")
#: No assignment is in a text that has none of these in lower case.
_HINTS = ("passw", "secret", "token", "api")
SPANS = ArrayType(StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType())]))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_SEQUENCE, _INTEGER, _OCTETS, _OID = 0x30, 0x02, 0x04, 0x06


def decoded64(text: str) -> bytes | None:
    """Base64 of either alphabet, with or without padding."""
    body = text.rstrip("=").translate({45: 43, 95: 47})
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def elements(data: bytes, at: int = 0, end: int | None = None) -> list[tuple[int, int, int]] | None:
    """Tag, begin and end of the encoded elements that fill ``data[at:end]`` exactly; None if none do."""
    end, found = len(data) if end is None else end, []
    while at < end:
        if at + 2 > end:
            return None
        tag, n, at = data[at], data[at + 1], at + 2
        if n >= 0x80:
            width = n & 0x7F
            if not 1 <= width <= 4 or at + width > end or data[at] == 0:
                return None
            n, at = int.from_bytes(data[at : at + width], "big"), at + width
            if n < 0x80:
                return None
        if at + n > end:
            return None
        found.append((tag, at, at + n))
        at += n
    return found


def is_private_key(data: bytes | None) -> bool:
    """Whether the bytes are one private key: PKCS#1, PKCS#8 (encrypted, too), SEC1 or OpenSSH, to the last byte."""
    if not data or len(data) < 16:
        return False
    if data.startswith(b"openssh-key-v1\0"):
        at, strings = 15, 0
        for _ in range(3):  # cipher, derivation and its options
            if at + 4 > len(data):
                return False
            at += 4 + int.from_bytes(data[at : at + 4], "big")
            strings += 1
        if at + 4 > len(data) or not 1 <= (keys := int.from_bytes(data[at : at + 4], "big")) <= 64:
            return False
        at += 4
        for _ in range(keys + 1):
            if at + 4 > len(data):
                return False
            at += 4 + int.from_bytes(data[at : at + 4], "big")
        return at == len(data)
    outer = elements(data)
    if not outer or len(outer) != 1 or outer[0][0] != _SEQUENCE:
        return False
    inner = elements(data, outer[0][1], outer[0][2])
    if inner and [t for t, _, _ in inner] == [_SEQUENCE, _OCTETS]:  # encrypted: the cipher, and whole blocks of it
        algorithm, n = elements(data, inner[0][1], inner[0][2]), inner[1][2] - inner[1][1]
        return bool(algorithm) and len(algorithm) == 2 and [t for t, _, _ in algorithm] == [_OID, _SEQUENCE] and n >= 16 and n % 8 == 0
    if not inner or inner[0][0] != _INTEGER or inner[0][2] - inner[0][1] != 1:
        return False
    tags = [t for t, _, _ in inner]
    if len(tags) >= 9 and set(tags[:9]) == {_INTEGER}:
        return True
    if len(tags) >= 3 and tags[1] == _SEQUENCE and tags[2] == _OCTETS:
        algorithm = elements(data, inner[1][1], inner[1][2])
        return bool(algorithm) and algorithm[0][0] == _OID
    return tags[1:2] == [_OCTETS] and data[inner[0][1]] == 1 and inner[1][2] - inner[1][1] >= 16


def is_signed_token(text: str) -> bool:
    """Whether the header names an algorithm and the payload is an object."""
    try:
        header, payload = (json.loads(decoded64(x) or b"") for x in text.split(".")[:2])
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str) and isinstance(payload, dict)


def framed(text: str) -> list[tuple[int, int]]:
    """Keys between a BEGIN and the next END line of one label: each END is met once, by the last BEGIN before it."""
    out, begins = [], list(_BEGIN.finditer(text))
    k = 0
    for end in _END.finditer(text) if begins else ():
        while k + 1 < len(begins) and begins[k + 1].end() <= end.start():
            k += 1
        begin = begins[k]
        if begin.end() > end.start() or begin.group(1) != end.group(1) or (out and out[-1][0] == begin.start()):
            continue
        body = text[begin.end() : end.start()]
        cipher = _CIPHER.search(body)
        data = decoded64("".join((body[cipher.end() :] if cipher else body).split()))
        if is_private_key(data) or (cipher and data and len(data) % 8 == 0):
            out.append((begin.start(), end.end()))
    return out


def _holds_secret(data: bytes | None, depth: int) -> bool:
    """Whether decoded bytes are ASCII text with an assignment, an access key, a token or a key of its own, or with an encoding of one."""
    if not data or not data.isascii():
        return False
    text = data.decode("ascii")
    if not text.isprintable() and not text.replace("\n", "").replace("\r", "").replace("\t", "").isprintable():
        return False
    if any(len(m.group(g)) >= least for k in ("assign", "access") for rx, g, least in (BASE[k],) for m in rx.finditer(text)):
        return True
    return any(is_signed_token(m.group()) for m in _JWT.finditer(text)) or bool(framed(text)) or bool(_encoded(text, depth - 1) if depth > 1 else ())


def _encoded(text: str, depth: int = DEPTH) -> list[tuple[str, int, int]]:
    """Runs of base64 or hexadecimal digits, and wrapped base64, that decode to a key or to text with a secret."""
    out = []
    for m in _BASE64.finditer(text):
        data = decoded64(m.group())
        if is_private_key(data):
            out.append(("key_base64", m.start(), m.end()))
        elif _holds_secret(data, depth):
            out.append(("encoded", m.start(), m.end()))
    for m in _LINES.finditer(text) if "\n" in text else ():
        tail = _TAIL.match(text, m.end())
        for end in (tail.end(), m.end()) if tail else (m.end(),):
            body = text[m.start() : end]
            data = decoded64("".join(body.split())) if "\n" in body else None
            kind = "key_base64" if is_private_key(data) else "encoded" if _holds_secret(data, depth) else None
            if kind:
                out.append((kind, m.start(), end))
                break
    for m in _HEX.finditer(text):
        end = m.end() - (m.end() - m.start()) % 2
        data = bytes.fromhex(text[m.start() : end])
        if is_private_key(data):
            out.append(("key_hex", m.start(), end))
        elif _holds_secret(data, depth):
            out.append(("encoded", m.start(), end))
    return out


def find(text: str | None) -> list[tuple[str, int, int]]:
    """All spans of a text, by start and then kind; ends are exclusive, in code points."""
    if not text:
        return []
    small = text.lower()
    kinds = _SCAN if any(x in small for x in _HINTS) else {k: v for k, v in _SCAN.items() if k != "assign"}
    out = [(kind, m.start(), m.end()) for kind, (rx, g, least) in kinds.items() for m in rx.finditer(text) if len(m.group(g)) >= least]
    out += [("pem", a, b) for a, b in framed(text)] if "-----BEGIN " in text else []
    out += [("jwt", m.start(), m.end()) for m in _JWT.finditer(text) if is_signed_token(m.group())] if "." in text else []
    return sorted({*out, *_encoded(text)}, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def mask(text: str | None) -> str | None:
    """The text with every span, overlapping ones as one, replaced by the kind of its first."""
    out, at, spans = [], 0, find(text)
    k = 0
    while k < len(spans):
        kind, start, end = spans[k]
        k += 1
        while k < len(spans) and spans[k][1] < end:
            end = max(end, spans[k][2])
            k += 1
        out += [text[at:start], f"[{kind}]"]
        at = end
    return "".join([*out, text[at:]]) if out else text


@F.arrow_udf(SPANS)
def _spans(text: pa.Array) -> pa.Array:
    return pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in find(t)] for t in text.to_pylist()], _ARROW)


@F.arrow_udf(StringType())
def _masked(text: pa.Array) -> pa.Array:
    return pa.array([mask(t) for t in text.to_pylist()], pa.string())


def scan(docs: DataFrame, text: str = "text", out: str = "secrets") -> DataFrame:
    """``docs`` with ``out``: an array of (kind, start, end), never null."""
    return docs.withColumn(out, _spans(F.col(text)))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by its kind in brackets."""
    return docs.withColumn(text, _masked(F.col(text)))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of every span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
