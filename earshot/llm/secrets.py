"""Secret scanning by structural confirmation: candidates are decoded and parsed, and only those that hold together are reported."""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

_MARK = re.compile(r"-----(?P<kind>BEGIN|END) (?P<label>[A-Z0-9 ]*PRIVATE KEY)-----", re.IGNORECASE)
#: No quantifier gives back what it took where another could take it, so each character is looked at a bounded number of times.
_ASSIGNED = re.compile(r"(?:token|secret|api[_-]?key|access[_-]?key|private[_-]?key|signing[_-]?key|auth|passw(?:or)?d)\b[\"']?\s{0,4}(?::=|=>|=|:)\s{0,4}[\"']?([A-Za-z0-9+/_\-]{16,}+={0,2}+)(?!\.?[A-Za-z0-9+/_\-])", re.IGNORECASE)
_RUN = re.compile(r"[A-Za-z0-9+/_\-]{20,}+(?:\.[A-Za-z0-9+/_\-]*+){0,4}+={0,2}+")
#: A line of base64 and nothing else; a block of them is a wrapped key if the first is long.
_LINE = re.compile(r"^[ \t]*([A-Za-z0-9+/_\-]{2,}+={0,2}+)[ \t]*(?:\r?\n|\Z)", re.MULTILINE)
_LONG_LINE = re.compile(r"^[ \t]*[A-Za-z0-9+/_\-]{40,}+[ \t]*\r?\n", re.MULTILINE)
#: A text without any of these has no candidate; the scan for it is a fraction of the full one's.
_HINT = re.compile(r"[A-Za-z0-9+/_\-]{16}|-----BEGIN ")
_HEX = re.compile(r"(?:[0-9a-f]{2})+|(?:[0-9A-F]{2})+")
#: The usual lengths of keys. Assigned base64 of another length must also look random by its characters, as names and words decode too.
KEY_BYTES = frozenset({16, 20, 24, 30, 32, 40, 48, 64})
#: The longest key that is looked for in a block of wrapped lines which has other lines too: an RSA key of 32,768 bits has 18 KB.
MOST_WRAPPED = 1 << 15
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def unhex(s: str) -> bytes | None:
    return bytes.fromhex(s) if _HEX.fullmatch(s) else None


def unbase64(s: str) -> bytes | None:
    """Decode either alphabet, padded or not; None where it isn't base64."""
    s = s.rstrip("=").replace("-", "+").replace("_", "/")
    if len(s) % 4 == 1:
        return None
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _element(b: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the content of the DER element at ``at``; None unless it fits before ``end``."""
    if at + 2 > end:
        return None
    tag, n, at = b[at], b[at + 1], at + 2
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or at + k > end or b[at] == 0:
            return None
        n, at = int.from_bytes(b[at : at + k], "big"), at + k
        if n < 0x80:
            return None
    return (tag, at, at + n) if at + n <= end else None


def _children(b: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    out = []
    while at < end:
        x = _element(b, at, end)
        if x is None:
            return None
        out.append(x)
        at = x[2]
    return out


_RSA = {bytes.fromhex("2a864886f70d010101"), bytes.fromhex("2a864886f70d01010a")}
_EC, _INTEGER = bytes.fromhex("2a8648ce3d0201"), {bytes.fromhex("2a8648ce380401"), bytes.fromhex("2a864886f70d010301")}
#: X25519, X448, Ed25519 and Ed448, and the bytes of their keys.
_EDWARDS = {bytes.fromhex("2b656e"): 32, bytes.fromhex("2b656f"): 56, bytes.fromhex("2b6570"): 32, bytes.fromhex("2b6571"): 57}


def _payload(oid: bytes, b: bytes) -> bool:
    """Whether ``b`` is the key that a PKCS#8 of this algorithm holds; of an unknown algorithm, one whole element with elements in it or an integer or octets."""
    if oid in _RSA:
        return der_key(b) == "rsa_private_key"
    if oid == _EC:
        return der_key(b) == "ec_private_key"
    top = _element(b, 0, len(b))
    if top is None or top[2] != len(b):
        return False
    if oid in _EDWARDS:
        return top[0] == 0x04 and top[2] - top[1] == _EDWARDS[oid]
    if oid in _INTEGER:
        return top[0] == 0x02 and top[2] - top[1] >= 16
    return top[2] - top[1] >= 16 and (top[0] in (0x02, 0x04) or (top[0] == 0x30 and bool(_children(b, *top[1:]))))


def der_key(b: bytes) -> str | None:
    """The kind of private key whose DER encoding is exactly ``b``, by nested tags and lengths."""
    top = _element(b, 0, len(b))
    if top is None or top[0] != 0x30 or top[2] != len(b):
        return None
    inner = _children(b, top[1], top[2])
    if not inner:
        return None
    tags = [t for t, _, _ in inner]
    small = lambda x: x[0] == 0x02 and x[2] - x[1] == 1
    if len(inner) >= 9 and set(tags[:9]) == {0x02} and small(inner[0]) and b[inner[0][1]] in (0, 1):
        modulus, primes = inner[1][2] - inner[1][1], [x[2] - x[1] for x in inner[4:6]]
        return "rsa_private_key" if modulus >= 32 and all(2 * p >= modulus - 4 and p <= modulus for p in primes) else None
    if len(inner) == 6 and set(tags) == {0x02} and small(inner[0]) and b[inner[0][1]] == 0 and inner[1][2] - inner[1][1] >= 64:
        return "dsa_private_key"
    if len(inner) >= 3 and small(inner[0]) and b[inner[0][1]] in (0, 1) and tags[1] == 0x30 and tags[2] == 0x04:
        algorithm = _children(b, *inner[1][1:])
        return "pkcs8_private_key" if algorithm and algorithm[0][0] == 0x06 and _payload(b[slice(*algorithm[0][1:])], b[slice(*inner[2][1:])]) else None
    if len(inner) >= 2 and small(inner[0]) and b[inner[0][1]] == 1 and tags[1] == 0x04 and inner[1][2] - inner[1][1] in (20, 24, 28, 32, 48, 66) and set(tags[2:]) <= {0xA0, 0xA1}:
        return "ec_private_key"
    if len(inner) == 2 and tags == [0x30, 0x04]:
        algorithm = _children(b, *inner[0][1:])
        return "encrypted_private_key" if algorithm and algorithm[0][0] == 0x06 and len(algorithm) == 2 and inner[1][2] - inner[1][1] >= 16 else None
    return None


def _strings(b: bytes, at: int, most: int | None = None) -> tuple[list[bytes], int]:
    """Strings with a length before them, as many as follow one another from ``at``, and where they end."""
    out: list[bytes] = []
    while (most is None or len(out) < most) and at + 4 <= len(b):
        n = struct.unpack(">I", b[at : at + 4])[0]
        if at + 4 + n > len(b):
            break
        at += 4 + n
        out.append(b[at - n : at])
    return out, at


def openssh_key(b: bytes) -> str | None:
    """The OpenSSH container: magic, cipher, KDF and options, and keys whose lengths add up to the whole.

    An open private part has two equal check integers, fields that begin with a type, and padding that counts 1, 2, 3; an
    encrypted one is a whole number of the cipher's blocks and names its key derivation.
    """
    magic = b"openssh-key-v1\0"
    if not b.startswith(magic):
        return None
    head, at = _strings(b, len(magic), 3)
    if len(head) < 3 or at + 4 > len(b):
        return None
    count = struct.unpack(">I", b[at : at + 4])[0]
    if not 1 <= count <= 64:
        return None
    keys, at = _strings(b, at + 4, count + 1)
    if len(keys) < count + 1 or at != len(b) or any(not _strings(k, 0, 1)[0] for k in keys[:-1]):
        return None
    inner = keys[-1]
    if head[0] != b"none":
        return "openssh_private_key" if head[1] == b"bcrypt" and len(inner) >= 16 and len(inner) % 8 == 0 and len(_strings(head[2], 0, 1)[0]) == 1 else None
    if head[1] != b"none" or len(inner) < 8 or inner[:4] != inner[4:8] or len(inner) % 8:
        return None
    fields, end = _strings(inner, 8)
    padding = inner[end:]
    named = _strings(keys[0], 0, 1)[0][0]
    return "openssh_private_key" if len(fields) >= 3 * count and fields[0] == named and padding == bytes(range(1, len(padding) + 1)) else None


def _object(b: bytes) -> dict | None:
    try:
        x = json.loads(b)
    except (ValueError, RecursionError):
        return None
    return x if isinstance(x, dict) else None


def signed_token(s: str) -> str | None:
    """A compact JWS (a header object with an algorithm, a payload object, and a signature) or JWE (a header with algorithm and encryption, key, nonce, text and tag)."""
    parts = s.split(".")
    if len(parts) not in (3, 5) or (decoded := [unbase64(p) for p in parts]).count(None):
        return None
    header = _object(decoded[0])
    if header is None or not isinstance(header.get("alg"), str) or header["alg"].lower() == "none":
        return None
    if len(parts) == 3:
        return "signed_token" if len(decoded[2]) >= 16 and _object(decoded[1]) is not None else None
    direct = header["alg"] in ("dir", "ECDH-ES")
    ok = isinstance(header.get("enc"), str) and (not decoded[1] if direct else len(decoded[1]) >= 16) and 8 <= len(decoded[2]) <= 32 and decoded[3] and len(decoded[4]) >= 16
    return "encrypted_token" if ok else None


def checked_token(s: str) -> str | None:
    """Tokens whose own layout can be checked: a CRC in base 62 at the end, or an access key id in base 32 whose account has 12 digits at most."""
    if re.fullmatch(r"gh[pousr]_[A-Za-z0-9]{36}", s):
        crc, digits = zlib.crc32(s[4:34].encode()), ""
        while crc:
            crc, d = divmod(crc, 62)
            digits = _BASE62[d] + digits
        return "checksummed_token" if digits.rjust(6, "0") == s[34:40] else None
    if re.fullmatch(r"(?:AKIA|ASIA)[A-Z2-7]{16}", s):
        account = (int.from_bytes(base64.b32decode(s[4:])[:6], "big") & 0x7FFFFFFFFF80) >> 7
        return "access_key_id" if account < 10**12 else None
    return None


def _varied(b: bytes) -> bool:
    """Random bytes: few repeats, and neither a text nor a run."""
    return len(set(b)) >= min(len(b), 64) * 5 // 8 and sum(32 <= x < 127 for x in b) < 0.9 * len(b)


def _mixed(s: str) -> bool:
    """Base64 by its characters: upper and lower case and digits or signs, which change about as often as by chance."""
    plain = [c for c in s.rstrip("=") if c.isalnum()]
    kind = ["a" if c.islower() else "A" if c.isupper() else "0" for c in plain]
    return len(set(kind)) == 3 and len(plain) >= 0.8 * len(s.rstrip("=")) and sum(a != b for a, b in zip(kind, kind[1:])) >= 0.42 * (len(kind) - 1)


def _block(body: str) -> tuple[str, str, bytes] | None:
    """What lies between the marks of a PEM block; in JSON and such its line feeds are written as two characters."""
    body = body.replace("\\r", "").replace("\\n", "\n")
    b = unbase64("".join("".join(x for x in body.strip().split("\n") if ":" not in x).split()))
    if not b:
        return None
    if kind := der_key(b) or openssh_key(b):
        return kind, "pem", b
    return ("encrypted_private_key", "pem", b) if "ENCRYPTED" in body and len(b) % 8 == 0 and len(b) >= 64 else None


def confirm(value: str | None, run: str | None) -> tuple[str, str, bytes, int] | None:
    """Kind, encoding, decoded bytes and length of a candidate that holds together."""
    s = value or run
    if kind := checked_token(s):
        return kind, "token", s.encode(), len(s)
    if run is not None and "." in s:
        parts = s.rstrip(".").split(".")
        for n in (5, 3):
            if len(parts) >= n and (kind := signed_token(t := ".".join(parts[:n]))):
                return kind, "base64url", t.encode(), len(t)
        s = max(parts, key=len)
    h = unhex(s)
    encoding, b = ("hex", h) if h else ("base64", unbase64(s))
    if b and (kind := der_key(b) or openssh_key(b)):
        return kind, encoding, b, len(value or run)
    if b and value is not None and len(b) >= (16 if h else 12) and _varied(b) and (h or len(b) in KEY_BYTES or _mixed(s)):
        return f"assigned_{encoding}_key", encoding, b, len(s)
    return None


def _wrapped(text: str) -> list[tuple[tuple[str, str, bytes], int, int]]:
    """Keys in base64 that is cut in lines without marks around it."""
    out: list = []
    lines: list[tuple[int, int]] = []

    def close() -> None:
        upto = list(accumulate((b - a for a, b in lines), initial=0))
        i = 0
        while i + 1 < len(lines):
            start, end = lines[i]
            head = unbase64(text[start : start + 24]) if end - start >= 40 else None
            j = 0
            if head and head.startswith(b"openssh-key"):
                j = len(lines)
            elif head and head[0] == 0x30 and (k := head[1] & 0x7F if head[1] & 0x80 else 0) <= 4 and head[2 + k] in (0x02, 0x30):
                # the line in which as many characters are reached as the outer length asks for, but for padding
                size = 2 + k + (int.from_bytes(head[2 : 2 + k], "big") if k else head[1])
                j = bisect_left(upto, upto[i] + -(-4 * size // 3))
            found = None
            if i < j <= len(lines) and (upto[j] - upto[i] <= 2 * MOST_WRAPPED or i == 0):
                b = unbase64("".join(text[x:y] for x, y in lines[i:j]))
                found = b and (der_key(b) or openssh_key(b))
            if found:
                out.append(((found, "base64", b), start, lines[j - 1][1]))
                i = j
            else:
                i += 1

    if _LONG_LINE.search(text):
        before = -1
        for m in _LINE.finditer(text):
            if m.start() != before:
                close()
                lines = []
            lines.append(m.span(1))
            before = m.end()
        close()
    return out


def scan(text: str) -> list[tuple[str, str, int, int, str]]:
    """All confirmed secrets of a text: kind, encoding, start and end (characters), and a digest that doesn't disclose it.

    Marked blocks first, then wrapped lines, then single values in what is left. The time is in proportion to the text.
    """
    taken: list[tuple[tuple[str, str, bytes], int, int]] = []
    if "PRIVATE KEY-----" in text.upper():
        mark = None
        for m in _MARK.finditer(text):
            # a block holds no mark but its end's, so no text is tried twice
            if m["kind"].upper() == "END" and mark is not None and mark["label"] == m["label"] and (found := _block(text[mark.end() : m.start()])):
                taken.append((found, mark.start(), m.end()))
            mark = m if m["kind"].upper() == "BEGIN" else None
    free = lambda a, b: all(b <= x or a >= y for _, x, y in taken)
    taken += [w for w in _wrapped(text) if free(*w[1:])]
    taken.sort(key=lambda x: x[1])
    for assigned, pattern in ((True, _ASSIGNED), (False, _RUN)):
        more, n = [], 0
        for m in pattern.finditer(text):
            start, s = m.start(int(assigned)), m[int(assigned)]
            while n < len(taken) and taken[n][2] <= start:
                n += 1
            if (n == len(taken) or start + len(s) <= taken[n][1]) and (found := confirm(s, None) if assigned else confirm(None, s)):
                more.append((found[:3], start, start + found[3]))
        taken = sorted([*taken, *more], key=lambda x: x[1])
    return [(kind, encoding, start, end, hashlib.sha256(b).hexdigest()[:16]) for (kind, encoding, b), start, end in taken]


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The confirmed secrets of all documents: ``id_col``, kind, encoding, start, stop, digest; one row each.

    Candidates are blocks of PEM, lines of wrapped base64, values of 16 characters and more that are assigned to a name like
    token or api_key, and runs of 20 and more of base64 or hex digits. Reported are only those that parse once decoded: DER
    private keys whose nested lengths add up, with the key that their algorithm wants inside; OpenSSH containers, with their
    private part; signed and encrypted tokens with a JSON header that names an algorithm; tokens with a right checksum; and
    assigned values of any length whose bytes look random. One pass over the whole texts, no shuffle, in time that grows
    with the text. start and stop count characters.

    Null and empty texts hold nothing. Repeated rows are reported each. A null id is kept. Other columns are left out. An
    empty input gives an empty result.
    """
    source = docs.select(id_col, text_col)
    schema = T.StructType([source.schema[id_col], T.StructField("kind", T.StringType()), T.StructField("encoding", T.StringType()), T.StructField("start", T.LongType()), T.StructField("stop", T.LongType()), T.StructField("digest", T.StringType())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whose, found = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                if text and _HINT.search(text):
                    rows = scan(text)
                    whose += [i] * len(rows)
                    found += rows
            cols = list(zip(*found)) if found else [()] * 5
            types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(whose, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, types))], names=schema.names)

    return source.mapInArrow(task, schema)
