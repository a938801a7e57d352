"""Secret scans with structural confirmation.

Three base patterns give spans by themselves. Further candidates are confirmed by structure before
they are reported: base64 or hex runs that decode to a key encoding whose nested lengths fill it
exactly (DER private or public keys, OpenSSH key files, SSH public keys), PEM blocks with such a
body, and signed tokens whose header is JSON that names an algorithm.

Defined results: a null or empty text has no spans. Spans are in code points, end exclusive. Spans
of different kinds may overlap; of one kind they don't. Equal starts are in order of KINDS. Rows are
independent, so repeated rows, nulls and other columns need no care.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame

#: Kinds in order: the three base ones, then those that structure confirms.
KINDS = ("assign", "access", "hex", "pem", "jwt", "der", "ssh")
BASE = KINDS[:3]

# Fixed patterns of the base kinds; letters of `assign` in either case are ASCII ones.
ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
# a run that is too short holds no longer one, so the least length may stand in the pattern
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{1,60})-----((?:[A-Za-z0-9+/=\s]|\\+[nrt/])+)-----END \1-----")
JWT = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)(?![A-Za-z0-9_-]|\.[A-Za-z0-9_-])")
RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}(?![A-Za-z0-9+/=_-])")
# lines of base64, one after the other; a key in them ends where its own lengths say
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}(?:[ \t]*[\r\n]\s*[A-Za-z0-9+/_-]+)+={0,2}")
LINE = re.compile(r"[A-Za-z0-9+/_-]+")
#: Line breaks written out, as in JSON and env files.
ESCAPED = re.compile(r"\\+[nr]")
HEX_RUN = re.compile(r"(?:[0-9a-fA-F]{2}){24,}")

# Object identifiers of key algorithms (RSA, EC, DSA, X25519, X448, Ed25519, Ed448), in DER.
ALGORITHMS = {bytes.fromhex(x) for x in ("2a864886f70d010101", "2a8648ce3d0201", "2a8648ce380401", "2b656e", "2b656f", "2b6570", "2b6571")}
# Names of SSH key types.
SSH_TYPES = {b"ssh-rsa", b"ssh-dss", b"ssh-ed25519", b"ssh-ed448", b"ecdsa-sha2-nistp256", b"ecdsa-sha2-nistp384", b"ecdsa-sha2-nistp521", b"sk-ssh-ed25519@openssh.com", b"sk-ecdsa-sha2-nistp256@openssh.com"}


def der(data: bytes, start: int, end: int, depth: int = 0) -> list | None:
    """The elements of a DER run as (tag, content or children); None unless lengths fill it exactly."""
    out, at = [], start
    while at < end:
        if depth > 12 or at + 2 > end:
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > end:
                return None
            size = int.from_bytes(data[at : at + n], "big")
            if size < 0x80:
                return None
            at += n
        if at + size > end:
            return None
        inner = der(data, at, at + size, depth + 1) if tag & 0x20 else data[at : at + size]
        if inner is None:
            return None
        out.append((tag, inner))
        at += size
    return out


def is_key(data: bytes) -> bool:
    """Whether DER bytes are a PKCS#1, PKCS#8, SEC 1 or SubjectPublicKeyInfo key, encrypted PKCS#8 included."""
    if len(data) < 24 or data[0] != 0x30:
        return False
    top = der(data, 0, len(data))
    if not top or len(top) != 1:
        return False
    parts = top[0][1]
    tags = [t for t, _ in parts]

    def algorithm(part) -> bool:
        return part[0] == 0x30 and bool(part[1]) and part[1][0][0] == 0x06 and part[1][0][1] in ALGORITHMS

    if tags and set(tags) == {2}:  # integers only: RSA (9, or 2 if public) or DSA (6)
        return len(tags) in (2, 6, 9) and max(len(v) for _, v in parts) >= 32
    if tags[:3] == [2, 0x30, 4] and algorithm(parts[1]):
        return True
    if tags[:2] == [0x30, 3] and algorithm(parts[0]):
        return True
    if tags == [0x30, 4] and parts[0][1] and parts[0][1][0][0] == 6:  # encrypted: PBES2 or PKCS#12
        return parts[0][1][0][1][:8] == bytes.fromhex("2a864886f70d0105") or parts[0][1][0][1][:9] == bytes.fromhex("2a864886f70d010c01")
    return tags[:2] == [2, 4] and parts[0][1] == b"\x01" and 16 <= len(parts[1][1]) <= 80 and (len(tags) > 2 and tags[2] in (0xA0, 0xA1))


def is_ssh(data: bytes) -> bool:
    """Whether bytes are an OpenSSH private key file or a public key of length-prefixed fields."""
    private = data.startswith(b"openssh-key-v1\0")
    at, fields = 15 if private else 0, []
    while at < len(data):
        if private and len(fields) == 3:
            at += 4  # the number of keys
        if at + 4 > len(data):
            return False
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return False
        fields.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    return len(fields) >= 5 and is_ssh(fields[3]) if private else len(fields) >= 2 and fields[0] in SSH_TYPES


def decoded(text: str) -> bytes | None:
    """Base64 in either alphabet, padded or not; None if it isn't."""
    bare = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(bare) % 4 == 1:
        return None
    try:
        return base64.b64decode(bare + "=" * (-len(bare) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def is_signed(header: str, body: str) -> bool:
    """Whether two parts of a token decode to a JSON header with an algorithm, and to a body."""
    data = decoded(header)
    if data is None or not data.lstrip().startswith(b"{") or decoded(body) is None:
        return False
    try:
        found = json.loads(data)
    except (ValueError, RecursionError):
        return False
    return isinstance(found, dict) and isinstance(found.get("alg"), str)


def _kind(data: bytes | None) -> str | None:
    return None if not data else "der" if is_key(data) else "ssh" if is_ssh(data) else None


def _ends(data: bytes) -> set[int]:
    """Where a key at the start of these bytes may end, by its own lengths."""
    if data[:1] == b"\x30" and len(data) > 2:
        n = data[1] & 0x7F if data[1] & 0x80 else 0
        return {2 + n + (int.from_bytes(data[2 : 2 + n], "big") if n else data[1])} if n <= 4 else set()
    private = data.startswith(b"openssh-key-v1\0")
    at, fields, out = 15 if private else 0, 0, set()
    while True:
        if private and fields == 3:
            at += 4
        if at + 4 > len(data):
            return out
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data) or not private and not fields and data[4 : 4 + size] not in SSH_TYPES:
            return out
        at, fields = at + 4 + size, fields + 1
        out.add(at)


def _joined(text: str, lines: list[tuple[int, int]], first: int, chars: int | None) -> tuple[str, list[int]]:
    """Lines from `first` on, as many as hold `chars` characters (None: all), and the length after each."""
    bare, sizes, size = [], [], 0
    for n in range(first, len(lines)):
        if chars is not None and size >= chars:
            break
        a, b = lines[n]
        size += b - a
        bare.append(text[a:b])
        sizes.append(size)
    return "".join(bare), sizes


def wrapped(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of keys in base64 that is broken over lines."""
    out = []
    for block in WRAPPED.finditer(text):
        lines = [m.span() for m in LINE.finditer(text, *block.span())]
        i = 0
        while i < len(lines):
            # base64 of the first bytes of DER, of an OpenSSH key file and of a public key
            if text.startswith(("M", "b3BlbnNzaC1rZXktdjE", "AAAA"), lines[i][0]):
                # a key of DER tells its length first, so no more lines are read than it has
                head = decoded(_joined(text, lines, i, 44)[0][:44]) or b""
                need = max(_ends(head), default=0) if head[:1] == b"\x30" else None if head[:15] == b"openssh-key-v1\0" or head[4:].startswith(tuple(SSH_TYPES)) else 0
                chars, sizes = _joined(text, lines, i, need and (need * 4 + 2) // 3)
                data = decoded(chars if len(chars) % 4 != 1 else chars[:-1]) or b""
                ends = _ends(data)
                for j in range(1, len(sizes)):
                    if sizes[j] % 4 != 1 and (n := sizes[j] * 3 // 4) in ends and (kind := _kind(data[:n])):
                        end = lines[i + j][1]
                        out.append((lines[i][0], end + len(re.match("={0,2}", text[end : end + 2])[0]), kind))
                        i += j
                        break
            i += 1
    return out


def spans(text: str | None) -> list[tuple[int, int, str]]:
    """(start, number of the kind, end) of every span, in order."""
    if not text:
        return []
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if "-----BEGIN " in text:
        for m in PEM.finditer(text):
            if _kind(decoded(re.sub(r"\\+[nrt]|\\+(?=/)|\s", "", m[2]))):
                out.append((m.start(), 3, m.end()))
    plain = ESCAPED.sub(lambda m: "\n" * len(m[0]), text) if "\\" in text else text  # places stay as they are
    if "ey" in text or "ew" in text:  # base64 of an opening brace
        out += [(m.start(), 4, m.end()) for m in JWT.finditer(plain) if is_signed(m[1], m[2])]
    taken: list[tuple[int, int]] = []
    for m in RUN.finditer(plain):
        if kind := _kind(decoded(m[0])):
            out.append((m.start(), KINDS.index(kind), m.end()))
            taken.append(m.span())
    covered = taken + [(a, b) for a, k, b in out if k == 3]
    for start, end, kind in wrapped(plain) if "\n" in plain or "\r" in plain else ():
        if not any(a < end and start < b for a, b in covered):
            out.append((start, KINDS.index(kind), end))
            taken.append((start, end))
    for m in HEX_RUN.finditer(text):
        if (kind := _kind(bytes.fromhex(m[0]))) and not any(a < m.end() and m.start() < b for a, b in taken):
            out.append((m.start(), KINDS.index(kind), m.end()))
    return sorted(out)


def shown(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, kind, start, end) of every span: one row for each, for tables of findings."""

    def run(batches):
        for batch in batches:
            rows = [(i, KINDS[k], a, b) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for a, k, b in spans(text)]
            yield pa.record_batch([pa.array([r[j] for r in rows], kind) for j, kind in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["id", "kind", "start", "end"])

    return docs.select(docs[id_col].cast("long").alias("id"), text_col).mapInArrow(run, "id long, kind string, start long, end long").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: counts of the base kinds, their digest, and all spans as text."""

    def run(batches):
        for batch in batches:
            found = [spans(t) for t in batch.column(1).to_pylist()]
            base = [[s for s in x if s[1] < 3] for x in found]
            counts = [pa.array([sum(s[1] == k for s in x) for x in base], pa.int64()) for k in range(3)]
            yield pa.record_batch([batch.column(0), *counts, pa.array([hashlib.sha256(shown(x).encode()).hexdigest() for x in base], pa.string()), pa.array([shown(x) for x in found], pa.string())], ["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select(docs[id_col].cast("long").alias("id"), text_col).mapInArrow(run, "id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string").withColumnRenamed("id", id_col)
