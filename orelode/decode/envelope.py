"""Loose objects: bounded inflation, the envelope, and the object's name."""

from __future__ import annotations

import hashlib
import re
import zlib
from dataclasses import dataclass

from orelode.limits import MAX_OBJECT_BYTES

TYPES = ("blob", "tree", "commit", "tag")
_OID = re.compile(r"[0-9a-f]{40}\Z")


def is_oid(text: str | None) -> bool:
    return text is not None and bool(_OID.match(text))


def object_name(kind: str, payload: bytes) -> str:
    return hashlib.sha1(b"%s %d\0" % (kind.encode(), len(payload)) + payload).hexdigest()


@dataclass
class Decoded:
    """One object, or the error that kept it from being one."""

    type: str | None = None
    size: int | None = None
    payload: bytes | None = None
    oid: str | None = None
    computed_oid: str | None = None
    integrity_mismatch: bool = False
    trailing_bytes: int = 0
    error: str | None = None


def parse_envelope(data: bytes, max_size: int = MAX_OBJECT_BYTES) -> tuple[str, int, bytes] | str:
    """(type, size, payload), or the name of the first error in the order of checking."""
    head, nul, payload = data.partition(b"\0")
    if not nul:
        return "MissingHeaderTerminator"
    kind, space, digits = head.partition(b" ")
    if not space or kind.decode("latin-1") not in TYPES:
        return "UnknownObjectType"
    if not re.fullmatch(rb"0|[1-9][0-9]*", digits):
        return "MalformedSize"
    size = int(digits)
    if size >= 1 << 63:
        return "MalformedSize"
    if max_size > 0 and size > max_size:
        return "ObjectTooLarge"
    if len(payload) != size:
        return "TruncatedPayload" if len(payload) < size else "TrailingPayloadData"
    return kind.decode(), size, payload


def inflate(raw: bytes, limit: int) -> tuple[bytes, int] | str:
    """(data, unread bytes behind the stream), or an error; never inflates beyond ``limit``."""
    if not raw:
        return "TruncatedZlibStream"
    z = zlib.decompressobj()
    try:
        data = z.decompress(raw, limit + 1)
    except zlib.error as e:
        return "ZlibChecksumFailed" if "incorrect data check" in str(e) else "InvalidZlibStream"
    if len(data) > limit:
        return "ObjectTooLarge"
    if not z.eof:
        try:  # the trailer may still be unread when the data end at the limit
            data += z.decompress(z.unconsumed_tail, 1)
        except zlib.error as e:
            return "ZlibChecksumFailed" if "incorrect data check" in str(e) else "InvalidZlibStream"
        if not z.eof:
            return "TruncatedZlibStream" if len(data) <= limit else "ObjectTooLarge"
    return data, len(z.unused_data)


def decode_loose(raw: bytes, expected_oid: str = "", max_size: int = MAX_OBJECT_BYTES) -> Decoded:
    """A loose file's object.  Bytes behind the stream are counted, not refused;
    a payload that hashes to another name keeps the name of its path."""
    if expected_oid and not is_oid(expected_oid):
        return Decoded(error="InvalidOID")
    got = inflate(raw, (max_size or MAX_OBJECT_BYTES) + 1024)
    if isinstance(got, str):
        return Decoded(oid=expected_oid or None, error=got)
    data, trailing = got
    parsed = parse_envelope(data, max_size or MAX_OBJECT_BYTES)
    if isinstance(parsed, str):
        return Decoded(oid=expected_oid or None, error=parsed)
    kind, size, payload = parsed
    computed = object_name(kind, payload)
    oid = expected_oid or computed
    return Decoded(kind, size, payload, oid, computed, oid != computed, trailing)


def encode_loose(kind: str, payload: bytes) -> tuple[str, bytes]:
    """(name, file content) of an object; the inverse, for tests and fixtures."""
    return object_name(kind, payload), zlib.compress(b"%s %d\0" % (kind.encode(), len(payload)) + payload)
