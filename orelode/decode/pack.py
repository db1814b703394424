"""Pack containers: entries in offset order, deltas resolved in one pass.

Bases lie before their deltas, so one forward pass over the entries with a
memory of what lies behind resolves every chain, and nothing recurses.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable
from dataclasses import dataclass, field

from orelode.decode.envelope import object_name
from orelode.limits import MAX_DELTA_DEPTH, MAX_OBJECT_BYTES, MAX_OFFSET_BYTES, MAX_PACK_BYTES, MAX_SIZE_BYTES, MAX_TARGET_BYTES

KINDS = {1: "commit", 2: "tree", 3: "blob", 4: "tag"}
OFS_DELTA, REF_DELTA = 6, 7
_STEP = 64 * 1024


@dataclass
class PackEntry:
    offset: int
    type: int
    declared_size: int
    base_offset: int = 0
    ref_base_oid: str = ""
    data: bytes = b""
    header_error: str | None = None
    size_error: str | None = None
    resolution_error: str | None = None


@dataclass
class PackResult:
    version: int = 0
    declared: int = 0
    decoded: int = 0
    stored_checksum: str = ""
    computed_checksum: str = ""
    objects: list[tuple[str, str, bytes, int]] = field(default_factory=list)  # oid, type, payload, offset
    gaps: list[tuple[str, str, str]] = field(default_factory=list)
    anomalies: list[tuple[str, str, str]] = field(default_factory=list)
    error: str | None = None


class _End(Exception):
    """The pack ends within a number."""


def _size(data: bytes, at: int, end: int) -> tuple[int, int, int]:
    """(type, size, next offset) of an entry's first bytes."""
    if at >= end:
        raise _End
    c = data[at]
    kind, size, shift = (c >> 4) & 7, c & 15, 4
    at += 1
    more = 0
    while c & 0x80:
        more += 1
        if more > MAX_SIZE_BYTES:
            raise OverflowError
        if at >= end:
            raise _End
        c = data[at]
        size |= (c & 0x7F) << shift
        shift += 7
        at += 1
    return kind, size, at


def base_distance(data: bytes, at: int, end: int) -> tuple[int, int]:
    """(distance to the base, next offset); each further byte adds one before it shifts."""
    if at >= end:
        raise _End
    c = data[at]
    value = c & 0x7F
    at += 1
    more = 0
    while c & 0x80:
        more += 1
        if more > MAX_OFFSET_BYTES:
            raise OverflowError
        if at >= end:
            raise _End
        c = data[at]
        value = ((value + 1) << 7) | (c & 0x7F)
        at += 1
    return value, at


def encode_distance(n: int) -> bytes:
    out = [n & 0x7F]
    n >>= 7
    while n:
        n -= 1
        out.append(0x80 | (n & 0x7F))
        n >>= 7
    return bytes(reversed(out))


def _inflate_at(data: bytes, at: int, end: int, limit: int) -> tuple[bytes, int] | str:
    """(inflated, next offset), fed in steps so that the rest of the pack is never copied."""
    z = zlib.decompressobj()
    out = bytearray()
    while not z.eof:
        if at >= end:
            return "unexpected EOF"
        step = data[at : min(end, at + _STEP)]
        try:
            out += z.decompress(step, limit + 1 - len(out))
            while z.unconsumed_tail and len(out) <= limit:
                out += z.decompress(z.unconsumed_tail, limit + 1 - len(out))
        except zlib.error as e:
            return f"zlib: {e}"
        if len(out) > limit:
            return f"decompressed size {len(out)} exceeds safety limit {limit}"
        at += len(step) - len(z.unused_data)
    return bytes(out), at


def _delta_size(d: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(d) or shift > 63:
            raise _End
        c = d[at]
        at += 1
        value |= (c & 0x7F) << shift
        shift += 7
        if not c & 0x80:
            return value, at


def apply_delta(base: bytes, d: bytes, limit: int = MAX_TARGET_BYTES) -> bytes | str:
    """The target, or an error's name."""
    try:
        source, at = _delta_size(d, 0)
        if source != len(base):
            return "DeltaBaseSizeMismatch"
        target, at = _delta_size(d, at)
    except _End:
        return "TruncatedDeltaInstruction"
    if target > limit:
        return "PackEntrySizeTooLarge"
    out = bytearray()
    while at < len(d) and len(out) < target:
        op = d[at]
        at += 1
        if op & 0x80:
            fields = []
            for bits, width in ((op & 15, 4), ((op >> 4) & 7, 3)):
                value = 0
                for i in range(width):
                    if bits >> i & 1:
                        if at >= len(d):
                            return "TruncatedDeltaInstruction"
                        value |= d[at] << (8 * i)
                        at += 1
                fields.append(value)
            start, n = fields[0], fields[1] or 65536
            if start + n > len(base):
                return "DeltaCopyOutOfBounds"
            piece = base[start : start + n]
        elif op:
            if at + op > len(d):
                return "TruncatedDeltaInstruction"
            piece = d[at : at + op]
            at += op
        else:
            return "InvalidDeltaInstruction"
        if len(out) + len(piece) > target:
            return "DeltaReconstructionSizeMismatch"
        out += piece
    if len(out) != target:
        return "DeltaReconstructionSizeMismatch"
    return bytes(out) if at == len(d) else "DeltaTrailingInstructionData"


def resolve_entries(entries: Iterable[PackEntry], max_depth: int = MAX_DELTA_DEPTH) -> PackResult:
    """Objects of entries in any order; each entry's error is its own."""
    result = PackResult()
    by = {e.offset: e for e in entries}
    known: dict[int, tuple[str, bytes] | str] = {}
    for start in sorted(by):
        chain: list[PackEntry] = []
        at = start
        while at not in known:
            e = by.get(at)
            fault = None
            if e is None:
                fault = "InvalidOfsDeltaOffset"
            elif e.header_error or e.size_error or e.resolution_error:
                fault = e.header_error or e.size_error or e.resolution_error
            elif e.type in KINDS:
                known[at] = (KINDS[e.type], e.data)
                break
            elif e.type == REF_DELTA:
                fault = "UnsupportedRefDelta"
            elif e.type != OFS_DELTA:
                fault = "InvalidPackEntryType"
            elif any(c.offset == at for c in chain):
                fault = "DeltaChainCycleDetected"
            elif len(chain) >= max_depth:
                fault = "MaxDeltaDepthExceeded"
            if fault:
                known[at] = fault
                break
            chain.append(e)
            at = e.base_offset
        for e in reversed(chain):
            if e.offset in known and isinstance(known[e.offset], str):
                continue
            base = known[e.base_offset]
            if isinstance(base, str):
                known[e.offset] = base
            else:
                made = apply_delta(base[1], e.data)
                known[e.offset] = made if isinstance(made, str) else (base[0], made)
    for offset in sorted(by):
        e, got = by[offset], known[offset]
        if not isinstance(got, str):
            result.objects.append((object_name(*got), got[0], got[1], offset))
        elif e.type == REF_DELTA and got == "UnsupportedRefDelta":
            result.gaps.append(("unresolvedPackOnly", f"pack_offset:{offset}", f"unsupported REF_DELTA targeting base {e.ref_base_oid}"))
        else:
            result.anomalies.append(("CORRUPTED_PACK_ENTRY", f"pack_offset:{offset}", f"failed to resolve pack entry at offset {offset}: {got}"))
    return result


def parse_pack(data: bytes, path: str, max_object: int = MAX_OBJECT_BYTES, max_depth: int = MAX_DELTA_DEPTH, max_pack: int = MAX_PACK_BYTES) -> PackResult:
    """All that one pack holds.  Faults of the frame end the reading, faults of an entry do not."""
    if len(data) > max_pack:
        said = f"pack file size ({len(data)} bytes) exceeds safety ceiling ({max_pack} bytes)"
        return PackResult(gaps=[("packTooLarge", path, said)], anomalies=[("PACK_TOO_LARGE", path, said)])
    if len(data) < 32 or data[:4] != b"PACK":
        return PackResult(error="NotAPackFile")
    version, declared = int.from_bytes(data[4:8]), int.from_bytes(data[8:12])
    if version != 2:
        return PackResult(version=version, error="UnsupportedPackVersion")
    end = len(data) - 20
    stored, computed = data[end:].hex(), hashlib.sha1(memoryview(data)[:end]).hexdigest()
    frame: list[tuple[str, str, str]] = []
    if stored != computed:
        frame.append(("PACK_CHECKSUM_MISMATCH", path, f"pack checksum mismatch: stored {stored}, computed {computed}"))
    entries: list[PackEntry] = []
    at = 12

    def broken(start: int, what: str) -> None:
        frame.append(("PACK_TRUNCATED_OR_CORRUPTED", f"{path}:{start}", what))

    while len(entries) < declared and at < end:
        start = at
        try:
            kind, size, at = _size(data, at, end)
        except (OverflowError, _End) as e:
            broken(start, f"pack entry header error at offset {start}: {'PackEntrySizeTooLarge' if isinstance(e, OverflowError) else 'TruncatedPackEntry'}")
            break
        if kind in (0, 5):
            broken(start, f"invalid pack entry type {kind} at offset {start}")
            break
        entry = PackEntry(start, kind, size)
        if kind == OFS_DELTA:
            try:
                distance, at = base_distance(data, at, end)
                entry.base_offset = start - distance
                if distance <= 0 or entry.base_offset < 12:
                    entry.header_error = "InvalidOfsDeltaOffset"
            except OverflowError:
                entry.header_error = "InvalidOfsDeltaOffset"
                at += 1 + MAX_OFFSET_BYTES
            except _End:
                entry.header_error = "TruncatedOfsDeltaOffset"
                entries.append(entry)
                broken(start, "truncated OFS_DELTA offset")
                at = end
                break
        elif kind == REF_DELTA:
            if at + 20 > end:
                broken(start, "truncated REF_DELTA base OID")
                break
            entry.ref_base_oid = data[at : at + 20].hex()
            at += 20
        got = _inflate_at(data, at, end, max_object)
        if isinstance(got, str):
            broken(start, f"zlib inflate failed at offset {start}: {got}" if not got.startswith("decompressed") else got)
            break
        entry.data, at = got
        if len(entry.data) != size:
            entry.size_error = "PackObjectSizeMismatch"
        entries.append(entry)
    if len(entries) != declared:
        frame.append(("PACK_COUNT_MISMATCH", path, f"pack entry count mismatch: declared {declared}, successfully parsed {len(entries)}"))
    elif at < end:
        broken(at, f"packfile has {end - at} unparsed trailing bytes before checksum (offset {at}, checksum starts at {end})")
    result = resolve_entries(entries, max_depth)
    result.version, result.declared, result.decoded = version, declared, len(entries)
    result.stored_checksum, result.computed_checksum = stored, computed
    result.anomalies = frame + result.anomalies
    return result


def encode_entry(kind: int, data: bytes, extra: bytes = b"") -> bytes:
    """One entry's bytes, for tests and fixtures."""
    n = len(data)
    first = (kind << 4) | (n & 15)
    n >>= 4
    out = bytearray()
    while n:
        out.append(first | 0x80)
        first = n & 0x7F
        n >>= 7
    out.append(first)
    return bytes(out) + extra + zlib.compress(data)


def encode_pack(entries: list[bytes], declared: int | None = None, version: int = 2) -> bytes:
    body = b"PACK" + version.to_bytes(4) + (len(entries) if declared is None else declared).to_bytes(4) + b"".join(entries)
    return body + hashlib.sha1(body).digest()
