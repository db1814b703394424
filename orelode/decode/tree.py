"""Trees: ``mode SP name NUL oid`` repeated; one bad entry fails the whole."""

from __future__ import annotations

from dataclasses import dataclass

MODE_TREE = "40000"
KNOWN_MODES = ("40000", "100644", "100755", "120000", "160000")


@dataclass
class Entry:
    pos: int
    mode: str
    name: bytes
    oid: str
    safety_flag: int
    unknown_mode: bool


def name_safety(name: bytes) -> int:
    """1 empty, 2 ``.``, 3 ``..``, 4 with a slash, else 0."""
    special = {b"": 1, b".": 2, b"..": 3}
    return special.get(name, 4 if b"/" in name else 0)


def parse_tree(payload: bytes) -> list[Entry] | str:
    entries: list[Entry] = []
    at, size = 0, len(payload)
    while at < size:
        space = payload.find(b" ", at)
        if space < 0:
            return "TreeEntryMissingSeparator"
        mode = payload[at:space]
        if not mode or not all(48 <= c <= 57 for c in mode):
            return "TreeEntryMalformedMode"
        nul = payload.find(b"\0", space + 1)
        if nul < 0 or size - nul - 1 < 20:
            return "TruncatedTreeEntry"
        name = payload[space + 1 : nul]
        text = mode.decode()
        entries.append(Entry(len(entries), text, name, payload[nul + 1 : nul + 21].hex(), name_safety(name), text not in KNOWN_MODES))
        at = nul + 21
    return entries


def order_key(entry: Entry) -> bytes:
    """Names sort as bytes, directories as if they ended with a slash."""
    return entry.name + (b"/" if entry.mode == MODE_TREE else b"")


def canonically_sorted(entries: list[Entry]) -> bool:
    """Strictly ascending; equal names count as out of order."""
    return all(order_key(a) < order_key(b) for a, b in zip(entries, entries[1:]))


def encode_tree(entries: list[tuple[str, bytes, str]]) -> bytes:
    return b"".join(m.encode() + b" " + n + b"\0" + bytes.fromhex(o) for m, n, o in entries)


