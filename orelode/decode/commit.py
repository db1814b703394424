"""Commits and the people in them; errors come in the order of the headers."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from orelode.decode.envelope import is_oid


@dataclass
class Identity:
    name: str
    email: str
    timestamp: int
    zone: str


@dataclass
class Commit:
    tree: str
    parents: list[str]
    author: Identity
    committer: Identity
    extra_headers: list[tuple[str, str]] = field(default_factory=list)
    message: bytes = b""


def parse_identity(line: str, role: str) -> Identity | str:
    """``name <mail> seconds zone``, read from the right; the zone is judged first."""
    bad = f"CommitMalformed{role}Line"
    text = line.strip()
    rest, space, zone = text.rpartition(" ")
    if not space:
        return bad
    if not re.fullmatch(r"[+-][0-9]{4}", zone):
        return "CommitMalformedTimezone"
    rest = rest.rstrip()
    who, space, seconds = rest.rpartition(" ")
    if not space:
        return bad
    if not re.fullmatch(r"[0-9]+", seconds) or int(seconds) >= 1 << 63:
        return "CommitMalformedTimestamp"
    opened, closed = who.rfind("<"), who.rfind(">")
    if opened < 0 or closed < 0 or opened >= closed:
        return bad
    return Identity(who[:opened].strip(), who[opened + 1 : closed], int(seconds), zone)


def _headers(block: bytes) -> list[tuple[str, str]] | str:
    found: list[tuple[str, str]] = []
    for line in block.decode("utf-8", "replace").split("\n"):
        if not line:
            continue
        if line[0] == " ":  # goes on from the header before
            if not found:
                return "CommitMalformedHeaderLine"
            found[-1] = (found[-1][0], found[-1][1] + "\n" + line[1:])
            continue
        key, space, value = line.partition(" ")
        if not space:
            return "CommitMalformedHeaderLine"
        found.append((key, value))
    return found


def parse_commit(payload: bytes) -> Commit | str:
    if not payload:
        return "CommitMissingTree"
    block, gap, message = payload.partition(b"\n\n")
    if not gap:
        return "CommitMissingMessageSeparator"
    headers = _headers(block)
    if isinstance(headers, str):
        return headers
    if not headers or headers[0][0] != "tree":
        return "CommitMissingTree"
    tree = headers[0][1]
    if not is_oid(tree):
        return "CommitMalformedTreeRef"
    parents: list[str] = []
    people: dict[str, Identity] = {}
    extra: list[tuple[str, str]] = []
    for key, value in headers[1:]:
        if key == "tree":
            return "CommitMalformedHeaderLine"
        if key == "parent":
            if not is_oid(value):
                return "CommitMalformedParentRef"
            parents.append(value)
        elif key in ("author", "committer"):
            role = key.capitalize()
            if key in people:
                return f"CommitDuplicate{role}"
            person = parse_identity(value, role)
            if isinstance(person, str):
                return person
            people[key] = person
        else:
            extra.append((key, value))
    for key in ("author", "committer"):
        if key not in people:
            return f"CommitMissing{key.capitalize()}"
    return Commit(tree, parents, people["author"], people["committer"], extra, message)


def tag_target(payload: bytes) -> str | None:
    """The object a tag names in its first line."""
    first = payload.split(b"\n", 1)[0].decode("latin-1")
    key, _, oid = first.partition(" ")
    oid = oid.strip()
    return oid if key == "object" and is_oid(oid) else None
