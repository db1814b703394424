"""Finding a repository and reading its references: small, and on the driver.

Nothing here writes below the repository.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field
from pathlib import Path

from orelode.decode.envelope import is_oid
from orelode.limits import MAX_SYMBOLIC_DEPTH


class RepositoryNotFound(Exception):
    pass


class RefError(Exception):
    pass


class RefMissing(RefError):
    pass


@dataclass
class Repository:
    worktree_root: str
    git_dir: str
    common_dir: str
    is_bare: bool


def _git_file_target(path: Path) -> Path | None:
    """Where a ``.git`` file of a linked worktree points."""
    text = path.read_text(errors="replace").strip()
    if not text.startswith("gitdir:"):
        return None
    target = text[len("gitdir:") :].strip()
    return Path(os.path.normpath(path.parent / target)) if target else None


def _common_dir(git_dir: Path) -> Path:
    try:
        text = (git_dir / "commondir").read_text().strip()
    except OSError:
        return git_dir
    return Path(os.path.normpath(git_dir / text)) if text else git_dir


def _is_bare(path: Path) -> bool:
    return (path / "HEAD").exists() and (path / "objects").is_dir() and (path / "refs").is_dir()


def discover(start: str) -> Repository:
    """The repository at ``start`` or above it."""
    at = Path(os.path.abspath(start))
    if not at.exists():
        raise RepositoryNotFound(f"path does not exist: {start}")
    for here in (at, *at.parents):
        dot = here / ".git"
        if dot.is_dir():
            return Repository(str(here), str(dot), str(_common_dir(dot)), False)
        if dot.is_file() and (target := _git_file_target(dot)) is not None:
            return Repository(str(here), str(target), str(_common_dir(target)), False)
        if _is_bare(here):
            return Repository(str(here), str(here), str(_common_dir(here)), True)
    raise RepositoryNotFound(f"git repository not found: {start}")


def check_ref_name(name: str) -> None:
    if not name:
        raise RefError("empty ref name")
    if "\\" in name or ":" in name:
        raise RefError(f'invalid characters in ref name "{name}"')
    if name.startswith("/"):
        raise RefError(f'ref name "{name}" cannot be an absolute path')
    if any(part in ("", ".", "..") for part in name.split("/")):
        raise RefError(f'ref name "{name}" contains invalid path traversal segments')
    if name != "HEAD" and not name.startswith("refs/"):
        raise RefError(f'ref name "{name}" must start with refs/')


@dataclass
class Refs:
    by_name: dict[str, str] = field(default_factory=dict)
    origin: dict[str, str] = field(default_factory=dict)
    anomalies: list[tuple[str, str, str]] = field(default_factory=list)


def parse_packed_refs(text: str) -> Refs:
    found = Refs()

    def bad(line: int, what: str) -> None:
        found.anomalies.append(("MALFORMED_PACKED_REF", f"packed-refs:{line}", what))

    for number, line in enumerate(text.split("\n"), 1):
        line = line.rstrip("\r")
        if not line.strip() or line.startswith("#"):
            continue
        if line.startswith("^"):
            if not is_oid(line[1:].strip()):
                bad(number, f"invalid peeled OID: {line[1:].strip()}")
            continue
        oid, space, name = line.partition(" ")
        if not space:
            bad(number, "missing space separator")
        elif not is_oid(oid):
            bad(number, f"invalid OID: {oid}")
        else:
            found.by_name[name.strip()] = oid
            found.origin[name.strip()] = "packed"
    return found


def _packed(repo: Repository) -> Refs:
    path = Path(repo.common_dir, "packed-refs")
    try:
        return parse_packed_refs(path.read_text(errors="replace"))
    except FileNotFoundError:
        return Refs()
    except OSError as e:
        return Refs(anomalies=[("MALFORMED_PACKED_REF", str(path), str(e))])


def resolve_symbolic(repo: Repository, name: str, depth: int = MAX_SYMBOLIC_DEPTH) -> str:
    """The OID a name leads to; a malformed loose file is an error even if a packed one is sound."""
    seen: set[str] = set()
    packed: Refs | None = None
    for _ in range(depth):
        check_ref_name(name)
        if name in seen:
            raise RefError("symbolic ref cycle detected")
        seen.add(name)
        loose = Path(repo.common_dir, name)
        if loose.is_file():
            content = loose.read_text(errors="replace").strip()
            if content.startswith("ref:"):
                name = content[4:].strip()
                continue
            if not is_oid(content):
                raise RefError(f'malformed OID in ref "{name}"')
            return content
        packed = packed or _packed(repo)
        if name in packed.by_name:
            return packed.by_name[name]
        raise RefMissing("object not found")
    raise RefError("symbolic ref cycle detected")


def resolve_head(repo: Repository) -> tuple[str, bool]:
    """(OID, unborn): a symbolic HEAD whose target is missing is unborn, which is valid."""
    content = Path(repo.git_dir, "HEAD").read_text(errors="replace").strip()
    if not content:
        raise RefError("empty HEAD file")
    if content.startswith("ref:"):
        target = content[4:].strip()
        if not target:
            raise RefError("malformed symbolic HEAD")
        try:
            return resolve_symbolic(repo, target), False
        except RefMissing:
            return "", True
    if not is_oid(content):
        raise RefError("malformed detached HEAD OID: invalid object ID")
    return content, False


def all_refs(repo: Repository) -> Refs:
    """Packed references, overridden by loose ones; a malformed loose one leaves the packed one."""
    found = _packed(repo)
    root = Path(repo.common_dir, "refs")
    for path in sorted(p for p in root.rglob("*") if p.is_file()) if root.is_dir() else []:
        name = path.relative_to(repo.common_dir).as_posix()
        try:
            content = path.read_text(errors="replace").strip()
            if content.startswith("ref:"):
                oid = resolve_symbolic(repo, content[4:].strip())
            elif is_oid(content):
                oid = content
            else:
                raise RefError(f"invalid OID: {content}")
        except (RefError, OSError) as e:
            found.anomalies.append(("MALFORMED_REF", name, str(e)))
            continue
        found.by_name[name] = oid
        found.origin[name] = "loose"
    return found


LOOSE_GLOB = re.compile(r".*/([0-9a-fA-F]{2})/([0-9a-fA-F]{38})$")
