"""Repositories built in a folder, for tests; secrets are put together so that scanners pass over this file."""

from __future__ import annotations

from pathlib import Path

from orelode.decode.envelope import encode_loose
from orelode.decode.tree import encode_tree

AWS = "AK" + "IA" + "0123456789ABCDEF"
GITHUB = "gh" + "p_" + "aB3dE6gH9jK2mN5pQ8sT1vW4yZ7bC0eF3hI6"
SLACK = "xo" + "xb-" + "1234567890-1234567890-" + "AbCdEfGhIjKl"
PEM = "-----BEGIN RSA " + "PRIVATE KEY-----"


class Store:
    def __init__(self, root: Path) -> None:
        self.root = root
        self.git = root / ".git"
        for d in ("objects", "refs/heads", "refs/tags"):
            (self.git / d).mkdir(parents=True, exist_ok=True)
        (self.git / "HEAD").write_text("ref: refs/heads/main\n")
        self.kept: dict[str, tuple[str, bytes]] = {}

    def put(self, kind: str, payload: bytes, write: bool = True) -> str:
        oid, raw = encode_loose(kind, payload)
        self.kept[oid] = (kind, payload)
        if write:
            path = self.git / "objects" / oid[:2] / oid[2:]
            path.parent.mkdir(exist_ok=True)
            path.write_bytes(raw)
        return oid

    def blob(self, data: str | bytes, **k) -> str:
        return self.put("blob", data.encode() if isinstance(data, str) else data, **k)

    def tree(self, *entries: tuple[str, str, str], **k) -> str:
        return self.put("tree", encode_tree([(m, n.encode(), o) for m, n, o in entries]), **k)

    def commit(self, tree: str, *parents: str, at: int | str = 1700000000, **k) -> str:
        who = f"Alice Smith <alice@example.com> {at} +0000"
        head = "".join([f"tree {tree}\n", *(f"parent {p}\n" for p in parents), f"author {who}\n", f"committer {who}\n"])
        return self.put("commit", (head + "\nmessage\n").encode(), **k)

    def ref(self, name: str, oid: str) -> None:
        path = self.git / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(oid + "\n")


def three_states(root: Path) -> tuple[Store, dict[str, str]]:
    s = Store(root)
    a = s.blob(f"line 1\nline 2\nconst token = '{AWS}';\n")
    h = s.blob(f"export T={GITHUB}\n")
    z = s.blob(PEM + "\n")
    old = s.commit(s.tree(("100644", "token.txt", h)), at=1700000100)
    main = s.commit(s.tree(("100644", "config.env", a)), at=1700000000)
    s.ref("refs/heads/main", main)
    s.ref("refs/heads/feature", old)
    return s, {"active": a, "historical": h, "zombie": z}
