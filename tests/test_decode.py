import zlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from orelode.decode import commit, pack, tree
from orelode.decode.envelope import decode_loose, encode_loose, object_name, parse_envelope


def test_names():
    assert object_name("blob", b"") == "e69de29bb2d1d6434b8b29ae775ad8c2e48c5391"
    assert object_name("blob", b"test content\n") == "d670460b4b4aece5915caf5c68d12f560a9fe3e4"
    assert object_name("tree", b"") == "4b825dc642cb6eb9a060e54bf8d69288fbee4904"


@pytest.mark.parametrize(
    "data, error",
    [
        (b"", "MissingHeaderTerminator"), (b"blob 5hello", "MissingHeaderTerminator"), (b"blob\0", "UnknownObjectType"), (b"blobb 4\0data", "UnknownObjectType"), (b"blob \0", "MalformedSize"), (b"blob abc\0hello", "MalformedSize"),
        (b"blob 00\0", "MalformedSize"), (b"blob " + b"9" * 40 + b"\0", "MalformedSize"), (b"blob 0\0x", "TrailingPayloadData"), (b"blob 1\0", "TruncatedPayload"), (b"blob 999999999\0x", "ObjectTooLarge"),
    ],
)
def test_envelope_errors(data, error):
    assert parse_envelope(data) == error


def test_loose():
    oid, raw = encode_loose("blob", b"hello")
    assert decode_loose(raw, oid).payload == b"hello"
    d = decode_loose(raw + b"tail", oid)
    assert d.trailing_bytes == 4 and d.error is None
    stored = zlib.compressobj(0)
    assert decode_loose(stored.compress(b"blob 1\0x") + stored.flush() + b"yz").trailing_bytes == 2
    assert decode_loose(raw, "0" * 40).integrity_mismatch
    assert decode_loose(raw[:-1] + b"\xff", oid).error == "ZlibChecksumFailed"
    assert decode_loose(raw[:-6], oid).error == "TruncatedZlibStream"
    assert decode_loose(b"nonsense", oid).error == "InvalidZlibStream"
    assert decode_loose(b"", oid).error == "TruncatedZlibStream"
    assert decode_loose(zlib.compress(b"blob 5000\0" + b"a" * 5000), "", 100).error == "ObjectTooLarge"
    assert decode_loose(zlib.compress(b"blob 90\0" + b"a" * 90), "", 100).error is None


def test_tree():
    one = "1" * 40
    modes = [(m, b"n" + m.encode(), one) for m in tree.KNOWN_MODES]
    got = tree.parse_tree(tree.encode_tree(modes))
    assert [e.mode for e in got] == list(tree.KNOWN_MODES) and not any(e.unknown_mode for e in got)
    assert tree.parse_tree(b"") == [] and tree.canonically_sorted([])
    assert [e.safety_flag for e in tree.parse_tree(tree.encode_tree([("100644", n, one) for n in (b"", b".", b"..", b"a/b", b"ok")]))] == [1, 2, 3, 4, 0]
    assert tree.parse_tree(tree.encode_tree([("100664", b"x", one)]))[0].unknown_mode
    assert tree.parse_tree(tree.encode_tree([("040000", b"x", one)]))[0].unknown_mode
    assert tree.parse_tree(b"100644") == "TreeEntryMissingSeparator"
    assert tree.parse_tree(b" x\0" + b"1" * 20) == "TreeEntryMalformedMode"
    assert tree.parse_tree(b"10a x\0" + b"1" * 20) == "TreeEntryMalformedMode"
    assert tree.parse_tree(b"100644 x\0" + b"1" * 19) == "TruncatedTreeEntry"
    e = tree.parse_tree
    assert tree.canonically_sorted(e(tree.encode_tree([("100644", b"a.b", one), ("40000", b"a", one)])))
    assert not tree.canonically_sorted(e(tree.encode_tree([("40000", b"a", one), ("100644", b"a.b", one)])))
    assert not tree.canonically_sorted(e(tree.encode_tree([("100644", b"a", one), ("100644", b"a", one)])))


WHO = "Alice Smith <alice@example.com> 1700000000 +0000"


def make(author=WHO, committer="Bob <b@c> 1700000001 +0530", extra="", parents=(), tree_line="tree " + "a" * 40):
    return "\n".join([tree_line, *(f"parent {p}" for p in parents), f"author {author}", f"committer {committer}"]).encode() + b"\n" + extra.encode() + b"\nmessage"


def test_commit():
    c = commit.parse_commit(make())
    assert (c.author.name, c.author.email, c.author.timestamp, c.committer.zone, c.parents, c.message) == ("Alice Smith", "alice@example.com", 1700000000, "+0530", [], b"message")
    assert commit.parse_commit(make(parents=["b" * 40, "c" * 40])).parents == ["b" * 40, "c" * 40]
    assert commit.parse_commit(make(extra="gpgsig one\n two\n")).extra_headers == [("gpgsig", "one\ntwo")]
    assert commit.parse_identity("A <x> B <c@d> 5 +0000", "Author").name == "A <x> B"
    for payload, error in [
        (b"", "CommitMissingTree"), (b"tree x", "CommitMissingMessageSeparator"), (b" x\n\nm", "CommitMalformedHeaderLine"), (make(tree_line="tree xyz"), "CommitMalformedTreeRef"), (make(parents=["zz"]), "CommitMalformedParentRef"),
        (make(author="A <a> NOT_A_TIMESTAMP +0000"), "CommitMalformedTimestamp"), (make(author="A <a> -5 +0000"), "CommitMalformedTimestamp"), (make(author="A <a> 99999999999999999999 +0000"), "CommitMalformedTimestamp"),
        (make(author="A <a> 5 0000"), "CommitMalformedTimezone"), (make(author="A a 5 +0000"), "CommitMalformedAuthorLine"), (make(extra=f"author {WHO}\n"), "CommitDuplicateAuthor"), (make(extra=f"committer {WHO}\n"), "CommitDuplicateCommitter"),
        (make(extra="tree " + "a" * 40 + "\n"), "CommitMalformedHeaderLine"), (make(extra="nospace\n"), "CommitMalformedHeaderLine"), (f"tree {'a' * 40}\n\nm".encode(), "CommitMissingAuthor"), (f"tree {'a' * 40}\nauthor {WHO}\n\nm".encode(), "CommitMissingCommitter"),
    ]:
        assert commit.parse_commit(payload) == error


def delta(base: bytes, target: bytes, ops: bytes) -> bytes:
    def size(n):
        out = bytearray()
        while True:
            out.append((n & 127) | (128 if n > 127 else 0))
            n >>= 7
            if not n:
                return bytes(out)

    return size(len(base)) + size(len(target)) + ops


def test_distances():
    for n in (1, 10, 127, 128, 130, 300, 16384, 65536, 1000000):
        b = pack.encode_distance(n)
        assert pack.base_distance(b, 0, len(b)) == (n, len(b))


def test_delta():
    base = b"hello world"
    assert pack.apply_delta(base, delta(base, b"hello there", b"\x90\x06\x05there")) == b"hello there"
    big = b"x" * 65536
    assert pack.apply_delta(big, delta(big, big, b"\x80")) == big  # size 0 is 65536
    assert pack.apply_delta(base, delta(b"other", b"", b"")) == "DeltaBaseSizeMismatch"
    assert pack.apply_delta(base, delta(base, b"12345", b"\x00")) == "InvalidDeltaInstruction"
    assert pack.apply_delta(base, delta(base, b"12345", b"\x91\x0a\x05")) == "DeltaCopyOutOfBounds"
    assert pack.apply_delta(base, delta(base, b"12345", b"\x05abc")) == "TruncatedDeltaInstruction"
    assert pack.apply_delta(base, delta(base, b"12345", b"\x03abc")) == "DeltaReconstructionSizeMismatch"
    assert pack.apply_delta(base, delta(base, b"abc", b"\x03abc\x01x")) == "DeltaTrailingInstructionData"


def test_pack():
    base = b"hello world"
    first = pack.encode_entry(3, base)
    d = delta(base, b"hello there", b"\x90\x06\x05there")
    second = pack.encode_entry(6, d, pack.encode_distance(len(first)))
    third_d = delta(b"hello there", b"hello!", b"\x90\x05\x01!")
    third = pack.encode_entry(6, third_d, pack.encode_distance(len(second)))
    r = pack.parse_pack(pack.encode_pack([first, second, third]), "p")
    assert [o[2] for o in r.objects] == [base, b"hello there", b"hello!"] and not r.anomalies and not r.gaps
    assert r.objects[0][0] == object_name("blob", base)

    def kinds(data):
        x = pack.parse_pack(data, "p")
        return x.error or [a[0] for a in x.anomalies] + [g[0] for g in x.gaps]

    good = pack.encode_pack([first])
    assert kinds(b"JUNK" + good[4:]) == "NotAPackFile" and kinds(b"PACK") == "NotAPackFile"
    assert kinds(pack.encode_pack([first], version=3)) == "UnsupportedPackVersion"
    assert kinds(good[:-1] + bytes([good[-1] ^ 1])) == ["PACK_CHECKSUM_MISMATCH"]
    assert kinds(pack.encode_pack([first], declared=2)) == ["PACK_COUNT_MISMATCH"]
    assert kinds(pack.encode_pack([first, b"junk"], declared=1)) == ["PACK_TRUNCATED_OR_CORRUPTED"]
    assert kinds(pack.encode_pack([pack.encode_entry(5, b"x")])) == ["PACK_TRUNCATED_OR_CORRUPTED", "PACK_COUNT_MISMATCH"]
    assert kinds(pack.encode_pack([pack.encode_entry(7, d, b"1" * 20)])) == ["unresolvedPackOnly"]
    assert kinds(pack.encode_pack([first, pack.encode_entry(6, d, pack.encode_distance(5))])) == ["CORRUPTED_PACK_ENTRY"]
    wrong = bytearray(first)
    wrong[0] ^= 1
    assert kinds(pack.encode_pack([bytes(wrong)])) == ["CORRUPTED_PACK_ENTRY"]
    ring = [pack.PackEntry(100, 6, 1, 200), pack.PackEntry(200, 6, 1, 100)]
    assert all("DeltaChainCycleDetected" in a[2] for a in pack.resolve_entries(ring).anomalies)


@given(st.binary(max_size=200))
def test_nothing_raises(data):
    parse_envelope(data)
    decode_loose(data)
    decode_loose(zlib.compress(data))
    tree.parse_tree(data)
    commit.parse_commit(data)
    commit.parse_commit(make()[:60] + data)
    pack.parse_pack(data, "p")
    pack.parse_pack(pack.encode_pack([data]), "p")
    pack.parse_pack(pack.encode_pack([pack.encode_entry(6, data, pack.encode_distance(3))]), "p")
    pack.apply_delta(b"base", data)
    pack.apply_delta(data[:20], data)


@given(st.binary(max_size=300))
def test_round_trip(data):
    oid, raw = encode_loose("blob", data)
    assert decode_loose(raw, oid).payload == data
    assert pack.parse_pack(pack.encode_pack([pack.encode_entry(3, data)]), "p").objects[0][2] == data
