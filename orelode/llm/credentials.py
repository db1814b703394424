"""Credentials embedded in source code, commit texts and reports.

Method: lexical tokens are labelled by a linear-chain conditional random field
with features of shape and context; its Viterbi spans are the literal
characters that are redacted.  The field is trained here, on lines drawn from
:mod:`orelode.llm.credential_lines`.

Bytes are seen as one character each, so positions are byte offsets whatever
the encoding; UTF-16 is told by its mark or its zero bytes and counted in twos.
The field labels every line that names a credential, holds a prefix of one, or
holds any run of letters and digits that is more than names and numbers (dates,
mail addresses and bare hexadecimal aside), and private keys over all their
lines; a line without any of these has nothing that the field could tell from a
word.  A line of more than ``_LONGEST`` characters is cut into stretches that
overlap, and a value goes on over the end of its stretch.  Where a prefix is cut
over adjacent quoted pieces, the pieces are joined before and told apart again
afterwards, so that the field sees the prefix whole.  An exact check then
completes private keys, and drops spans that are placeholders or references,
heads of keys without key material, and digests.

Defined results: null and empty payloads have no rows; repeated deliveries give
one row per place; a credential in pieces is one row, at its first piece.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orelode.llm.credential_lines import labelled_lines
from orelode.llm.crf import BEGIN, INSIDE, LinearChain

BITS = 16
FEATURES = 19

# ------------------------------------------------------------------ windows

#: What lines with credentials contain, in lower case (fixed values), as bytes seen one by one.
STRONG = [w.encode().decode("latin-1").lower() for w in ("passw", "pass", "pwd", "pw was", "pw:", "pw =", "pw=", "pw\"", "secret", "bearer", "basic ", "identified by", "jwt", "credential", "contrase", "mot de passe", "mot_de_passe", "senha", "wachtwoord", "hasło", "haslo", "пароль", "パスワード")]
#: Words that ordinary code has as well: their lines must hold more than names and numbers.
WEAK = ["token", "key", "authoriz", "auth_", "_auth", "authtoken", "auth:", "auth=", "-u ", "--user ", "://"]
TRIGGERS = STRONG + WEAK
#: The same where case counts: prefixes that credentials themselves have.
PREFIXES = ["-----BEGIN", "LS0tLS1CRUdJTi", "AKIA", "ASIA", "AIDA", "AROA", "AGPA", "AIPA", "ANPA", "ANVA", "A3T", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "eyJ"]
_FIVE = re.compile(r":\d{2,5}:[^:\s]{1,64}:[^:\s]{1,64}:\S")
_URL_AUTH = re.compile(r"://[^\s/@\"'`<>]{0,200}:[^\s/@\"'`<>]{1,200}@|://[^\s/:@\"'`<>]{12,200}@|[?&][\w.-]*(?:token|key|secret|passw|auth|sig)[\w.-]*=", re.I)
_RUN = re.compile(r"[A-Za-z0-9_+/=.~!@#$%^&*?\x80-\U0010ffff-]{6,}")
_PART = re.compile(r"(?:[A-Z]?[a-z]+(?:[A-Z][a-z]+)*\d{0,4}|[A-Z]{1,12}\d{0,2}|\d+)\Z")
_HUMP = re.compile(r"[A-Z]?[a-z]+")
_HARD = re.compile(r"[bcdfghjklmnpqrstvwxz]{5,}", re.I)
_SPLIT = re.compile(r"[_+/.-]+")
_VALUE = re.compile(r"[A-Za-z0-9_+/=.~-]*")
_NAMED = re.compile(r"([A-Za-z][A-Za-z0-9_.-]{5,})[=:]")
_BELOW = re.compile(r"[:=]\s*(?:[>|][-+]?|\\)\Z")
_SIGNS = frozenset("!#$%&()*+;<=>?@^_`{|}~")
_JOINT = re.compile(r"[\"'][\s,+.&|()\[\]\\-]{0,200}[\"']")
_SHAPED = re.compile(r"[A-Za-z0-9_+/=.~!#$%^&*?-]{10,}")
_BARE_HEX = re.compile(r"[0-9a-f.]+\Z|[0-9A-F.]+\Z")
_TIME = re.compile(r"\d{4}-\d\d-\d\dT\d\d\Z")
_BEFORE, _AFTER, _LONGEST = 1_000, 2_000, 4_000  # of lines that are longer still: how far a stretch goes


def _patch_line(line: str) -> bool:
    """A line of a binary patch: a length and letters of base 85, many of them signs.

    The letter gives the bytes of the line, A to Z 1 to 26 and a to z 27 to 52, in fives of letters for fours of bytes.
    Short words are in such lines by chance, so that a sure word doesn't tell; a name with its value is none.
    """
    if not "A" <= line[:1] <= "Z" and not "a" <= line[:1] <= "z":
        return False
    n = ord(line[0]) - (64 if line[0] <= "Z" else 70)
    if len(line) - 1 != -(-n // 4) * 5 or (m := _NAMED.match(line)) and _plain(m.group(1)):
        return False
    return len(line) >= 40 and line[0].isalpha() and "://" not in line and not any(c in " \t\"'" for c in line) and sum(c in _SIGNS for c in line) >= 6


def _name(part: str) -> bool:
    """A word, several in one (camelCase), or a number; letters that cannot be said are none."""
    if not _PART.match(part):
        return False
    humps = _HUMP.findall(part)
    return not (len(humps) > 2 and any(len(h) < 3 for h in humps[1:]) or _HARD.search(part))


@lru_cache(maxsize=100_000)
def _plain(run: str) -> bool:
    """Names and numbers rather than a made-up value."""
    for x in re.split(r"[=:]", run):
        if x.count("-") >= 2 and not x.startswith("-") and not any(c in x for c in "/.+"):
            return False
        if not all(not p or _name(p) for p in _SPLIT.split(x)):
            return False
    return True


def _worth(line: str) -> bool:
    """Whether a line holds anything but names and numbers."""
    return any(not _plain(m) for m in _RUN.findall(line))


def _made_up(run: str) -> bool:
    """Letters and digits that are no names, no numbers, no time and not bare hexadecimal."""
    return any(c.isdigit() for c in run) and not _BARE_HEX.match(run) and not _TIME.match(run) and not _plain(run)


def cut_joints(text: str) -> list[tuple[int, int]]:
    """What stands between adjacent quoted pieces where one of ``PREFIXES`` is whole only once they are joined, in order."""
    joints, starts, parts, at, size = [], [], [], 0, 0
    for m in _JOINT.finditer(text):
        joints.append(m.span())
        parts.append(text[at : m.start()])
        size += len(parts[-1])
        starts.append(size)  # of the piece after it, in the joined text
        at = m.end()
    if not joints:
        return []
    joined = "".join([*parts, text[at:]])
    cut: set[int] = set()
    for t in PREFIXES:
        i = joined.find(t)
        while i >= 0:
            cut.update(range(bisect_right(starts, i), bisect_left(starts, i + len(t))))
            i = joined.find(t, i + len(t))
    return [joints[k] for k in sorted(cut)]


def without(text: str, joints: list[tuple[int, int]]) -> str:
    ends = [0, *(z for _, z in joints)]
    return "".join(text[e:a] for e, a in zip(ends, [*(a for a, _ in joints), len(text)]))


def rejoined(found: list[tuple[int, int, list[tuple[int, int]]]], joints: list[tuple[int, int]]) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """Places in the text without ``joints`` as places in the whole text; a piece that held joints is several."""
    at, gone = [], [0]  # where each was taken out, and characters taken out so far
    for a, z in joints:
        at.append(a - gone[-1])
        gone.append(gone[-1] + z - a)
    out = []
    for _, _, pieces in found:
        whole = []
        for a, z in pieces:
            i, j = bisect_right(at, a), bisect_left(at, z)
            edges = [a, *sorted(set(at[i:j])), z]
            whole += [(x + gone[bisect_right(at, x)], y + gone[bisect_left(at, y)]) for x, y in zip(edges, edges[1:])]
        out.append((whole[0][0], whole[-1][1], whole))
    return out


def windows(text: str) -> list[tuple[int, int]]:
    """Stretches of ``text`` that may hold credentials, in order, without overlap."""
    flat = text.replace("\r", "\n")
    low = flat.lower()
    if len(low) != len(flat):
        low = flat.encode("ascii", "replace").decode().lower()
    found: list[tuple[int, int]] = []
    sure: set[tuple[int, int]] = set()

    def line(i: int) -> None:
        """The whole line around ``i``; of a very long one, a stretch."""
        a = flat.rfind("\n", max(0, i - _LONGEST), i) + 1
        z = flat.find("\n", i, i + _LONGEST)
        if not a and i > _LONGEST or z < 0 and i + _LONGEST < len(flat) or z - a > _LONGEST:
            found.append((max(a, i - _BEFORE), min(z if z >= 0 else len(flat), i + _AFTER)))
        else:
            found.append((a, z if z >= 0 else len(flat)))

    for k, t in enumerate(TRIGGERS):
        strong = k < len(STRONG)
        i = low.find(t)
        while i >= 0:
            if t == "://":
                if _URL_AUTH.match(flat, i) or _URL_AUTH.search(flat, i, min(len(flat), i + 400)):
                    line(i)
            else:
                line(i)
                if strong:
                    sure.add(found[-1])
            i = low.find(t, i + len(t))
    for t in PREFIXES:
        i = flat.find(t)
        while i >= 0:
            line(i)
            if t == "-----BEGIN":  # the material begins on the next line
                a, z = found.pop()
                n = flat.find("\n", z + 1 + (flat[z : z + 2] == "\n\n"))
                z = min(len(flat), n if 0 <= n <= z + 160 else z + 160)
                found.append((a, max(z, key_end(flat, i))))
            sure.add(found[-1])
            i = flat.find(t, i + len(t))
    for m in _FIVE.finditer(flat):
        line(m.start())
    for m in _SHAPED.finditer(flat):
        if _made_up(m.group()[:300]) and flat[m.end() : m.end() + 1] != "@":
            line(m.start())
    if not found:
        return []
    found.sort()
    merged = [(*found[0], found[0] in sure)]
    for a, z in found[1:]:
        b, y, s = merged[-1]
        if a <= y and z - b <= _LONGEST:  # very long lines are cut into stretches that overlap
            merged[-1] = (b, max(y, z), s or (a, z) in sure)
        else:
            merged.append((a, z, (a, z) in sure))
    out = []
    for a, z, s in merged:
        part = flat[a:z]
        if _patch_line(part):
            continue
        tail = part.rstrip()
        if _BELOW.search(tail) and z < len(flat):  # goes on below
            n = flat.find("\n", z + 1 + (flat[z : z + 2] == "\n\n"))
            z = min(len(flat), n if 0 <= n <= z + 400 else z + 400)
            part = flat[a:z]
        if s or _worth(part):
            out.append((a, z))
    return out


# ----------------------------------------------------------------- features

_TOKEN = re.compile(r"[A-Za-z0-9_\x80-\U0010ffff]+|[^\S\n\r]+|[\n\r]+|.")
_CHUNK = re.compile(r"[^\s\"'`<>(),;{}\[\]]+")
_KEYWORD = re.compile(r"pass|pw(?:d|\b)|has\xc5\x82o|\xd0\xbf\xd0\xb0\xd1\x80\xd0\xbe\xd0\xbb\xd1\x8c|secret|bearer|basic|token|auth|jwt|identified|cred|contrase|senha|wachtwoord|key|user|login", re.I)
_WARN = re.compile(r"sha\d+|checksum|digest|integrity|fingerprint|pinned|revision|rev\b|etag|uuid|\bid\b|base64,|ssh-rsa|CERTIFICATE|PUBLIC KEY|SIGNATURE|environ|getenv|get_secret|input\(|vault|re\.compile|startswith|Change-Id|commit\b", re.I)
_HEX = re.compile(r"[0-9a-f]+\Z")
_UUID = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\Z", re.I)
#: Forms of well-known keys (fixed values).
_KNOWN = [
    ("aws", re.compile(r"(?:A3T[A-Z0-9]|AKIA|AGPA|AIDA|AROA|AIPA|ANPA|ANVA|ASIA)[A-Z0-9]{16}(?![A-Z0-9])")),
    ("awshead", re.compile(r"(?:AKIA|AGPA|AIDA|AROA|AIPA|ANPA|ANVA|ASIA)\Z")),
    ("gh", re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}")),
    ("ghhead", re.compile(r"gh[pousr]_[A-Za-z0-9]{2,}")),
    ("xox", re.compile(r"xox[baprs]-\d{8,}-")),
    ("jwt", re.compile(r"eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.")),
    ("pem64", re.compile(r"LS0tLS1CRUdJTi")),
    ("vendor", re.compile(r"(?:sk|rk)_(?:live|test)_[A-Za-z0-9]{16,}|AIza[\w-]{30,}|glpat-[\w-]{16,}|npm_[A-Za-z0-9]{30,}|hf_[A-Za-z0-9]{30,}|SG\.[\w-]{16,}\.[\w-]{16,}|shp(?:at|ss|ca|pa)_[0-9a-f]{32}|dop_v1_[0-9a-f]{64}|ya29\.[\w-]{20,}|pypi-[\w-]{20,}|github_pat_\w{22,}|xapp-\d-[A-Z0-9]+-\d+-[0-9a-f]+|xox[eo]-[\w-]{20,}")),
]
_SPECIAL = frozenset("!@#$%^&*?~+")


def _shape(s: str) -> str:
    out = []
    for c in s[:40]:
        k = "a" if "a" <= c <= "z" else "A" if "A" <= c <= "Z" else "9" if "0" <= c <= "9" else c if c < "\x80" else "u"
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out[:6])


def _bucket(n: int) -> int:
    return n if n < 5 else 5 + (n > 6) + (n > 8) + (n > 11) + (n > 15) + (n > 19) + (n > 20) + (n > 27) + (n > 31) + (n > 32) + (n > 39) + (n > 40) + (n > 63) + (n > 64)


_REF = re.compile(r"\$[{(A-Za-z_]|%[({]|![a-z]+(?:-[a-z]+)*\Z|<")


@lru_cache(maxsize=50_000)
def _chunk_kind(c: str) -> tuple[str, str, str]:
    """(known form, whether plain, make-up) of a chunk or part of one."""
    known = ""
    for name, pattern in _KNOWN:
        if pattern.match(c):
            known = name
            break
    if not known:
        if len(c) >= 7 and _HEX.match(c):
            known = f"hex{_bucket(len(c))}"
        elif _UUID.match(c):
            known = "uuid"
        elif len(set(c.lower())) <= 2 and len(c) > 4:
            known = "fill"
        elif _REF.match(c) or "..." in c:
            known = "ref"
    u = sum("A" <= x <= "Z" for x in c)
    d = sum("0" <= x <= "9" for x in c)
    s = sum(x in _SPECIAL for x in c)
    turns = sum((a.isdigit() != b.isdigit()) or (a.isupper() != b.isupper()) for a, b in zip(c, c[1:]))
    hyphens = c.count("-")
    return known, "plain" if _plain(c) else "made", f"{min(u, 3)}{min(d, 3)}{min(s, 2)}{min(hyphens, 3)}{'t' if turns * 3 > len(c) else ''}{_bucket(len(c))}{'u' if not c.isascii() else ''}"


class FeatureIndex(dict):
    """Feature text to its place in the weights; filled as texts are met."""

    def __missing__(self, key: str) -> int:
        import zlib

        if len(self) > 400_000:
            self.clear()
        v = self[key] = zlib.crc32(key.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)
        return v


_INDEX = FeatureIndex()
_SUB = re.compile(r"[^=:@/?&|]+")


def tokens_of(line: str) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(line)]


def features(line: str, spans: list[tuple[int, int]]) -> list[list[int]]:
    """``FEATURES`` places in the weights for each token."""
    ix = _INDEX
    n = len(spans)
    texts = ["\n" if line[a] in "\r\n" else line[a:z] for a, z in spans]
    lows = [t.lower() if len(t) <= 18 else "LONG" for t in texts]
    solid = [i for i, t in enumerate(texts) if not t.isspace()]
    rank = [0] * n
    for k, i in enumerate(solid):
        rank[i] = k
    warn = ",".join(sorted({m.lower()[:6] for m in _WARN.findall(line[:400])}))[:24]
    # The chunk (and the part of it between separators) around each token.
    chunk_of: list[tuple[int, int, int, int]] = [(0, 0, 0, 0)] * n
    field_of = [""] * n
    i = 0
    for m in _CHUNK.finditer(line):
        a, z = m.span()
        subs = [(s.start(), s.end()) for s in _SUB.finditer(line, a, z)]
        marks = _SUB.sub("", line[a:z])[:10]
        k = 0
        while i < n and spans[i][0] < a:
            i += 1
        while i < n and spans[i][0] < z:
            while k < len(subs) and subs[k][1] <= spans[i][0]:
                k += 1
            sa, sz = subs[k] if k < len(subs) and subs[k][0] <= spans[i][0] else (spans[i][0], spans[i][1])
            chunk_of[i] = (a, z, sa, sz)
            field_of[i] = f"{min(k, 6)}{marks}"
            i += 1
    quote, quote_at, quoted = "", 0, ""
    word, word_end, word_rank = "", 0, -99
    out = []
    for i, t in enumerate(texts):
        a, z = spans[i]
        k = rank[i]
        space = t.isspace()
        low = lows[i]
        if t in "\"'`":
            if quote == t:
                quote = ""
            elif not quote:
                e = line.find(t, z)
                if e > 0:
                    quote, quote_at = t, z
                    body = line[z:e]
                    q = _chunk_kind(body[:200])
                    quoted = f"{q[0]}|{q[1]}|{'s' if any(c.isspace() for c in body) else ''}{_bucket(len(body))}"
        ca, cz, sa, sz = chunk_of[i]
        known, plain, make = _chunk_kind(line[sa : min(sz, sa + 200)]) if cz else ("", "", "")
        kc, pc, mc = _chunk_kind(line[ca : min(cz, ca + 200)]) if cz else ("", "", "")
        p1 = lows[solid[k - 1]] if k and not space else ("" if space else "^")
        p2 = lows[solid[k - 2]] if k > 1 and not space else ""
        n1 = lows[solid[k + 1]] if not space and k + 1 < len(solid) else "$"
        n2 = lows[solid[k + 2]] if not space and k + 2 < len(solid) else ""
        before = line[word_end : min(word_end + 10, sa if cz else a)] if word else ""
        gap = re.sub(r"[\w\x80-\U0010ffff]+", "w", before)[:7]
        dist = min(k - word_rank, 9)
        place = ("s" if a == ca else "") + ("b" if a == sa else "i")
        prevc = line[a - 1] if a else "^"
        nextc = line[z] if z < len(line) else "$"
        own = _shape(t)
        inq = quote and a >= quote_at
        row = [
            ix["s" + own + str(_bucket(len(t)))],
            ix["t" + low],
            ix["p" + p1 + "|" + own[:3]],
            ix["q" + p2 + "|" + p1],
            ix["n" + n1],
            ix["m" + n1 + "|" + n2],
            ix["c" + prevc + own[:2] + nextc],
            ix["k" + known + "|" + place + "|" + plain],
            ix["K" + kc + "|" + pc + "|" + place],
            ix["w" + word + str(dist)],
            ix["g" + word + "|" + gap + "|" + plain + "|" + place],
            ix["W" + word + "|" + known + "|" + plain + "|" + ("Q" if inq else "") + place],
            ix["x" + warn + "|" + known + plain],
            ix["Q" + (quoted if inq else "-") + "|" + ("0" if a == quote_at else "")],
            ix["M" + make + "|" + place],
            ix["G" + gap + "|" + make[:4] + "|" + place],
            ix["C" + mc + "|" + prevc],
            ix["b" + p1 + "|" + known + "|" + plain + place],
            ix["f" + field_of[i] + "|" + plain + place],
        ]
        out.append(row)
        if not space and (m := _KEYWORD.search(t)) and (plain == "plain" or len(t) < 24):
            word = m.group(0).lower()
            for m in _KEYWORD.finditer(t):
                if m.group(0).lower() not in ("user", "key", "login"):
                    word = m.group(0).lower()
            word_end, word_rank = z, k
    return out


# ------------------------------------------------------------------- model


def encode_lines(lines: list[str]) -> tuple[np.ndarray, np.ndarray, list[list[tuple[int, int]]]]:
    rows: list[list[int]] = []
    ends, spans = [], []
    for line in lines:
        t = tokens_of(line)
        rows += features(line, t)
        ends.append(len(rows))
        spans.append(t)
    return np.array(rows, np.int32).reshape(-1, FEATURES), np.array(ends, np.int64), spans


@lru_cache(maxsize=4)
def trained(each: int = 60, epochs: int = 5) -> LinearChain:
    """The field, from ``each`` lines of every form; it depends on nothing else, so a process trains it once."""
    lines = labelled_lines(each)
    feats, ends, tokens = encode_lines([x for x, _ in lines])
    labels = np.zeros(len(feats), np.int64)
    at = 0
    for (_, spans), t in zip(lines, tokens):
        for a, z in spans:
            first = True
            for j, (b, e) in enumerate(t):
                if e > a and b < z:
                    labels[at + j] = BEGIN if first else INSIDE
                    first = False
        at += len(t)
    return LinearChain(BITS).fit(feats, ends, labels, epochs)


def label_lines(lines: list[str], model: LinearChain) -> list[list[tuple[int, int]]]:
    """The credential spans of each line, by Viterbi."""
    feats, ends, tokens = encode_lines(lines)
    best = model.viterbi(feats, ends)
    out, at = [], 0
    for t in tokens:
        spans: list[list[int]] = []
        for j, (a, z) in enumerate(t):
            y = best[at + j]
            if y == BEGIN or (y == INSIDE and not (spans and spans[-1][1] == a)):
                spans.append([a, z])
            elif y == INSIDE:
                spans[-1][1] = z
        at += len(t)
        out.append([(a, z) for a, z in spans])
    return out


# ----------------------------------------------------------- exact checking

_PEM_HEAD = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_PUBLIC_HEAD = re.compile(r"-----BEGIN [A-Z0-9 ]+-----(?:\\r|\\n|\s)")
_PEM_BODY = re.compile(r"(?:\\r|\\n|[\s+\->|\"'#*\\]|//)*(?:[A-Za-z-]+: [^\n]*\n)*(?:\\r|\\n|[\s+\->|\"'#*])*[A-Za-z0-9+/=]{16,}")
_PEM_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
#: Between two lines of key material, real or escaped; and what may follow one up to the end of its line.
_PEM_GAP = re.compile(r"(?:\\[rn]|[\s+\->|\"'#*\\,;]|//)+")
_PEM_REST = re.compile(r"[ \t\"',;)\\+]*(?:[\r\n]|\\[rn]|-----END|\Z)")
_PEM_RUN = re.compile(r"[A-Za-z0-9+/=]+")
_REFERENCE = re.compile(r"[<{\[(]|\$[{(A-Za-z_]|%[({]|![a-z]+(?:-[a-z]+)*\Z|\*{3,}|x{4,}|X{4,}|\.{3}|your|change.?me|example|placeholder|redacted|hidden|dummy|none\Z|null\Z|true\Z|false\Z|os\.|process\.|env\b|getenv|vault", re.I)
_GLUE = re.compile(r"[\"'\s,+.&|()\[\]-]{1,12}\Z")
_OPENED = re.compile(r"([\"'])[^\s\\\"':=/@?;,(){}\[\]]{1,1999}\Z")
_CLOSED = {q: re.compile(rf"[^\s\\\"'`;,(){{}}\[\]<>]{{1,9999}}{q}") for q in "\"'"}
_LAST_SIGN = re.compile(r"[!#$%&*^~+?=]{1,3}(?=[\s\"'`]|\Z)")
_TO_QUOTE = {q: re.compile(rf"[^\r\n\\{q}]*") for q in "\"'`"}
_TRIM = " \t\r\n\"'`,;"


def material_end(text: str, z: int, stop: int) -> int:
    """Where the lines of key material that go on at ``z`` end, or the END line that follows them."""
    if run := _PEM_RUN.match(text, z, stop):
        z = run.end()

    def ended() -> int | None:
        at = text.find("-----END", z, gap.end() + 8) if gap else -1
        end = _PEM_END.match(text, at) if at >= 0 else None
        return end.end() if end else None

    while gap := _PEM_GAP.match(text, z, stop):
        if e := ended():
            return e
        run = _PEM_RUN.match(text, gap.end(), stop)
        if not run:
            break
        s, g = run.group(), gap.group()
        whole = _PEM_REST.match(text, run.end())
        if len(s) < 16:  # the last, if any
            if whole and re.search(r"[\r\n]|\\[rn]", g) and (s[0] == "=" or s[-1] == "=" or len(s) > 3 and not _plain(s)):
                z = run.end()
                gap = _PEM_GAP.match(text, z, stop)
                return ended() or z
            break
        if _plain(s) or _HEX.match(s) or len(s) < 40 and not (whole and re.search(r"[\r\n]|\\[rn]|[\"'].*[\"']", g)):
            break
        z = run.end()
        if not whole:
            break
    return z


def key_end(text: str, at: int) -> int:
    """Where the private key whose first dash is at ``at`` ends; ``at`` if it has no material."""
    head = _PEM_HEAD.match(text, at)
    body = _PEM_BODY.match(text, head.end(), head.end() + 2_000) if head else None
    if not body:
        return at
    stop = text.find("-----BEGIN", head.end())
    stop = stop if stop >= 0 else len(text)
    z = material_end(text, body.end(), stop)  # as far as it goes
    end = _PEM_END.search(text, z, min(stop, z + 200))  # behind a last line that is no material
    return end.end() if end else z


def _said(s: str) -> bool:
    """Words of letters alone, of which some are not ASCII."""
    try:
        s = s.encode("latin-1").decode()
    except (UnicodeEncodeError, UnicodeDecodeError):
        pass
    return all(w.isalpha() for w in s.rstrip(".,;:!?。、").split())


def accepted(text: str, a: int, z: int) -> tuple[int, int] | None:
    """The exact span of a credential the field found, or None."""
    while a < z and text[a] in _TRIM:
        a += 1
    while z > a and text[z - 1] in _TRIM:
        z -= 1
    while z > a and text[z - 1] == "\\" and text[z : z + 1] in ('"', "'"):  # the quote behind is escaped
        z -= 1
    s = text[a:z]
    head = _PEM_HEAD.search(text, max(0, a - 48), min(len(text), z + 80))
    if head and head.start() <= a + 3 and (a <= head.end() or _PEM_BODY.match(text, head.end(), z + 80)):
        end = key_end(text, head.start())
        return (head.start(), end) if end > head.start() else None
    if len(s) < 4 or "-----" in s:
        return None
    begun = text.rfind("-----BEGIN ", max(0, a - 6_000), a)
    if begun >= 0 and text.find("-----END ", begun, a) < 0 and not _PEM_HEAD.match(text, begun) and _PUBLIC_HEAD.match(text, begun):
        line = text[max(text.rfind("\n", 0, a), text.rfind("\r", 0, a)) + 1 :][:200].splitlines()[0]
        if re.fullmatch(r"[+\- \t\"']*[A-Za-z0-9+/=]{20,}[\s\"',;\\nr]*", line):  # part of the public block
            return None
    if not s.isascii() and _said(s):
        return None
    if _REFERENCE.match(s) or re.fullmatch(r"[*x.X_-]+", s):
        return None
    m = re.match(r"LS0tLS1CRUdJTi[A-Za-z0-9+/]{20,}", s)
    if m:
        try:
            if b"PRIVATE KEY" not in base64.b64decode(m.group(0)[:60]):
                return None
        except ValueError:
            return None
        more = _PEM_RUN.match(text, a)
        return a, more.end() if more else z
    if a and text[a - 1] not in "\"'" and (m := _OPENED.search(text, max(0, a - 2_000), a)) and text.find(m.group(1), z, z + 200) >= 0:
        a = m.start() + 1  # what stands between the quote and the rest
    if a and text[a - 1] in "\"'" and (m := _CLOSED[text[a - 1]].match(text, z)):
        return a, m.end() - 1  # a literal is one value
    if z - a >= 8 and (rest := _VALUE.match(text, z).group().rstrip(".")):
        z += len(rest)  # a value goes on to the end of its run
    if (more := _LAST_SIGN.match(text, z)) and (z - a < 40 or text[z] != "="):
        z = more.end()
    return a, z


def spans_in(text: str, places: list[tuple[int, int]], labelled: list[list[tuple[int, int]]]) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """(start, end, pieces) of each credential: pieces joined by quotes, signs or a call are one."""
    found: list[tuple[int, int, list[tuple[int, int]]]] = []
    keys = [(m.start(), key_end(text, m.start())) for m in _PEM_HEAD.finditer(text)] if "-----BEGIN" in text else []
    key_starts = [a for a, _ in keys]
    run = -1, -1  # the last run of value characters
    for (at, y), spans in zip(places, labelled):
        for a, z in spans:
            if at + z == y and a and text[at + a - 1] in "\"'`" and y < len(text) and text[y] not in "\r\n" + text[at + a - 1]:
                close = _TO_QUOTE[text[at + a - 1]].match(text, y)  # the stretch ended within the quotes
                z = close.end() - at
            if not run[0] <= at + z <= run[1]:
                run = at + z, _VALUE.match(text, at + z).end()
            if run[1] > y:  # the stretch ended within the value
                z = run[1] - at
            if found and at + a < found[-1][1]:
                if at + a == found[-1][0] and at + z > found[-1][1] and len(found[-1][2]) == 1:  # cut off where a stretch ended
                    found[-1] = (found[-1][0], at + z, [(found[-1][0], at + z)])
                continue
            k = bisect_right(key_starts, at + a) - 1
            ok = keys[k] if k >= 0 and at + a < keys[k][1] else accepted(text, at + a, at + z)  # a part found of a key finds it whole
            if not ok or found and ok[0] < found[-1][1]:
                continue
            if found and ok[0] - found[-1][1] <= 12 and ok[0] > found[-1][1] and _GLUE.match(text[found[-1][1] : ok[0]]) and any(q in text[found[-1][1] : ok[0]] for q in "\"'"):
                found[-1][2].append(ok)
                found[-1] = (found[-1][0], ok[1], found[-1][2])
            elif not found or ok[0] >= found[-1][1]:
                found.append((*ok, [ok]))
    return found


# ----------------------------------------------------------------- encodings


def view(payload: bytes) -> tuple[str, int, int, str]:
    """(characters, bytes before them, bytes each, codec)."""
    head = payload[:400]
    if payload[:2] == b"\xff\xfe" or payload[:2] == b"\xfe\xff":
        codec = "utf-16-le" if payload[0] == 0xFF else "utf-16-be"
        return payload[2 : 2 + (len(payload) - 2) // 2 * 2].decode(codec, "replace"), 2, 2, codec
    if len(head) >= 8 and b"\0" in head:
        even, odd = head[0::2], head[1::2]
        if odd.count(0) > 0.7 * len(odd) and even.count(0) < 0.1 * len(even):
            return payload[: len(payload) // 2 * 2].decode("utf-16-le", "replace"), 0, 2, "utf-16-le"
        if even.count(0) > 0.7 * len(even) and odd.count(0) < 0.1 * len(odd):
            return payload[: len(payload) // 2 * 2].decode("utf-16-be", "replace"), 0, 2, "utf-16-be"
    return payload.decode("latin-1"), 0, 1, "latin-1"


_ASTRAL = re.compile(r"[\U00010000-\U0010ffff]")


def byte_places(text: str, lead: int, width: int):
    """Character to byte place; in UTF-16 what lies beyond the first plane counts twice."""
    if width == 1:
        return lambda i: i
    far = [m.start() for m in _ASTRAL.finditer(text)]
    return lambda i: lead + 2 * (i + bisect_left(far, i))


def find_all(payloads: list[bytes | None], model: LinearChain) -> list[list[tuple[int, int, list[tuple[int, int]]]]]:
    """(first byte, end byte, pieces) of each credential of each payload."""
    views = [view(p) if p else None for p in payloads]
    joints = [cut_joints(v[0]) if v else [] for v in views]
    texts = [without(v[0], j) if j else v[0] if v else "" for v, j in zip(views, joints)]
    places = [windows(t) for t in texts]
    lines = [t[a:z] for t, w in zip(texts, places) for a, z in w]
    labelled = label_lines(lines, model) if lines else []
    out, at = [], 0
    for v, t, cut, w in zip(views, texts, joints, places):
        if not v or not w:
            out.append([])
            continue
        mine, at = labelled[at : at + len(w)], at + len(w)
        b = byte_places(v[0], v[1], v[2])
        found = spans_in(t, w, mine)
        if cut:  # a prefix and nothing more is no credential
            found = [f for f in found if "".join(t[a:z] for a, z in f[2]) not in PREFIXES]
        out.append([(b(a), b(z), [(b(x), b(y)) for x, y in pieces]) for a, z, pieces in (rejoined(found, cut) if cut else found)])
    return out


# ------------------------------------------------------------------ operator

FOUND = "source_table string, record_id string, byte_offset bigint, byte_end bigint"
MARK = b"[REDACTED]"


def redact(payload: bytes, found: list[tuple[int, int, list[tuple[int, int]]]], width: int = 1) -> bytes:
    """The payload with each piece of each credential replaced, all else kept byte for byte."""
    codec = view(payload)[3]
    mark = MARK.decode().encode(codec) if width == 2 or codec.startswith("utf-16") else MARK
    out, at = [], 0
    for _, _, pieces in found:
        for a, z in pieces:
            out += [payload[at:a], mark]
            at = z
    return b"".join([*out, payload[at:]])


def _find(batches: Iterable[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    m = model.value
    for b in batches:
        for i in range(0, b.num_rows, 256):
            part = b.slice(i, 256)
            found = find_all(part.column(2).to_pylist(), m)
            rows = [(s, r, f[0], f[1]) for s, r, fs in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), found) for f in fs]
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["source_table", "record_id", "byte_offset", "byte_end"])


def _redact(batches: Iterable[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    m = model.value
    for b in batches:
        for i in range(0, b.num_rows, 256):
            part = b.slice(i, 256)
            payloads = part.column(2).to_pylist()
            found = find_all(payloads, m)
            clean = [redact(p, f) if p is not None else None for p, f in zip(payloads, found)]
            yield pa.record_batch([part.column(0), part.column(1), pa.array(clean, pa.binary()), pa.array([len(f) for f in found], pa.int32())], names=["source_table", "record_id", "payload", "n_redacted"])


def sources(documents: DataFrame, objects: DataFrame, reports: DataFrame) -> DataFrame:
    """``(source_table, record_id, payload)`` of all that is searched.

    Payloads do not move: copies of an object are searched where they lie, and
    their rows, which are few, are made distinct afterwards.  Trees hold modes,
    names and object ids only, and names are no credentials: they are left out.
    """
    from orelode.operators.nested import flat_tables

    d = documents.where("text is not null and text <> ''").select(F.lit("documents").alias("source_table"), F.col("doc_id").cast("string").alias("record_id"), F.col("text").cast("binary").alias("payload"))
    o = objects.where("payload is not null and not type <=> 'tree'").select(F.lit("fx_object"), F.col("oid"), F.col("payload"))
    r = flat_tables(reports).where("child_table = 'finding' and redacted is not null").select(F.lit("scan_report"), "finding_id", F.col("redacted").cast("binary"))
    return d.union(o).union(r.distinct())


def model_for(spark):
    return spark.sparkContext.broadcast(trained())  # 3 * 2**BITS weights, whatever the data


def credentials(documents: DataFrame, objects: DataFrame, reports: DataFrame) -> DataFrame:
    """Place and end of every credential, one row each."""
    model = model_for(documents.sparkSession)
    rows = sources(documents, objects, reports).mapInArrow(lambda it: _find(it, model), FOUND)
    return rows.distinct()


def _redact_bodies(batches: Iterable[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    m = model.value
    for b in batches:
        for i in range(0, b.num_rows, 16):
            part = b.slice(i, 16)
            bodies = part.column(1).to_pylist()
            raw = [x.encode("utf-8", "surrogatepass") if x else None for x in bodies]
            found = find_all(raw, m)
            clean = [x if p is None else redact(p, f).decode("utf-8", "surrogatepass") for x, p, f in zip(bodies, raw, found)]
            yield pa.record_batch([part.column(0), pa.array(clean, pa.string()), pa.array([len(f) for f in found], pa.int32())], names=["report_id", "body", "n_redacted"])


def redacted_reports(reports: DataFrame) -> DataFrame:
    """``(report_id, body, n_redacted)``: whole reports without the credentials in them, wherever these stand.

    A mark holds nothing that JSON would escape and stands inside a text, so a
    readable body stays readable; unreadable bodies are redacted as any text,
    null stays null, and repeated deliveries give repeated rows.
    """
    model = model_for(reports.sparkSession)
    return reports.select(F.col("report_id").cast("bigint").alias("report_id"), F.col("body").cast("string").alias("body")).mapInArrow(lambda it: _redact_bodies(it, model), "report_id bigint, body string, n_redacted int")


def redacted(documents: DataFrame, objects: DataFrame, reports: DataFrame) -> DataFrame:
    """``(source_table, record_id, payload, n_redacted)``: the same texts without their credentials."""
    model = model_for(documents.sparkSession)
    return sources(documents, objects, reports).mapInArrow(lambda it: _redact(it, model), "source_table string, record_id string, payload binary, n_redacted int")
