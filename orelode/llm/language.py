"""Language of each text and of each segment of its prose, with a confidence.

Method: hierarchical discrimination.  Linear support vector machines tell the
language family first; within the family, one-versus-one machines tell close
languages apart.  All machines are linear in hashed letter n-grams within
words, so a sentence's scores are sums over its words, and each word's scores
are computed once per worker.

The machines are trained here, on the labelled sentences of a fixed table (at
most ``SAMPLE_ROWS``), on short lists of function words, and on sentences of a
bounded sample of labelled texts (about ``SAMPLE_DOCS``) whose label the first
machines bear out.  Everything else covers all texts whole.

What counts as prose: headings of exports, trailers, diffs, quoted lines,
machine-made subjects and bare placeholders are left out; a topic prefix, code
names and quoted phrases inside a sentence do not count towards its language.
An item of a list is a paragraph of its own; a line of dashes ends the message
only if a diff or its summary comes below; a sentence too short to tell goes
with the one before.

Defined results: a text without prose has no segments, and no language as a document; null, blank or unknown
labels name no language; repeated deliveries of an id count once.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 20_000
SAMPLE_DOCS = 4_000
BITS = 15
SEGMENTS = "doc_id bigint, seg_no int, lang string, confidence double, sentences int, label_lang string, n_segments int, excerpt string"

FAMILIES = {"japonic": ["ja"], "slavic": ["pl", "ru"], "germanic": ["de", "en", "nl"], "romance": ["es", "fr", "it", "pt"]}

#: Function words (fixed values), which hardly depend on the topic of a text.
FUNCTION_WORDS = {
    "en": "the of and to in that for it with not this from because no",
    "de": "der die und in den von zu das mit für nicht ein auf ist weil damit ohne wird",
    "nl": "de het een van in is dat op te zijn met voor niet omdat zodat zonder geen deze",
    "fr": "la le et les des en un du une que est pour dans pas car afin depuis sans qui cette ce nous ne jamais toujours mois prochain avec sur plus au aux",
    "es": "de la que el en y los del las por con una para no porque pues así sin hasta ya esta este lo se ha muy mes próximo  nunca siempre vez más",
    "pt": "de que o do da em um para não uma os na por mais pois porque sem até foi as esta este isso se já muito mês próximo nunca sempre vez ao está",
    "it": "di e il la che in un per una del non si le della ma perché poiché senza dopo che questa questo gli delle degli alla mese prossimo mai sempre ogni più lo è sono anche",
    "pl": "i w na się do nie to że jest bo gdyż aby",
    "ru": "и в не на что как",
    "ja": "の は を が に で した ので",
}

#: Names under which the languages go in labels (fixed values).
NAMES = {
    "en": "en eng english englisch anglais inglés ingles inglese engels angielski английский 英語",
    "de": "de deu ger german deutsch allemand alemán aleman alemão tedesco duits niemiecki немецкий ドイツ語",
    "fr": "fr fra fre french français francais französisch franzoesisch francés frances francese frans francuski французский フランス語",
    "es": "es spa spanish español espanol castellano spanisch espagnol spagnolo spaans hiszpański испанский スペイン語",
    "pt": "pt por portuguese português portugues portugiesisch portugais portugués portoghese portugees portugalski португальский ポルトガル語",
    "it": "it ita italian italiano italienisch italien italiaans włoski итальянский イタリア語",
    "nl": "nl nld dut dutch nederlands niederländisch néerlandais neerlandés holandés olandese niderlandzki нидерландский オランダ語",
    "pl": "pl pol polish polski polnisch polonais polaco polacco pools польский ポーランド語",
    "ru": "ru rus russian русский russisch russe ruso russo rosyjski ロシア語",
    "ja": "ja jpn jp japanese 日本語 japanisch japonais japonés japonês giapponese japans japoński японский",
}
_NAMED = {name: code for code, names in NAMES.items() for name in names.split()}


def named_language(label: str | None) -> str | None:
    """The code a label names, whatever the spelling; None if none of the ten."""
    if label is None:
        return None
    x = unicodedata.normalize("NFC", label).strip().strip("()[]<>\"'").lower()
    if x in _NAMED:
        return _NAMED[x]
    head = re.split(r"[-_ .(/@;,:]", x, maxsplit=1)[0]
    return _NAMED.get(head)


# ------------------------------------------------------------------- prose

_UNSEEN = dict.fromkeys(map(ord, "​‌‍‎‏⁠﻿­᠎⁡⁢⁣⁤‪‫‬‭‮")) | {ord(c): " " for c in "               　\t\x0b\x0c"}
#: Where a diff begins, and what a line of dashes must have below it to end the message.
_END = re.compile(r"^(?:diff --(?:git|cc|combined) \S|diff -[a-zA-Z]+ \S|Binary files \S+ and |GIT binary patch$|@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@|index [0-9a-f]{6,}\.\.[0-9a-f]{6,})")
_BELOW = re.compile(r"^\s*(?:diff --git \S|\S.* \|\s+(?:\d+\b|Bin\b)|\d+ files? changed|@@ -\d)")
_HEAD = re.compile(
    r"^(?:commit [0-9a-f]{7,64}|tree [0-9a-f]{40}$|parent [0-9a-f]{40}$|(?:author|committer|tagger) .*[<>].* \d+ [+-]\d{4}$|(?:Author|AuthorDate|Commit|CommitDate|Date|From|To|Cc|Merge|MIME-Version|Content-Type|Content-Transfer-Encoding|Message-Id|In-Reply-To|X-[A-Za-z-]+|gpgsig|encoding):? .*|From [0-9a-f]{40} .*|[0-9a-f]{7,40} \| .* \| .*)$"
)
_SUBJECT = re.compile(r"^Subject:\s*(?:\[[^\]]*\]\s*)*")
_TRAILER = re.compile(r"^(?:[A-Z][A-Za-z]*(?:-[A-Za-z]+)+|Refs?|Bugs?|Fix(?:es)?|Closes?|Resolves|Issues?|Tickets?|Link|See|Related|References|Cc|JIRA|PR)\s*:\s*\S+|^\(cherry picked from commit |^\(backported from |^git-svn-id:|^Conflicts:|^# (?:Please enter|On branch|Changes |with \'#\'|Conflicts|\t)|^#$")
#: An item of a list or a marked line: what follows the mark is a paragraph of its own.
_ITEM = re.compile(r"^(?:[*+•–-]|\d{1,3}[.)]|#{1,6})\s+")
_LOG = re.compile(r"^(?:>|\||\$ |at \S+ \(\S+:\d+\)|(?:WARN|ERROR|INFO|DEBUG)[: ]|(?:panic|error|Traceback[^:]*): )")
_MACHINE = re.compile(
    r"^(?:Merge (?:branch|tag|remote-tracking|pull request|commit|request|changes?|\S+ (?:into|to|from) )|Merged? in |Revert \"|Reapply \"|Release v?\d|Bump (?:version|\S+ (?:from|to))|Update \S+ (?:to|from) v?\d|Upgrade \S+ (?:to|from) v?\d|(?:chore|build|ci|fix)\((?:deps|deps-dev|release|main)\)|(?:chore|build|ci)(?:\([^)]*\))?!?: (?:bump|release|update|upgrade)|version v?\d|v?\d+\.\d+(?:\.\d+)?\S*$|\[(?:ci skip|skip ci|bot|automated)\]|Automatic(?:ally)? |Auto-?(?:generated|merge|build)|Build #?\d|Pick |Cherry-?pick|\S+: v?\d+\.\d+|fixup! |squash! |amend! |Initial commit$|Update lockfile|Nightly build|Publish v?\d|Tag v?\d|\[maven-release-plugin\]|Prepare (?:release|for next)|Squashed commit of|This reverts commit|This reapplies commit|Sync(?:ed)? from )",
    re.I,
)
_PREFIX = re.compile(r"^(?:\[[^\]]{1,30}\]\s*)*(?:[a-z]+(?:\([^()]{1,40}\))?!?:\s+|[\w./-]+\([^()]{1,40}\)!?:\s+)?", re.I)
_STOP = re.compile(r"(?<=[.…])[\"'”»)\]]*\s+(?=\S)|(?<=[!?])[\"'”»)\]]*\s+(?=[^\Wa-zß-ÿ\d_]|[\"“„«¿¡(])|(?<=[。！？])\s*(?=\S)")
_QUOTED = re.compile(r"\"[^\"]*\"|“[^”]*”|„[^“”]*[“”]|«[^»]*»|`[^`]*`|「[^」]*」|『[^』]*』|\([^()]*\)")
_CODE = re.compile(r"[_/@\\<>={}#$%&^~\d]|\w\.\w|[a-zß-ÿ][A-Z]")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*['’]?")
_CJK = re.compile(r"[぀-ヿ一-鿿ｦ-ﾟ]")


def sentences(text: str | None) -> list[str]:
    """The prose sentences of a commit text, in order."""
    if not text:
        return []
    text = unicodedata.normalize("NFC", text).translate(_UNSEEN)
    found: list[str] = []
    paragraph: list[str] = []

    def close() -> None:
        if paragraph:
            whole = " ".join(paragraph)
            paragraph.clear()
            whole = _PREFIX.sub("", whole, count=1)
            found.extend(s for s in _STOP.split(whole) if s)

    machine = False
    lines = [x.rstrip() for x in re.split(r"\r\n|[\r\n\u0085\u2028\u2029]", text)]
    cut = next((i for i in range(len(lines) - 1, -1, -1) if _BELOW.match(lines[i])), -1)  # the last line of a diff or its summary
    for i, raw in enumerate(lines):
        if _END.match(raw) or (raw.startswith("    ") and raw.lstrip().startswith("diff --git ")):
            break
        if raw.startswith("--- ") and lines[i + 1 : i + 2] and lines[i + 1].startswith("+++ "):
            break
        if raw == "---":
            if cut > i:
                break
            close()
            continue
        s = raw.strip()
        if not s:
            close()
            continue
        if _SUBJECT.match(s):
            close()
            s = _SUBJECT.sub("", s)
            if not s:
                continue
        elif not found and not paragraph and _HEAD.match(s):
            machine = bool(_MACHINE.match(s))
            continue
        if not paragraph and _MACHINE.match(s):
            close()
            machine = True
            continue
        if _TRAILER.match(s) or _LOG.match(s):
            close()
            continue
        if m := _ITEM.match(s):
            close()
            if machine:  # a list that a machine made
                continue
            s = s[m.end() :]
        else:
            machine = False
        paragraph.append(s)
    close()
    return found


def words_of(sentence: str) -> list[str]:
    """The words that tell a sentence's language; none for a placeholder."""
    bare = _QUOTED.sub(" ", sentence)
    # Without spaces between words, signs and digits stand beside words rather than in code.
    kept = " ".join(t for t in bare.split() if _CJK.search(t[:200]) or (len(t) <= 60 or t.isalpha()) and not _CODE.search(t))
    words: list[str] = []
    for w in _WORD.findall(kept):
        if _CJK.search(w):
            words += [w[i : i + 2] for i in range(max(1, len(w) - 1))]
        else:
            words.append(w.lower().replace("’", "'"))
    return words


# ---------------------------------------------------------------- machines


def _grams(word: str) -> np.ndarray:
    w = f"^{word}$"
    keys = {f"={word}"} | {w[i : i + n] for n in (1, 2, 3, 4) for i in range(len(w) - n + 1)} - {"^", "$"}
    return np.array([zlib.crc32(k.encode()) & ((1 << BITS) - 1) for k in keys], np.int64)


class Machines:
    """Families and, within each, one-versus-one linear machines."""

    def __init__(self) -> None:
        names = list(FAMILIES)
        self.tasks: list[tuple[str, str, list[str], list[str]]] = [(a, b, FAMILIES[a], FAMILIES[b]) for a, b in combinations(names, 2)]
        for langs in FAMILIES.values():
            self.tasks += [(a, b, [a], [b]) for a, b in combinations(langs, 2)]
        self.weights = np.zeros((1 << BITS, len(self.tasks)), np.float32)
        self.slope, self.shift = 2.0, 0.0
        self._memo: dict[str, np.ndarray] = {}

    def __getstate__(self) -> dict:
        return {"tasks": self.tasks, "weights": self.weights, "slope": self.slope, "shift": self.shift, "_memo": {}}

    def word(self, word: str) -> np.ndarray:
        s = self._memo.get(word)
        if s is None:
            if len(self._memo) >= 200_000:
                self._memo.clear()
            s = self._memo[word] = self.weights[_grams(word)].sum(axis=0)
        return s

    def decide(self, words: list[str]) -> tuple[str, float]:
        """Language and confidence of a sentence or segment."""
        lang, margin = self.margin(words)
        return lang, float(1 / (1 + np.exp(-max(-30.0, min(self.slope * margin + self.shift, 30.0)))))

    def margin(self, words: list[str]) -> tuple[str, float]:
        """Language and how far it is from the next."""
        total = sum(map(self.word, words)) / max(1, len(words)) ** 0.5
        score = {(a, b): float(x) for (a, b, *_), x in zip(self.tasks, total)}

        def winner(names: list[str]) -> tuple[str, float]:
            if len(names) == 1:
                return names[0], 9.0
            votes = dict.fromkeys(names, 0)
            margin = dict.fromkeys(names, 0.0)
            for a, b in combinations(names, 2):
                x = score[a, b]
                votes[a if x > 0 else b] += 1
                margin[a] += x
                margin[b] -= x
            best = max(names, key=lambda k: (votes[k], margin[k], k))
            close = min(score[best, o] if (best, o) in score else -score[o, best] for o in names if o != best)
            return best, close

        family, m1 = winner(list(FAMILIES))
        lang, m2 = winner(FAMILIES[family])
        return lang, min(m1, m2)

    def calibrate(self, held_out: list[tuple[str, list[str]]]) -> "Machines":
        """Slope and shift of the confidence, so that it is the share that is right among sentences not trained on."""
        rows = [(m, got == lang) for lang, words in held_out if words for got, m in [self.margin(words)]]
        right = sum(ok for _, ok in rows)
        if right and right < len(rows):
            x = np.array([m for m, _ in rows])
            hi, lo = (right + 1) / (right + 2), 1 / (len(rows) - right + 2)  # never quite sure
            y = np.array([hi if ok else lo for _, ok in rows])
            a, b = 2.0, 0.0
            for _ in range(50):  # Newton steps on the likelihood
                p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
                w = p * (1 - p) + 1e-9
                g = np.array([((y - p) * x).sum(), (y - p).sum()])
                h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-3]])
                step = np.linalg.solve(h, g)
                a, b = a + step[0], b + step[1]
            if np.isfinite(a) and a > 0:
                self.slope, self.shift = float(a), float(b)
        return self

    def train(self, samples: list[tuple[str, list[str]]], epochs: int = 8, rate: float = 0.03, reg: float = 1e-5, seed: int = 7) -> "Machines":
        """Averaged stochastic subgradient on the hinge loss, all machines at once."""
        memo: dict[str, np.ndarray] = {}
        rows = []
        for lang, words in samples:
            parts = [memo.setdefault(w, _grams(w)) if w in memo else memo.setdefault(w, _grams(w)) for w in words]
            if parts:
                idx, count = np.unique(np.concatenate(parts), return_counts=True)
                rows.append((lang, idx, (count / len(words) ** 0.5).astype(np.float32)))
        y = np.array([[1 if lang in a else -1 if lang in b else 0 for _, _, a, b in self.tasks] for lang, *_ in rows], np.float32)
        rng = np.random.default_rng(seed)
        w = np.zeros_like(self.weights)
        acc = np.zeros_like(self.weights)
        scale, step = 1.0, 0
        for _ in range(epochs):
            for r in rng.permutation(len(rows)):
                step += 1
                eta = rate / (1 + step / (2 * len(rows)))
                _, idx, val = rows[r]
                out = scale * (val @ w[idx])
                scale *= 1 - eta * reg
                hit = y[r] * (y[r] * out < 1)
                if hit.any():
                    w[idx] += np.outer(val, hit) * (eta / scale)
            acc += w * scale
        self.weights = acc / epochs
        return self


def strip_marks(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)).replace("ł", "l").replace("ß", "ss").replace("ø", "o")


def training_rows(samples: list[tuple[str, str]], seed: int = 3, words: bool = True) -> list[tuple[str, list[str]]]:
    """Sentences, parts of them, the same without marks, with slips of typing, and draws of function words."""
    rng = np.random.default_rng(seed)
    rows: list[tuple[str, list[str]]] = []

    def slip(word: str) -> str:
        if len(word) < 5:
            return word
        i = int(rng.integers(1, len(word) - 2))
        return word[:i] + (word[i + 1] + word[i] + word[i + 2 :] if rng.random() < 0.5 else word[i + 1 :])

    for lang, text in samples:
        for s in _STOP.split(text):
            said = words_of(s)
            rows.append((lang, said))
            rows.append((lang, [slip(w) if rng.random() < 0.2 else w for w in said]))
            for _ in range(2):
                if len(said) > 4:
                    a = int(rng.integers(0, len(said) - 3))
                    rows.append((lang, said[a : a + int(rng.integers(3, 7))]))
            bare = [strip_marks(w) if lang not in ("ja", "ru") else w for w in said]
            if bare != said:
                rows.append((lang, bare))
    for lang, listed in FUNCTION_WORDS.items() if words else ():
        words = sum((words_of(w) or [w] for w in listed.split()), [])
        for _ in range(150):
            pick = [words[int(i)] for i in rng.integers(0, len(words), int(rng.integers(3, 9)))]
            rows.append((lang, [strip_marks(w) if lang not in ("ja", "ru") else w for w in pick] if rng.random() < 0.2 else pick))
    return rows


def labelled_sentences(rows: list[tuple[str | None, str | None]], machines: Machines) -> list[tuple[str, list[str]]]:
    """Sentences whose language the labels of texts and the first machines settle between them.

    A sentence seen in several texts goes with the label that most of them
    have, whatever the machines say.  A text whose whole is decided as its
    label says lends its other sentences too, if none speaks clearly for
    another language.
    """
    texts = []
    seen: dict[tuple[str, ...], dict[str, int]] = {}
    for label, text in rows:
        lang = named_language(label)
        parts = [w for w in map(words_of, sentences(text)) if len(w) > 1] if lang else []
        if parts:
            texts.append((lang, parts))
            for w in {tuple(w) for w in parts}:
                votes = seen.setdefault(w, {})
                votes[lang] = votes.get(lang, 0) + 1
    settled = {}
    for w, votes in seen.items():
        best = max(votes, key=lambda k: (votes[k], k))
        others = max((n for k, n in votes.items() if k != best), default=0)
        if votes[best] >= max(3, 2 * others):
            settled[w] = best
    found = [(lang, list(w)) for w, lang in settled.items() for _ in range(min(5, seen[w][lang]))]
    for lang, parts in texts:
        rest = [w for w in parts if tuple(w) not in settled]
        if not rest or any(settled.get(tuple(w), lang) != lang for w in parts) or machines.decide(sum(parts, []))[0] != lang:
            continue
        if not any(got != lang and margin > 0.245 for got, margin in map(machines.margin, rest)):
            found += ((lang, w) for w in rest)
    return found + [(lang, [strip_marks(x) for x in w]) for lang, w in found if lang not in ("ja", "ru")]


def trained(samples: DataFrame, documents: DataFrame | None = None, rows: int = SAMPLE_ROWS, sample_docs: int = SAMPLE_DOCS) -> Machines:
    """Machines from ``samples(lang, text)`` and a bounded sample of labelled documents.

    At most ``rows`` labelled sentences are read, by lowest id, and about
    ``sample_docs`` documents, by a hash of their id; both bounds hold at every
    size of the input.
    """
    order = "sample_id" if "sample_id" in samples.columns else "text"
    kept = samples.where("lang is not null and text is not null").orderBy(order).limit(rows).select("lang", "text").collect()
    known = {x for f in FAMILIES.values() for x in f}
    base = training_rows([(r.lang, r.text) for r in kept if r.lang in known])
    # The confidence is fitted on sentences that machines trained without them are asked about.
    names = sorted({r.text for r in kept})
    apart = {x for x in names if zlib.crc32(x.encode()) % 5 == 0}
    part = Machines().train(training_rows([(r.lang, r.text) for r in kept if r.lang in known and r.text not in apart]), epochs=3)
    part.calibrate(training_rows([(r.lang, r.text) for r in kept if r.lang in known and r.text in apart], words=False))
    first = Machines().train(base)
    first.slope, first.shift = part.slope, part.shift
    if documents is None:
        return first
    n = documents.select("doc_id").count()
    if not n:
        return first
    share = min(1.0, sample_docs / n)
    drawn = documents.where(F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(1_000_000)) < share * 1_000_000).where("lang is not null and text is not null")
    more = labelled_sentences([(r.lang, r.text) for r in drawn.select("lang", "text").limit(2 * sample_docs).collect()], first)
    last = Machines().train(base + more)
    last.slope, last.shift = part.slope, part.shift
    return last


# ---------------------------------------------------------------- segments


def segments(text: str | None, machines: Machines) -> list[tuple[str, float, int, str, int]]:
    """(language, confidence, sentences, beginning, letters) of each maximal run of one language."""
    runs: list[list] = []
    for s in sentences(text):
        words = words_of(s)
        letters = sum(map(len, words))
        if not words or (len(words) < 2 and not _CJK.search(s)) or letters < 4:
            if runs:
                runs[-1][3] += 1  # too short to tell: goes with what it follows
            continue
        lang, conf = machines.decide(words)
        if runs and runs[-1][0] == lang:
            runs[-1][1].append((conf, letters))
            runs[-1][3] += 1
        else:
            runs.append([lang, [(conf, letters)], s, 1])
    return [(lang, sum(c * n for c, n in cs) / sum(n for _, n in cs), count, s[:80], sum(n for _, n in cs)) for lang, cs, s, count in runs]


def document_language(found: list[tuple[str, float, int, str, int]]) -> tuple[str | None, float]:
    """(language, confidence) of a whole text: the one with most letters, surer the larger its part; null, 0 for no prose."""
    part: dict[str, list[float]] = {}
    for lang, conf, _, _, letters in found:
        x = part.setdefault(lang, [0.0, 0.0])
        x[0] += letters
        x[1] += letters * conf
    if not part:
        return None, 0.0
    best = max(part, key=lambda k: (part[k][0], k))
    return best, part[best][1] / sum(n for n, _ in part.values())


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("seg_no", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("sentences", pa.int32()), ("label_lang", pa.string()), ("n_segments", pa.int32()), ("excerpt", pa.string())])


def _segment_batches(batches: Iterable[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    machines = model.value
    for b in batches:
        out: list[tuple] = []
        for doc, text, label in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
            found = segments(text.as_py(), machines)
            named = named_language(label)
            out += ((doc, i, lang, conf, n, named, len(found), s) for i, (lang, conf, n, s, _) in enumerate(found))
        if out:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), _SCHEMA)], schema=_SCHEMA)


_DOCUMENTS = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("confidence", pa.float64()), ("n_segments", pa.int32()), ("label_lang", pa.string())])


def _document_batches(batches: Iterable[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    machines = model.value
    for b in batches:
        out = []
        for doc, text, label in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
            found = segments(text.as_py(), machines)
            out.append((doc, *document_language(found), len(found), named_language(label)))
        if out:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), _DOCUMENTS)], schema=_DOCUMENTS)


def document_languages(documents: DataFrame, samples: DataFrame) -> DataFrame:
    """``(doc_id, lang, confidence, n_segments, label_lang)`` of every text, those without prose too; a row per delivery."""
    model = documents.sparkSession.sparkContext.broadcast(trained(samples, documents))
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang").mapInArrow(lambda it: _document_batches(it, model), "doc_id bigint, lang string, confidence double, n_segments int, label_lang string")


def language_segments(documents: DataFrame, samples: DataFrame) -> DataFrame:
    """A row per segment of every text, with the language its label names."""
    spark = documents.sparkSession
    model = spark.sparkContext.broadcast(trained(samples, documents))  # 2**BITS weights a machine, whatever the data
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang").mapInArrow(lambda it: _segment_batches(it, model), SEGMENTS)


def language_cases(found: DataFrame) -> DataFrame:
    """``(doc_id, seg_no, lang)`` where a label is missing or wrong, or languages are mixed."""
    return found.where("n_segments > 1 or label_lang is null or label_lang <> lang").select("doc_id", "seg_no", "lang").distinct()
