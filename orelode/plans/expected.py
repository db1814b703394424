"""What the queries over small repositories must give: one row a line, columns apart by bars (fixed values).

Read off the formats and rules that reports, references and the command line follow; ``~`` is null.
"""

from __future__ import annotations

REPOSITORY_CASES = """
work ¦ work ¦ work/.git ¦ work/.git ¦ false ¦ ~
work/a/b ¦ work ¦ work/.git ¦ work/.git ¦ false ¦ ~
bare.store ¦ bare.store ¦ bare.store ¦ bare.store ¦ true ¦ ~
bare.store/refs ¦ bare.store ¦ bare.store ¦ bare.store ¦ true ¦ ~
linked ¦ linked ¦ work/.git/worktrees/linked ¦ work/.git ¦ false ¦ ~
relative ¦ relative ¦ work/.git ¦ work/.git ¦ false ¦ ~
odd ¦ ~ ¦ ~ ¦ ~ ¦ ~ ¦ git repository not found: odd
half ¦ ~ ¦ ~ ¦ ~ ¦ ~ ¦ git repository not found: half
missing ¦ ~ ¦ ~ ¦ ~ ¦ ~ ¦ path does not exist: missing
"""

REFERENCE_CASES = """
ref ¦ refs/heads/main ¦ 2222222222222222222222222222222222222222 ¦ loose
ref ¦ refs/heads/kept ¦ 1111111111111111111111111111111111111111 ¦ packed
ref ¦ refs/tags/v1 ¦ 2222222222222222222222222222222222222222 ¦ packed
ref ¦ refs/heads/crlf ¦ 2222222222222222222222222222222222222222 ¦ packed
ref ¦ refs/heads/alias ¦ 2222222222222222222222222222222222222222 ¦ loose
ref ¦ refs/heads/chain10 ¦ 1111111111111111111111111111111111111111 ¦ loose
ref ¦ refs/heads/chain11 ¦ 1111111111111111111111111111111111111111 ¦ loose
ref ¦ refs/heads/chain12 ¦ 1111111111111111111111111111111111111111 ¦ loose
ref ¦ refs/heads/chain2 ¦ 1111111111111111111111111111111111111111 ¦ loose
ref ¦ refs/heads/chain3 ¦ 1111111111111111111111111111111111111111 ¦ loose
ref ¦ refs/heads/chain4 ¦ 1111111111111111111111111111111111111111 ¦ loose
ref ¦ refs/heads/chain5 ¦ 1111111111111111111111111111111111111111 ¦ loose
ref ¦ refs/heads/chain6 ¦ 1111111111111111111111111111111111111111 ¦ loose
ref ¦ refs/heads/chain7 ¦ 1111111111111111111111111111111111111111 ¦ loose
ref ¦ refs/heads/chain8 ¦ 1111111111111111111111111111111111111111 ¦ loose
ref ¦ refs/heads/chain9 ¦ 1111111111111111111111111111111111111111 ¦ loose
ref ¦ refs/heads/far ¦ 2222222222222222222222222222222222222222 ¦ loose
anomaly ¦ packed-refs:6 ¦ invalid OID: bad ¦ MALFORMED_PACKED_REF
anomaly ¦ packed-refs:7 ¦ invalid OID: xyz ¦ MALFORMED_PACKED_REF
anomaly ¦ packed-refs:8 ¦ invalid peeled OID: zz ¦ MALFORMED_PACKED_REF
anomaly ¦ refs/heads/chain0 ¦ symbolic ref cycle detected ¦ MALFORMED_REF
anomaly ¦ refs/heads/chain1 ¦ symbolic ref cycle detected ¦ MALFORMED_REF
anomaly ¦ refs/heads/gone ¦ object not found ¦ MALFORMED_REF
anomaly ¦ refs/heads/kept ¦ invalid OID: nonsense ¦ MALFORMED_REF
anomaly ¦ refs/heads/out ¦ ref name "refs/../../etc" contains invalid path traversal segments ¦ MALFORMED_REF
anomaly ¦ refs/heads/ring ¦ symbolic ref cycle detected ¦ MALFORMED_REF
head ¦ ref: refs/heads/main ¦ 2222222222222222222222222222222222222222 ¦ born
head ¦ ref: refs/heads/unborn ¦  ¦ unborn
head ¦ ref: refs/heads/kept ¦ malformed OID in ref "refs/heads/kept" ¦ error
head ¦ 1111111111111111111111111111111111111111 ¦ 1111111111111111111111111111111111111111 ¦ born
head ¦  ¦ empty HEAD file ¦ error
head ¦ zzz ¦ malformed detached HEAD OID: invalid object ID ¦ error
head ¦ ref: ¦ malformed symbolic HEAD ¦ error
name ¦ refs/heads/main ¦  ¦ good
name ¦ HEAD ¦  ¦ good
name ¦  ¦ empty ref name ¦ bad
name ¦ a\\b ¦ invalid characters in ref name "a\\b" ¦ bad
name ¦ refs/a:b ¦ invalid characters in ref name "refs/a:b" ¦ bad
name ¦ /refs/a ¦ ref name "/refs/a" cannot be an absolute path ¦ bad
name ¦ refs//a ¦ ref name "refs//a" contains invalid path traversal segments ¦ bad
name ¦ refs/./a ¦ ref name "refs/./a" contains invalid path traversal segments ¦ bad
name ¦ refs/../a ¦ ref name "refs/../a" contains invalid path traversal segments ¦ bad
name ¦ heads/a ¦ ref name "heads/a" must start with refs/ ¦ bad
"""

SCAN_CASES = """
head ¦ 0 ¦ <main> ¦ 
summary ¦ 0 ¦ totalBlobsScanned ¦ 3
summary ¦ 0 ¦ activeBlobsCount ¦ 1
summary ¦ 0 ¦ historicalBlobsCount ¦ 1
summary ¦ 0 ¦ zombieBlobsCount ¦ 1
summary ¦ 0 ¦ totalFindingsCount ¦ 3
summary ¦ 0 ¦ displayedFindingsCount ¦ 3
summary ¦ 0 ¦ criticalFindingsCount ¦ 0
summary ¦ 0 ¦ highFindingsCount ¦ 2
summary ¦ 0 ¦ mediumFindingsCount ¦ 1
summary ¦ 0 ¦ lowFindingsCount ¦ 0
finding ¦ 0 ¦ <active> ¦ ACTIVE|AWS Access Key|aws|83|HIGH|AKIA...CDEF|3|29|False
occurrence ¦ 0 ¦ <active> ¦ config.env <main> 2023-11-14T22:13:20Z Alice Smith <alice@example.com>
occurrence ¦ 1 ¦ <active> ¦ dir/.. <main> 2023-11-14T22:13:20Z Alice Smith <alice@example.com>
signal ¦ 0 ¦ <active> ¦ Strong Pattern Match 45 Matched AWS Access Key (aws)
signal ¦ 1 ¦ <active> ¦ Shannon Entropy Analysis 18 Entropy: 4.08 bits/byte
signal ¦ 2 ¦ <active> ¦ Context Keywords 20 Nearby keywords: [token]
timeline ¦ 0 ¦ <active> ¦ <main> 2023-11-14T22:13:20Z - -
finding ¦ 1 ¦ <old> ¦ HISTORICAL|GitHub Token|github|70|HIGH|ghp_...3hI6|1|9|False
occurrence ¦ 10 ¦ <old> ¦ token.txt <first> 2023-11-14T22:15:00Z Alice Smith <alice@example.com>
signal ¦ 10 ¦ <old> ¦ Strong Pattern Match 45 Matched GitHub Token (github)
signal ¦ 11 ¦ <old> ¦ Shannon Entropy Analysis 25 Entropy: 5.07 bits/byte
timeline ¦ 1 ¦ <old> ¦ <first> 2023-11-14T22:15:00Z <first> 2023-11-14T22:15:00Z
finding ¦ 2 ¦ <lost> ¦ ZOMBIE|Slack Token|slack|65|MEDIUM|xoxb...IjKl|1|1|True
signal ¦ 20 ¦ <lost> ¦ Strong Pattern Match 40 Matched Slack Token (slack)
signal ¦ 21 ¦ <lost> ¦ Shannon Entropy Analysis 25 Entropy: 4.55 bits/byte
gap ¦ 0 ¦ unreadablePack ¦ <root>/.git/objects/pack/pack-2.pack
gap ¦ 1 ¦ unresolvedPackOnly ¦ 1111111111111111111111111111111111111111
gap ¦ 2 ¦ unresolvedPackOnly ¦ 3333333333333333333333333333333333333333
anomaly ¦ 0 ¦ CORRUPTED_LOOSE_OBJECT ¦ <root>/.git/objects/ab/cccccccccccccccccccccccccccccccccccccc
anomaly ¦ 1 ¦ MISSING_REFERENCED_OBJECT ¦ 1111111111111111111111111111111111111111
anomaly ¦ 2 ¦ MISSING_REFERENCED_OBJECT ¦ 3333333333333333333333333333333333333333
anomaly ¦ 3 ¦ PACK_TRUNCATED_OR_CORRUPTED ¦ <root>/.git/objects/pack/pack-2.pack
anomaly ¦ 4 ¦ UNKNOWN_TREE_MODE ¦ <inner>:odd
anomaly ¦ 5 ¦ UNSAFE_TREE_NAME ¦ <inner>:..
"""

CLI_CASES = """
none ¦ 2 ¦  ¦ orelode looks for secrets that an object store still holds. It never writes to the store.
unknown ¦ 2 ¦  ¦ Error: unknown command "what"
version ¦ 0 ¦ orelode 0.1.0-dev (commit unknown, built unknown) ¦ 
help ¦ 0 ¦ orelode looks for secrets that an object store still holds. It never writes to the store. ¦ 
json ¦ 1 ¦ { ¦ 
critical ¦ 1 ¦ === Forensic Scan Report === ¦ Scanning repository at <root>...
mixed tier ¦ 2 ¦  ¦ Error: invalid confidence tier: High
no tier ¦ 2 ¦  ¦ Error: flag --min-confidence requires a value
unknown flag ¦ 2 ¦  ¦ Error: unknown flag --what
two paths ¦ 2 ¦  ¦ Error: unexpected argument b
no store ¦ 2 ¦  ¦ Scanning repository at <here>/missing...
no store json ¦ 2 ¦ { ¦ 
explain digest ¦ 0 ¦ === Finding Explanation === ¦ 
explain none ¦ 1 ¦  ¦ Explain error: finding "0000000000000000" was not found in current repository state
explain malformed ¦ 2 ¦  ¦ Error: invalid finding ID "xyz"; expected 16 or 64 hex characters
explain nothing ¦ 2 ¦  ¦ Error: explain requires exactly one finding ID
explain no store ¦ 2 ¦  ¦ Error: path does not exist: <here>/missing
"""

REPORT_LINES = """
report ¦ 0 ¦ === Forensic Scan Report ===
report ¦ 1 ¦ Repository: <root>
report ¦ 2 ¦ HEAD Commit: <main>
report ¦ 3 ¦ Scan Duration: 0 ms | Blobs Scanned: 3
report ¦ 4 ¦ 
report ¦ 5 ¦ --- Summary ---
report ¦ 6 ¦ Total Findings: 3 (Displayed: 3)
report ¦ 7 ¦   [CRITICAL: 0] [HIGH: 2] [MEDIUM: 1] [LOW: 0]
report ¦ 8 ¦ 
report ¦ 9 ¦ --- Findings ---
report ¦ 10 ¦ [1] Finding ID: <id0>
report ¦ 11 ¦     Exposure:   ACTIVE
report ¦ 12 ¦     Confidence: HIGH (83/100)
report ¦ 13 ¦     Pattern:    AWS Access Key (aws)
report ¦ 14 ¦     Blob OID:   <active>
report ¦ 15 ¦     Redacted:   AKIA...CDEF
report ¦ 16 ¦     Location:   Line 3 (byte offset 29)
report ¦ 17 ¦     Occurrences:
report ¦ 18 ¦       - config.env (commit <main>, 2023-11-14T22:13:20Z)
report ¦ 19 ¦       - dir/.. (commit <main>, 2023-11-14T22:13:20Z)
report ¦ 20 ¦     Timeline:   Secret remains active and reachable from current HEAD.
report ¦ 21 ¦                 Earliest observed: commit <main> (2023-11-14T22:13:20Z)
report ¦ 22 ¦ 
report ¦ 23 ¦ [2] Finding ID: <id1>
report ¦ 24 ¦     Exposure:   HISTORICAL
report ¦ 25 ¦     Confidence: HIGH (70/100)
report ¦ 26 ¦     Pattern:    GitHub Token (github)
report ¦ 27 ¦     Blob OID:   <old>
report ¦ 28 ¦     Redacted:   ghp_...3hI6
report ¦ 29 ¦     Location:   Line 1 (byte offset 9)
report ¦ 30 ¦     Occurrences:
report ¦ 31 ¦       - token.txt (commit <first>, 2023-11-14T22:15:00Z)
report ¦ 32 ¦     Timeline:   Evidence indicates secret is no longer present in current HEAD; historical commit reference preserved.
report ¦ 33 ¦                 Earliest observed: commit <first> (2023-11-14T22:15:00Z)
report ¦ 34 ¦ 
report ¦ 35 ¦ [3] Finding ID: <id2>
report ¦ 36 ¦     Exposure:   ZOMBIE
report ¦ 37 ¦     Confidence: MEDIUM (65/100)
report ¦ 38 ¦     Pattern:    Slack Token (slack)
report ¦ 39 ¦     Blob OID:   <lost>
report ¦ 40 ¦     Redacted:   xoxb...IjKl
report ¦ 41 ¦     Location:   Binary data (byte offset 1)
report ¦ 42 ¦ 
report ¦ 43 ¦ --- Coverage Gaps ---
report ¦ 44 ¦   [unreadablePack] <root>/.git/objects/pack/pack-2.pack: pack file could not be parsed: NotAPackFile
report ¦ 45 ¦   [unresolvedPackOnly] 1111111111111111111111111111111111111111: referenced object 1111111111111111111111111111111111111111 could not be resolved from storage
report ¦ 46 ¦   [unresolvedPackOnly] 3333333333333333333333333333333333333333: referenced object 3333333333333333333333333333333333333333 could not be resolved from storage
report ¦ 47 ¦ 
report ¦ 48 ¦ --- Structural Anomalies ---
report ¦ 49 ¦   [CORRUPTED_LOOSE_OBJECT] <root>/.git/objects/ab/cccccccccccccccccccccccccccccccccccccc: failed to read loose object abcccccccccccccccccccccccccccccccccccccc: InvalidZlibStream
report ¦ 50 ¦   [MISSING_REFERENCED_OBJECT] 1111111111111111111111111111111111111111: referenced blob 1111111111111111111111111111111111111111 missing from storage
report ¦ 51 ¦   [MISSING_REFERENCED_OBJECT] 3333333333333333333333333333333333333333: failed to resolve root ref target: object not found
report ¦ 52 ¦   [PACK_TRUNCATED_OR_CORRUPTED] <root>/.git/objects/pack/pack-2.pack: failed to parse pack file: NotAPackFile
report ¦ 53 ¦   [UNKNOWN_TREE_MODE] <inner>:odd: unknown octal mode: 100664
report ¦ 54 ¦   [UNSAFE_TREE_NAME] <inner>:..: unsafe entry name flag=3
report ¦ 55 ¦ 
explanation ¦ 0 ¦ === Finding Explanation ===
explanation ¦ 1 ¦ Finding ID:      <id0> (Full Digest: <digest0>)
explanation ¦ 2 ¦ Secret Category: aws (AWS Access Key)
explanation ¦ 3 ¦ Blob OID:        <active>
explanation ¦ 4 ¦ Fingerprint:     <print0>
explanation ¦ 5 ¦ Redacted:        AKIA...CDEF
explanation ¦ 6 ¦ Confidence:      HIGH (83/100)
explanation ¦ 7 ¦ 
explanation ¦ 8 ¦ --- Exposure & Forensics ---
explanation ¦ 9 ¦ <meaning>
explanation ¦ 10 ¦ 
explanation ¦ 11 ¦ --- Evidence Signals ---
explanation ¦ 12 ¦   * [+45] Strong Pattern Match: Matched AWS Access Key (aws)
explanation ¦ 13 ¦   * [+18] Shannon Entropy Analysis: Entropy: 4.08 bits/byte
explanation ¦ 14 ¦   * [+20] Context Keywords: Nearby keywords: [token]
explanation ¦ 15 ¦ 
explanation ¦ 16 ¦ --- Historical Occurrences ---
explanation ¦ 17 ¦   * config.env in commit <main> by Alice Smith <alice@example.com> on 2023-11-14T22:13:20Z
explanation ¦ 18 ¦   * dir/.. in commit <main> by Alice Smith <alice@example.com> on 2023-11-14T22:13:20Z
explanation ¦ 19 ¦ 
explanation ¦ 20 ¦ --- Timeline ---
explanation ¦ 21 ¦   Secret remains active and reachable from current HEAD.
explanation ¦ 22 ¦   Earliest observed: commit <main> by Alice Smith <alice@example.com> on 2023-11-14T22:13:20Z
explanation ¦ 23 ¦ 
color ¦ 0 ¦ \x1b[1m\x1b[36m=== Forensic Scan Report ===\x1b[0m
json ¦ 0 ¦ {
json ¦ 1 ¦   "a": [
json ¦ 2 ¦     "\\u003c\\u0026\\u003e",
json ¦ 3 ¦     "é\\u2028"
json ¦ 4 ¦   ],
json ¦ 5 ¦   "b": [],
json ¦ 6 ¦   "c": null
json ¦ 7 ¦ }
"""
