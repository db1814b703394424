"""Schemas, declared once and never inferred."""

OBJECTS = "oid string, type string, size bigint, payload binary, computed_oid string, integrity_mismatch boolean, trailing_bytes bigint, source string, location string, pos bigint, error string"
NOTES = "kind string, type string, location string, description string"
COMMITS = "oid string, tree string, parents array<string>, author string, timestamp bigint, zone string, committer string, extra_headers array<struct<key:string,value:string>>, message binary, error string"
ENTRIES = "tree_oid string, pos int, mode string, name binary, child_oid string, safety_flag int, unknown_mode boolean, error string"
TAGS = "oid string, target string"
FINDING = """id string, fullDigest string, blobId string, fingerprint string, exposureState string, patternName string,
category string, confidenceScore int, confidenceTier string, redacted string, lineNumber int, byteOffset int, isBinary boolean,
occurrences array<struct<commitSha:string,commitTimestamp:bigint,commitDate:string,author:string,path:string>>,
timeline struct<earliestObservedCommit:string,earliestObservedDate:string,earliestObservedAuthor:string,removalObservedCommit:string,removalObservedDate:string,evidenceNote:string>,
evidenceSignals array<struct<rule:string,score:int,detail:string>>"""
