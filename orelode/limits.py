"""Ceilings and constants (fixed values)."""

import os
from dataclasses import dataclass

MAX_OBJECT_BYTES = 64 * 1024 * 1024
MAX_BLOB_SCANNED = 10 * 1024 * 1024
BINARY_SNIFF_BYTES = 8192
CONTEXT_BYTES = 100
MAX_PACK_BYTES = 512 * 1024 * 1024
MAX_DELTA_DEPTH = 50
MAX_TARGET_BYTES = 64 * 1024 * 1024
MAX_SIZE_BYTES = 9
MAX_OFFSET_BYTES = 10
MAX_TREE_DEPTH = 1000
MAX_PEEL_DEPTH = 10
MAX_SYMBOLIC_DEPTH = 10
MAX_TOTAL_OBJECTS = 500_000
SCHEMA_VERSION = "1.0"
TOOL_NAME = "orelode"
TOOL_VERSION = "0.1.0-dev"
# Set by a build; a checkout has neither.
TOOL_COMMIT = os.environ.get("ORELODE_COMMIT", "unknown")
TOOL_BUILT = os.environ.get("ORELODE_BUILT", "unknown")


@dataclass(frozen=True)
class Limits:
    """The ceilings of one scan.  Each default is the fixed one above; a larger one reads what that passes over."""

    object_bytes: int = MAX_OBJECT_BYTES
    blob_bytes: int = MAX_BLOB_SCANNED
    pack_bytes: int = MAX_PACK_BYTES
    delta_depth: int = MAX_DELTA_DEPTH
    tree_depth: int = MAX_TREE_DEPTH
    total_objects: int = MAX_TOTAL_OBJECTS
