"""Byte strings, names and limits that identities and stored rows depend on.

They are part of the data format, so they must be exactly these.
"""

# Prefixes hashed into identities (bytes of ASCII text).
LAYOUT_MAGIC = "AISTORE_LAYOUT"
VERSION_MAGIC = "AISTORE_VERSION"
MANIFEST_MAGIC = "AISTORE_MANIFEST"
PLACEMENT_MAGIC = "AISTORE_PLACEMENT_V1"
DESCRIPTOR_VERSION = 1

# Metadata key that holds an artifact's kind, the kinds, and the kind of a version without the key.
KIND_KEY = "aistore.artifact_kind"
KINDS = ("generic", "model-checkpoint", "dataset-snapshot", "embedding-index", "evaluation-output")
DEFAULT_KIND = "generic"

# States and strategies.
VERSION_STATES = ("staging", "committed", "failed")
LOCATION_STATES = ("available", "missing", "corrupt")
NODE_STATES = ("active", "draining", "disabled")
READABLE_NODE_STATES = ("active", "draining")
FIXED_SIZE, FASTCDC = "fixed-size", "fastcdc"
STRATEGY_CODES = {FIXED_SIZE: "01", FASTCDC: "02"}
REASONS = ("pinned", "tagged", "manifest-referenced", "keep-last-n", "age-not-reached", "policy-retire")

# Limits.
MAX_KEEP_LAST_N = 1000
MAX_AGE_SECONDS = 315360000
MAX_POLICY_NAME_BYTES = 128
MAX_PLACEMENT_NODES = 64
MAX_REPLICATION_FACTOR = 8
MAX_PAGE = 256
MIN_CDC_SIZE = 64
MAX_CHUNK_SIZE = 8 * 1024 * 1024
DEFAULT_CHUNK_SIZE = 4 * 1024 * 1024

# Gear table of the content-defined chunker: successive splitmix64 values from this seed.
GEAR_SEED = 0xA15C0DE5A15C0DE5
GEAR_SIZE = 256
