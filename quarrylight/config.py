"""Fixed values that decide results: search, ownership, impact and payload limits."""

# Retrieval
RRF_K = 60
RRF_CANDIDATES = 50
BM25_K1 = 1.5
BM25_B = 0.75
BM25_EPSILON = 0.25
TAU = 0.70
TAU_Z = 4.25
NO_SPREAD = 1e-12

# Ownership and lineage
MAX_HOPS = 3
MAX_TRACE_DEPTH = 6
TRACE_NODE_LIMIT = 100

# Impact answers
NOTIFY_DETAIL_MAX = 20
NOTIFY_BROADCAST_TOP = 10

# Payload size, in characters
OUTPUT_CHARS = 4000
IMPACT_OUTPUT_CHARS = 6000
SNIPPET_CHARS = 160

# Evaluation
F1_THRESHOLD = 0.8
BOOTSTRAP_SAMPLES = 1000
CACHED_STEP_MS = 50
FAST_ANSWER_MS = 500
EFFECT_POINTS = 0.03
EFFECT_NOISE_FACTOR = 2.0

# Scale knobs: a key with more rows than this is split over several tasks.
HOT_KEY_ROWS = 500_000
