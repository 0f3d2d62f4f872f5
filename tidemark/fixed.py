"""These must equal the published task definition for results to agree."""

# Fixed values, natural order.
LABELS = ["Fast", "Medium", "Slow", "Stale"]
AUTHOR_CATEGORIES = ["COLLABORATOR", "CONTRIBUTOR", "MEMBER", "NONE", "OWNER"]
SIGNALS = [
    "pr_merged_30d",
    "avg_merge_hours_30d",
    "push_count_30d",
    "release_count_90d",
    "star_count_30d",
]
TRAIN_END = "2025-08-01"
TEST_END = "2025-11-01"
SHORT_WINDOW_DAYS = 30
LONG_WINDOW_DAYS = 90
HASH_BUCKETS = 2**18
MAX_TOKENS = 512
SAMPLE_TARGET = 500_000
SMOKE_SAMPLE_TARGET = 5_000
SMOKE_SHARDS = 3
HOLDOUT_FLOOR = 500
HOLDOUT_DIVISOR = 10
SCORING_BATCH = 64
ZERO_ALARM = 0.95
SEED = 42
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"
# End of fixed values.
