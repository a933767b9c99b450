"""Names and bounds that the data and its consumers agree on."""

# Names found in the input data, and the bounds and labels of the
# target levels.
POSITIVE_RATINGS = (
    "Beautiful", "Courageous", "Fascinating", "Funny", "Informative",
    "Ingenious", "Inspiring", "Jaw-dropping", "Persuasive",
)
NEGATIVE_RATINGS = ("Confusing", "Longwinded", "OK", "Obnoxious", "Unconvincing")
TASKS = {
    "emotion": ("angry", "happy", "sad", "neutral"),
    "strength": ("weak", "neutral", "strong"),
    "positivity": ("negative", "neutral", "positive"),
    "gender": ("male", "female"),
}
EMBEDDING_TASK = "features"
AGE_BANDS = {"18 - 22": 0, "23 - 30": 1, "31 - 45": 2, "46 - 65": 3}
LEVELS = ("low", "medium", "high")
LEVEL_RANGES = ((float("-inf"), -1.0), (-1.0, 1.0), (1.0, float("inf")))
YEARS = (2010, 2016)
LOG_OFFSET = 0.001
MAX_TOKENS = 8191
CORRELATION_THRESHOLD = 0.2
COHORT_SIZE = 100
FOLDS = 5
SEED = 42
SVC_C = 200.0
POPULARITY_TARGETS = ("negative_ratings", "comments_per_view", "views", "ratings_views")
SURVEY_COLUMNS = (
    "log_views_norm", "comments", "speaker_id", "languages", "wc", "wpm", "duration",
    "comments_views", "views_comments", "age", "speaker_turns",
    "emotion_angry", "emotion_happy", "emotion_neutral", "emotion_sad",
    "positivity_neutral", "positivity_negative", "positivity_positive",
    "strength_strong", "strength_neutral", "strength_weak",
)

# Everything below follows from the values above.
RATINGS = POSITIVE_RATINGS + NEGATIVE_RATINGS
LABEL_STATS = ("mean", "90p", "std")
GAP_STATS = ("mean", "std", "10p", "90p")
GAPS = ("pauses", "turn_durations")


def posterior_columns(tasks=TASKS, skip=()):
    """Names of the label statistics, task by task."""
    return [
        f"{task}_{label}_{stat}"
        for task, labels in tasks.items() if task not in skip
        for label in labels
        for stat in LABEL_STATS
    ]


def gap_columns():
    return [f"{gap}_{stat}" for gap in GAPS for stat in GAP_STATS]


# The scalars given to the models leave the gender labels out.
MODEL_COLUMNS = posterior_columns(skip=("gender",)) + gap_columns()
TARGETS = ("ratings_views", "views", "comments_per_view", *RATINGS, "negative_ratings")
