"""Fixed values and defaults.

The word lists, limits and patterns in this module are fixed values: results
only agree with the published ones when they are kept as they are.
"""

from __future__ import annotations

# --- Stop words -----------------------------------------------------------
# The English list that ships with Spark's StopWordsRemover.
ENGLISH_STOP_WORDS = tuple(
    """
    i me my myself we our ours ourselves you your yours yourself yourselves he
    him his himself she her hers herself it its itself they them their theirs
    themselves what which who whom this that these those am is are was were be
    been being have has had having do does did doing a an the and but if or
    because as until while of at by for with about against between into through
    during before after above below to from up down in out on off over under
    again further then once here there when where why how all any both each few
    more most other some such no nor not only own same so than too very s t can
    will just don should now i'll you'll he'll she'll we'll they'll i'd you'd
    he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've
    you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't
    doesn't didn't won't wouldn't shan't shouldn't mustn't can't couldn't cannot
    could here's how's let's ought that's there's what's when's where's who's
    why's would
    """.split()
)

# Words added to the English list for embedding topics.
TOPIC_EXTRA_STOP_WORDS = (
    "game", "games", "play", "played", "playing",
    "steam", "review", "reviews", "recommend",
    "hour", "hours",
)

# Words added to the English list for the sentence study.
STUDY_EXTRA_STOP_WORDS = (
    "game", "games", "play", "played", "playing",
    "steam", "review", "reviews", "recommend",
    "recommended", "hour", "hours", "like", "good",
    "bad", "great", "best", "worst", "really",
    "much", "many", "lot", "well", "make", "made",
)

# Words added to the English list for the fixed-count study.
FIXED_EXTRA_STOP_WORDS = (
    "game", "games", "play", "played", "playing", "player", "players",
    "steam", "review", "reviews", "recommend", "recommended", "recommendation",
    "hour", "hours", "hr", "hrs",
    "like", "good", "bad", "great", "best", "worst", "fun", "nice", "well",
    "really", "much", "many", "lot", "also", "get", "got", "make", "made",
    "time", "people", "would", "one", "even", "go", "going", "want", "say",
    "thing", "think", "know", "see", "come", "back", "use", "still",
    "early", "access", "ea", "dlc", "buy", "bought", "purchase", "price", "worth",
    "pc", "console", "etc", "ve", "re",
)


def union_words(*lists) -> list[str]:
    """Set union of word lists, sorted so plans and SQL text are repeatable."""
    return sorted(set().union(*lists))


TOPIC_STOP_WORDS = union_words(ENGLISH_STOP_WORDS, TOPIC_EXTRA_STOP_WORDS)
STUDY_STOP_WORDS = union_words(ENGLISH_STOP_WORDS, STUDY_EXTRA_STOP_WORDS)
FIXED_STOP_WORDS = union_words(ENGLISH_STOP_WORDS, FIXED_EXTRA_STOP_WORDS)

# --- Sampling and ingest --------------------------------------------------
DEFAULT_SAMPLE_SIZE = 2500
DOCUMENT_MAP_SAMPLE = 50_000
FEED_CAP = 100
RECENT_RUNS = 5
EXTRACT_ROWS = 501
SEED = 42

# --- Vectorisers ----------------------------------------------------------
STUDY_MAX_FEATURES, STUDY_MIN_DF, STUDY_MAX_DF = 12_000, 10, 0.75
FIXED_KEEP_N, FIXED_NO_BELOW, FIXED_NO_ABOVE = 10_000, 5, 0.7
TOPIC_MIN_DF, TOPIC_MAX_DF, TOPIC_NGRAMS = 2, 0.7, (1, 2)
MIN_TOKEN_LENGTH = 3

# --- Topic models ---------------------------------------------------------
SWEEP_TOPICS = range(75, 201, 25)
FIXED_TOPIC_COUNTS = (75, 100)
TOP_WORDS, REPORT_WORDS, LABEL_WORDS, COHERENCE_WORDS = 10, 19, 4, 20
LDA_MAX_ITER = 20
LDA_PASSES = 10
REDUCED_DIMENSIONS = 10
MIN_CLUSTER_SIZE, MIN_SAMPLES, CLUSTER_EPSILON = 500, 100, 0.3
OUTLIER_TOPIC = -1

# --- Topic quality --------------------------------------------------------
COHERENCE_WINDOW = 110
COHERENCE_EPSILON = 1e-12
STABILITY_RUNS, STABILITY_SHARE = 5, 0.8
VALID_MIN_SHARE, VALID_MAX_SHARE, VALID_GATE = 0.0005, 0.02, 0.8
SCORE_WEIGHTS = {"coherence": 0.3, "diversity": 0.2, "stability": 0.2, "performance": 0.3}

# --- Profile --------------------------------------------------------------
PROFILE_DROPPED_COLUMNS = (
    "recommendationid", "timestamp_created", "timestamp_updated",
    "fetch_date", "timestamp_dev_responded", "developer_response",
)

# --- Naming ---------------------------------------------------------------
NAME_FAILED = "Name Gen Failed"
NAME_NO_WORDS = "Topic with No Words"
NAME_MAX_WORDS = 12

# Words of the default polarity lexicon (own choice, replaceable by a parameter).
POSITIVE_WORDS = (
    "amazing", "awesome", "beautiful", "best", "brilliant", "enjoy", "enjoyable",
    "excellent", "fantastic", "fun", "good", "great", "impressive", "love",
    "loved", "masterpiece", "nice", "perfect", "recommend", "solid", "superb",
    "thank", "thanks", "wonderful", "worth",
)
NEGATIVE_WORDS = (
    "annoying", "awful", "bad", "boring", "broken", "bug", "buggy", "bugs",
    "crash", "crashes", "disappointing", "frustrating", "garbage", "hate",
    "horrible", "lag", "mess", "overrated", "poor", "refund", "terrible",
    "trash", "unplayable", "waste", "worst",
)
