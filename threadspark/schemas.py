"""Fixed schemas of the flat content table, the chain table and trial records."""

from pyspark.sql import types as T

# Flat content unit (one row per post or comment); field order = column order.
CONTENT_FIELDS = [
    ("url", T.StringType()),
    ("source_text", T.StringType()),
    ("subreddit", T.StringType()),
    ("author_tag", T.StringType()),
    ("tag", T.StringType()),
    ("user", T.StringType()),
    ("text", T.StringType()),
    ("date", T.StringType()),
    ("upvotes", T.LongType()),
    ("id", T.StringType()),
    ("parent_id", T.StringType()),
    ("is_post", T.BooleanType()),
    ("title", T.StringType()),
]
CONTENT_COLUMNS = [name for name, _ in CONTENT_FIELDS]
CONTENT_SCHEMA = T.StructType([T.StructField(n, t, True) for n, t in CONTENT_FIELDS])

# Fields a content unit must carry (validation rejects rows missing any of them).
REQUIRED_FIELDS = ["url", "text", "date", "id", "is_post"]

CHAIN_EXTRA = T.StructType(
    [
        T.StructField("children_ids", T.ArrayType(T.StringType()), True),
        T.StructField("child_count", T.IntegerType(), True),
        T.StructField("chain_id", T.StringType(), True),
        T.StructField("chain_rank", T.IntegerType(), True),
    ]
)

# Trial record: 16 parameters then 6 metrics.
TRIAL_PARAM_FIELDS = [
    ("lda_num_topics", T.LongType()),
    ("chunksize", T.LongType()),
    ("passes", T.LongType()),
    ("iterations", T.LongType()),
    ("decay", T.DoubleType()),
    ("alpha", T.StringType()),
    ("eta", T.StringType()),
    ("no_below", T.LongType()),
    ("no_above", T.DoubleType()),
    ("min_len", T.LongType()),
    ("max_len", T.LongType()),
    ("phraser_min_count", T.LongType()),
    ("phraser_threshold", T.LongType()),
    ("phraser_scorer", T.StringType()),
    ("dataset", T.StringType()),
    ("max_input_jsons", T.LongType()),
]
TRIAL_PARAMS = [n for n, _ in TRIAL_PARAM_FIELDS]
TRIAL_METRICS = [
    "avg_topic_coherence",
    "perplexity",
    "diversity",
    "avg_entropy",
    "stability_score",
    "model_training_time",
]
TRIAL_SCHEMA = T.StructType(
    [T.StructField(n, t, True) for n, t in TRIAL_PARAM_FIELDS]
    + [T.StructField(m, T.DoubleType(), True) for m in TRIAL_METRICS]
    + [T.StructField("status", T.StringType(), True), T.StructField("error", T.StringType(), True)]
    + [T.StructField("trial_id", T.StringType(), True)]
)
