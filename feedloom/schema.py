"""Table schemas shared by every operator."""

from pyspark.sql import types as T

KEY = ["id", "community_id"]

POSTS = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("community_id", T.StringType(), False),
        T.StructField("community_name", T.StringType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("permalink", T.StringType(), False),
        T.StructField("time_created", T.LongType(), False),
        T.StructField("time_stored", T.LongType(), False),
        T.StructField("is_active", T.BooleanType(), False),
        T.StructField("is_sticky", T.BooleanType(), False),
        T.StructField("score", T.LongType(), False),
        T.StructField("title", T.StringType(), False),
        T.StructField("url", T.StringType(), True),
    ]
)
POST_COLUMNS = POSTS.fieldNames()

# A repeated post refreshes its other columns; these stay as first stored.
FIRST_SEEN = ["community_name", "time_created", "time_stored"]

# An item of a built feed, as kept in snapshots.
FEED_ITEMS = T.StructType(
    [
        *POSTS.fields,
        T.StructField("feed", T.StringType()),
        T.StructField("feed_media", T.StringType()),
        T.StructField("age_in_days", T.LongType()),
        T.StructField(
            "media",
            T.StructType(
                [T.StructField("url", T.StringType()), T.StructField("embed", T.StringType())]
            ),
        ),
        T.StructField("display_rank", T.LongType()),
    ]
)

# A landed listing row, in the field names of the listing files.
LISTING = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("community_id", T.StringType()),
        T.StructField("community", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("permalink", T.StringType()),
        T.StructField("created_utc", T.DoubleType()),
        T.StructField("deleted", T.BooleanType()),
        T.StructField("stickied", T.BooleanType()),
        T.StructField("score", T.LongType()),
        T.StructField("title", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("page_no", T.LongType()),
        T.StructField("pos", T.LongType()),
    ]
)

# As read: with the text of a line that is no such row.
CORRUPT = "_corrupt_record"
READ_LISTING = T.StructType([*LISTING.fields, T.StructField(CORRUPT, T.StringType())])

# What a post can't be stored without.
REQUIRED_IN_LISTING = [
    "id", "community_id", "community", "name", "permalink", "created_utc", "score", "title",
]

FEED_DOCUMENT = T.StructType(
    [
        T.StructField("document", T.StringType()),
        T.StructField(
            "feeds",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("name", T.StringType()),
                        T.StructField("description", T.StringType()),
                        T.StructField("media", T.StringType()),
                        T.StructField("percentile", T.DoubleType()),
                        T.StructField("max_daily_posts", T.LongType()),
                        T.StructField(
                            "communities",
                            T.ArrayType(
                                T.StructType(
                                    [
                                        T.StructField("name", T.StringType()),
                                        T.StructField("percentile", T.DoubleType()),
                                        T.StructField("max_daily_posts", T.LongType()),
                                    ]
                                )
                            ),
                        ),
                    ]
                )
            ),
        ),
    ]
)

ACCOUNT_DOCUMENT = T.StructType(
    [
        T.StructField("document", T.StringType()),
        T.StructField(
            "feeds",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("name", T.StringType()),
                        T.StructField("description", T.StringType()),
                        T.StructField(
                            "filters",
                            T.ArrayType(
                                T.StructType(
                                    [
                                        T.StructField("account", T.StringType()),
                                        T.StructField("filtertype", T.StringType()),
                                        T.StructField("percentile", T.DoubleType()),
                                        T.StructField("max_daily_posts", T.LongType()),
                                    ]
                                )
                            ),
                        ),
                    ]
                )
            ),
        ),
    ]
)
