import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from feedloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(8, shared=str(tmp_path_factory.mktemp("shared")))
    session.conf.set("spark.sql.shuffle.partitions", "4")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def make_posts(spark):
    """Posts from dicts; columns left out take plain defaults."""
    from feedloom.schema import POSTS

    defaults = {
        "community_id": "c1", "community_name": "funny", "name": "t3", "permalink": "/p",
        "time_created": 1000, "time_stored": 1235, "is_active": True, "is_sticky": False,
        "score": 1, "title": "A post", "url": "",
    }

    def make(rows):
        full = [{**defaults, **row} for row in rows]
        return spark.createDataFrame([[r[c] for c in POSTS.fieldNames()] for r in full], POSTS)

    return make
