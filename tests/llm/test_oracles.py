import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle import connect, same  # noqa: E402

from labelgrid.llm import queries, sharding  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, name):
    same(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLES[name])


def test_shards_split_only_where_needed(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sharding.extendible_shards(docs, "doc_id", F.octet_length("text"), 40_000)
    assert got.agg(F.max("shard_bytes")).first()[0] <= 40_000
    same(got.drop("oversized"), connect(SF), queries.shards_sql(40_000))
