"""op7's SQL gives the query's rows, on the driver's vectors and on planted ones that hold links."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import queries as registered

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int"


def _planted():
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(12, 24))
    rows = [(i, [float(x) for x in centres[i % 12] + rng.normal(size=24) * 0.2], i % 2 if i % 9 else None) for i in range(240)]
    copies = [(500 + i, rows[1][1], 1) for i in range(5)]
    odd = [(600, None, 1), (601, [0.0] * 24, 1), (602, [float("inf")] * 24, 1), (603, [1.0, 2.0], 1), (604, [None, *[1.0] * 23], 1), (605, [], 1)]
    return rows + copies + odd


@pytest.mark.parametrize("planted", [False, True])
def test_links(spark, tmp_path, planted):
    folder = SF
    if planted:
        folder = str(tmp_path)
        spark.createDataFrame(_planted(), SCHEMA).withColumn("n_links", F.lit("own")).write.parquet(f"{folder}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{folder}/embeddings.parquet{'/*.parquet' if planted else ''}')")
    want = sorted(con.execute(registered.ORACLE_SQL["op7_hnsw_near_dedup"]).fetchall())
    got = sorted(tuple(r) for r in registered.op7_hnsw_near_dedup(spark, folder).collect())
    assert got == want
    assert not planted or sum(r[1] for r in got) > 400
