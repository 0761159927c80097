import pytest
from helpers import rows_of

from lorekeep.plans import oracles, queries

SQL = oracles.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, small, duck, name):
    got = queries.queries()[name](spark, small).toPandas()
    want = duck(small).sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_ordered_curate_where_embeddings_have_near_copies(spark, small, duck, tmp_path):
    """Each four embeddings are near one another."""
    import shutil

    import numpy as np
    import pyarrow as pa
    import pyarrow.parquet as pq

    for t in "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split():
        shutil.copy(f"{small}/{t}.parquet", tmp_path)
    own = pq.read_table(f"{small}/embeddings.parquet", columns=["vec_id", "embedding"]).sort_by("vec_id").slice(0, 200)
    v = np.array(own["embedding"].to_pylist(), np.float32)
    v = v[np.arange(200) // 4] + np.random.default_rng(1).normal(0, 0.01, v.shape).astype(np.float32)
    pq.write_table(pa.table({"vec_id": own["vec_id"], "embedding": pa.array(list(v), pa.list_(pa.float32()))}), tmp_path / "embeddings.parquet")
    got = queries.queries()["curate_ordered"](spark, str(tmp_path)).toPandas()
    assert rows_of(got) == rows_of(duck(tmp_path).sql(SQL["curate_ordered"]).df())


def test_every_query_has_sql():
    assert set(queries.queries()) == set(SQL)
