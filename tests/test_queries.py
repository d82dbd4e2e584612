from __future__ import annotations

import pytest

from foldspark.operators import split
from foldspark.plans import catalog
from tests.oracle import connection, same

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(FOLDER)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    same(catalog.QUERIES[name](spark, FOLDER), con, catalog.ORACLE_SQL[name])


@pytest.mark.parametrize("name", ["graph_centralities", "gnm_modes", "transfer_entropy", "perturbation_response", "accessible_area", "secondary_structure"])
def test_kernels_run_without_failures(spark, name):
    rows = catalog.QUERIES[name](spark, FOLDER).collect()
    assert len(rows) == 500
    assert {r["status"] for r in rows} <= {"ok", "too small"}


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_projection_is_fitted_on_the_train_part(spark, tmp_path):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").selectExpr("vec_id", "label + 5 AS label", "embedding")
    rows.write.parquet(f"{tmp_path}/embeddings.parquet")
    train = split.cluster_split(rows, "label").where("split = 'train'").select("vec_id")
    axes = [r["axes"] for r in catalog.QUERIES["pca_project"](spark, str(tmp_path)).join(train, "vec_id").collect()]
    assert len(axes) > 8 and all(abs(sum(a[k] for a in axes) / len(axes)) < 1e-9 for k in range(8))
