"""What a task of the velocity queries holds."""

import duckdb
from compare import differences

from tensorloom.plans import models


def test_tasks_of_voxels_grow_in_number_with_the_table(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(models, "VOXELS", 500)
    n = duckdb.sql(f"SELECT count(*) FROM '{sf_dir}/lineitem.parquet'").fetchall()[0][0]
    df = models.velocity_decode_linear(spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and f", {-(-n // 500)}), REPARTITION_BY_NUM" in plan
    assert differences(df, models.C.oracles["velocity_decode_linear"], sf_dir) == []
