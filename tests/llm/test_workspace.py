import pytest

from quadrille.operators import cuts


def test_a_cluster_must_name_a_shared_folder(spark, monkeypatch):
    assert cuts.shared_folder(spark)
    monkeypatch.setattr(type(spark.sparkContext), "getCheckpointDir", lambda self: None)
    monkeypatch.setattr(type(spark.sparkContext.getConf()), "get", lambda self, key, default=None: None)
    assert cuts.shared_folder(spark) == spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        cuts.shared_folder(spark)
