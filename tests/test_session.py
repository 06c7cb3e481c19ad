"""The shared folder, and layers that follow their source."""

from types import SimpleNamespace

import pytest

from tapeweave import session
from tapeweave.plans import tables


def fake(master):
    conf = SimpleNamespace(get=lambda key, default=None: default, set=lambda key, value: None)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[3,2,3000]", "k8s://host"])
def test_clusters_must_name_a_shared_folder(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(fake(master))


def test_one_process_may_leave_it_unset():
    assert session.shared_folder(fake("local[4]"))


def test_layers_follow_their_source(spark, tmp_path):
    source = str(tmp_path / "numbers.parquet")
    spark.range(3).write.parquet(source)

    @tables.layer
    def doubled(spark, sf):
        return spark.read.parquet(source).selectExpr("id * 2 AS id")

    first = session.folder_mark(spark, str(tmp_path))
    assert doubled(spark, str(tmp_path)).count() == 3 == doubled(spark, str(tmp_path)).count()
    assert session.folder_mark(spark, str(tmp_path)) == first
    spark.range(5).write.mode("overwrite").parquet(source)
    assert session.folder_mark(spark, str(tmp_path)) != first
    assert doubled(spark, str(tmp_path)).count() == 5
