from types import SimpleNamespace

import pytest

from parlance.llm import common


def test_a_folder_that_is_not_shared_is_refused():
    conf = SimpleNamespace(get=lambda key: None)
    context = SimpleNamespace(getConf=lambda: conf, getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(RuntimeError):
        common.shared_dir(SimpleNamespace(sparkContext=context))


def test_cut_tables_can_be_swept(spark):
    table = common.cut(spark.range(5))
    path = table.inputFiles()[0].rsplit("/", 1)[0]
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    assert table.count() == 5 and files.exists(place)
    assert common.sweep(spark) >= 1 and not files.exists(place)


def test_join_hot_equals_a_join(spark):
    df = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 ELSE id % 50 END AS k", "id")
    side = df.groupBy("k").count().withColumnRenamed("count", "n").selectExpr("k", "k * 2 AS double", "n").where("k < 40")
    want = sorted((r.k, r.id, r.k * 2) for r in df.where("k < 40").collect())
    for least, most in ((200, 20_000), (0, 1), (10**6, 20_000)):
        joined = common.join_hot(df, side, ["k"], "n", 3000, least, most)
        assert sorted((r["k"], r["id"], r["double"]) for r in joined.collect()) == want
