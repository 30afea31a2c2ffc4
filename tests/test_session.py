import pytest

from tapline import session


class Context:
    """Stands for a Spark context."""

    def __init__(self, master, folder=None):
        self.master, self.folder = master, folder

    def getCheckpointDir(self):  # noqa: N802
        return self.folder

    def setCheckpointDir(self, folder):  # noqa: N802
        self.folder = folder


class Session:
    def __init__(self, master, conf=None, folder=None):
        self.sparkContext = Context(master, folder)
        self.conf = self
        self.values = conf or {}

    def get(self, key, default=None):
        return self.values.get(key, default)


def test_shared_folder():
    assert session.shared_folder(Session("spark://x", folder="hdfs:/set")) == "hdfs:/set"
    assert session.shared_folder(Session("spark://x", {session.CHECKPOINT_KEY: "hdfs:/named"})) == "hdfs:/named"
    assert "tapline-checkpoint-" in session.shared_folder(Session("local[2]"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(Session("spark://x"))


def test_task_count_and_spread(spark):
    df = spark.range(1000, numPartitions=1)
    base = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert session.task_count(df, 0, 10) == base and session.task_count(df, 1000, 10) == 100
    assert session.spread(df).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    wide = spark.range(1000, numPartitions=64)
    assert session.spread(wide) is wide


def test_cut_keeps_rows(spark):
    assert sorted(r.id for r in session.cut(spark.range(10)).collect()) == list(range(10))


def test_remove(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t"))
    session.remove(spark, f"file:{tmp_path}/t")
    assert not (tmp_path / "t").exists()
    session.remove(spark, f"file:{tmp_path}/t")


def test_labels_fill_every_partition_once(spark):
    from pyspark.sql import functions as F

    from tapline.session import partition_labels

    for n in (1, 2, 12, 97):
        rows = spark.createDataFrame([(x,) for x in partition_labels(n)], "x bigint").repartition(n, "x")
        assert [r.x for r in rows.withColumn("p", F.spark_partition_id()).orderBy("p").collect()] == partition_labels(n)
        assert rows.select(F.spark_partition_id().alias("p")).distinct().count() == n
