"""Session helpers: shuffle sizing from input volume and the shared
checkpoint folder."""

from gridwright import session


def test_size_for_bounds(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        assert session.size_for(spark, 10 << 20) == 200                      # small input: the floor
        assert session.size_for(spark, 1 << 40) == 4096                      # 1 TiB / 256 MiB
        assert session.size_for(spark, 100 << 40) == 409_600                 # 100 TiB / 256 MiB: no cap
        assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == str(256 << 20)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(128 << 20))
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.initialPartitionNum")


def test_checkpoint_dir_is_read_from_the_session(spark):
    d = session.checkpoint_dir(spark)
    assert d and spark.conf.get("spark.checkpoint.dir") == d
    assert session.scratch_path(spark, "x").startswith(d.rstrip("/"))
