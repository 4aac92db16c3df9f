from growthlens.session import checkpoint_dir, scale_profile, scratch_path


def test_scale_profile_sizes_partitions():
    p = scale_profile(100e12)
    assert int(p["spark.sql.shuffle.partitions"]) == int(100e12 // (256 << 20))
    assert p["spark.sql.files.maxPartitionBytes"] == str(512 << 20)
    assert int(scale_profile(1e6)["spark.sql.shuffle.partitions"]) == 200


def test_checkpoint_dir_read_from_session(spark):
    d = checkpoint_dir(spark)
    assert d == spark.conf.get("spark.checkpoint.dir")
    assert scratch_path(spark, "x").startswith(d)
