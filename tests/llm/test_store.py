from __future__ import annotations

import pytest

from logloom.llm import store


def test_a_folder_without_a_scheme_lies_in_the_default_file_system(spark):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    try:
        assert store.address(spark, "/a/b") == "file:///a/b"
        conf.set("fs.defaultFS", "hdfs://names:8020")
        assert store.address(spark, "/a/b") == "hdfs://names:8020/a/b"
        assert store.address(spark, "file:///a/b") == store.address(spark, "file:/a/b") == "file:///a/b"
        assert store.address(spark, "s3://bucket/a") == "s3://bucket/a"
    finally:
        conf.set("fs.defaultFS", before)
    with pytest.raises(ValueError, match="absolute"):
        store.address(spark, "a/b")


def test_written_files_are_read_back(spark):
    folder = store.new_folder(spark, "trial")
    one, two = (store.write_file(folder, "name", data) for data in (b"one", b"two"))
    assert one != two and (store.read_file(one), store.read_file(two)) == (b"one", b"two")
