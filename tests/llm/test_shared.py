from types import SimpleNamespace

import pytest

from tracelode.llm.shared import free_name, get, names, put, run_dir, stored


def test_folders(spark):
    """Each call gives a new folder below one root of the application."""
    a, b = run_dir(spark, "x"), run_dir(spark, "x")
    assert a != b and a.rsplit("/", 1)[0] == b.rsplit("/", 1)[0]
    put(a, "one.bin", b"123")
    put(a, "one.bin", b"123")  # a task that runs again
    assert names(a) == {"one.bin": 3} and get(a, "one.bin") == b"123" and names(b) == {}
    assert stored(spark.range(5), "y").count() == 5


def test_a_cluster_without_a_shared_folder_is_an_error():
    conf = SimpleNamespace(get=lambda *_: None)
    sc = SimpleNamespace(applicationId="none", master="yarn", getConf=lambda: conf)
    with pytest.raises(ValueError):
        run_dir(SimpleNamespace(sparkContext=sc, conf=conf), "x")


def test_free_name():
    assert free_name("a", ["b"]) == "a" and free_name("a", ["a", "_a"]) == "__a"
