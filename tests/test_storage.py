import pytest

from lanternpost.sources import sinks, storage


class Cluster:
    class sparkContext:
        master = "spark://somewhere:7077"

    class conf:
        @staticmethod
        def get(key, default):
            return default


def test_no_machine_local_folder_on_a_cluster():
    with pytest.raises(ValueError):
        storage.shared_folder(Cluster, "x")


def test_stored_tables_are_removed(spark, tmp_path):
    table = storage.stored(spark.range(5), "numbers")
    folder = table.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert table.count() == 5
    storage.release(spark)
    with pytest.raises(FileNotFoundError):
        open(f"{folder}/_SUCCESS")


def test_a_run_replaces_its_own_metrics(spark, tmp_path):
    for run in ("1", "2", "1"):
        sinks.write_metrics(spark.range(1), str(tmp_path / "m"), "test", run)
    assert spark.read.json(str(tmp_path / "m")).count() == 2
