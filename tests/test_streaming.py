import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from runcast.sources import sinks
from runcast.streaming import averages


def write(folder, **logs):
    folder.mkdir()
    for script, lines in logs.items():
        (folder / f"8-0.5-{script}.py").write_text("\n".join(lines) + "\n")


def means(spark, sink):
    return {row["script"]: (row["time"], row["repeats"]) for row in averages.read_means(spark, sink).collect()}


def test_portions_and_nothing_new(spark, tmp_path):
    logs, sink, checkpoint = tmp_path / "logs", str(tmp_path / "sink"), str(tmp_path / "checkpoint")
    logs.mkdir()
    assert means(spark, sink) == {}
    write(logs / "a", sort=["time: 4", "time: soon", "lost executor 3"], rank=["time: 10"])
    averages.update_means(spark, str(logs), sink, checkpoint)
    assert means(spark, sink) == {"sort.py": (4.0, 1), "rank.py": (10.0, 1)}
    averages.update_means(spark, str(logs), sink, checkpoint)
    write(logs / "b", sort=["time: 6", "time: 8"], join=["nothing"])
    averages.update_means(spark, str(logs), sink, checkpoint)
    assert means(spark, sink) == {"sort.py": (6.0, 3), "rank.py": (10.0, 1)}
    averages.compact(spark, sink, str(tmp_path / "compacted"))
    write(logs / "c", rank=["time: 20"])
    averages.update_means(spark, str(logs), str(tmp_path / "compacted"), checkpoint)
    assert means(spark, str(tmp_path / "compacted")) == {"sort.py": (6.0, 3), "rank.py": (15.0, 2)}


def test_restart_in_the_midst_of_a_batch(spark, tmp_path, monkeypatch):
    logs, sink, checkpoint = tmp_path / "logs", str(tmp_path / "sink"), str(tmp_path / "checkpoint")
    logs.mkdir()
    write(logs / "a", sort=["time: 1"])
    averages.update_means(spark, str(logs), sink, checkpoint)
    write(logs / "b", sort=["time: 3"], rank=["time: 7"])
    whole = averages.write_batch

    def lost(sums, batch, to):
        whole(sums, batch, to)
        raise RuntimeError("driver lost after writing")

    monkeypatch.setattr(averages, "write_batch", lost)
    with pytest.raises(PySparkException):
        averages.update_means(spark, str(logs), sink, checkpoint)
    monkeypatch.setattr(averages, "write_batch", whole)
    write(logs / "c", sort=["time: 5"])
    averages.update_means(spark, str(logs), sink, checkpoint)
    assert means(spark, sink) == {"sort.py": (3.0, 3), "rank.py": (7.0, 1)}


def test_a_hot_run_is_several_files(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        lines = spark.range(60_000).select(F.when(F.col("id") % 10 > 0, "hot").otherwise(F.concat(F.lit("r"), F.col("id") % 70)).alias("run"),
                                           F.concat(F.lit("time: "), F.sha2(F.col("id").cast("string"), 256)).alias("value"))
        sinks.write_run_texts(lines, str(tmp_path / "runs"))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = {folder.name: len(list(folder.glob("part-*"))) for folder in (tmp_path / "runs").glob("run=*")}
    assert files["run=hot"] > 3 and min(files.values()) <= 2
    assert spark.read.text(str(tmp_path / "runs")).count() == 60_000
