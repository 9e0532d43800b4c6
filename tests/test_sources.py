import gzip
import json

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from runcast.operators import campaign, stats
from runcast.session import scratch_folder
from runcast.sources import mldata, runlogs, sinks


# three instance types of different widths, three algorithms and four sizes; everything below is computed from these
TYPES = {"lean": 3, "broad": 12, "huge": 48}
ALGORITHMS = {"Sort": "tera", "Rank": "links", "Join": "sales"}
DESIGNS = [(24, 0.35), (48, 1), (96, 0.5), (144, 1)]
SECONDS = {"Sort": 71.5, "Rank": 203.25, "Join": 9.125}


def run_name(instance, algorithm, cores, fraction):
    """CORES and NUM count one more instance than the workers: the master."""
    number = cores / TYPES[instance] + 1
    return f"{instance}-{TYPES[instance] * number}-{number}-{algorithm}-{fraction:g}-{ALGORITHMS[algorithm]}.parquet"


def test_run_samples(spark, tmp_path):
    rows = [(3 * n, n, n / 7, 100.0 / n) for n in range(1, 6)]
    lines = [f"{cores},{machine},{fraction!r},{time!r}{' by hand' * (machine % 2)}" for cores, machine, fraction, time in rows]
    path = tmp_path / "measured"
    path.write_text("\n".join(["& not a sample", *lines, "", "7,8", "a,b,c,d"]) + "\n")
    read = runlogs.read_run_samples(spark, str(path)).orderBy("cores").collect()
    assert [tuple(r) for r in read] == rows


def test_run_logs_and_their_means(spark, tmp_path):
    times = {(cores, fraction): [cores + k * fraction for k in range(3)] for cores, fraction in DESIGNS}
    for (cores, fraction), seconds in times.items():
        (tmp_path / f"{cores}-{fraction:g}-rank.py").write_text(
            "\n".join([f"time: {s}" for s in seconds] + ["time: soon", "task failed"]))
    (tmp_path / "readme").write_text("time: 1")
    samples = runlogs.read_run_logs(spark, str(tmp_path))
    means = stats.mean_times(samples, ["cores", "fraction", "script"]).orderBy("cores").collect()
    assert [tuple(r) for r in means] == [
        (cores, fraction, "rank.py", sum(s) / 3, 3) for (cores, fraction), s in sorted(times.items())]
    out = str(tmp_path / "results")
    for _ in range(2):
        sinks.append_results(stats.mean_times(samples, ["cores", "fraction"]), out)
    assert spark.read.csv(out).count() == 2 * len(DESIGNS)


def test_logs_in_run_folders(spark, tmp_path):
    lines = spark.createDataFrame([("a b/c", 2, "time: 4"), ("a b/c", 1, "time: 3"), ("other", 1, "no")],
                                  "run string, at int, value string")
    for kind in ("none", "gzip"):
        path = str(tmp_path / kind)
        sinks.write_run_texts(lines, path, ["at"], compression=kind)
        assert [tuple(r) for r in runlogs.read_container_logs(spark, path).collect()] == [("a b/c", 3.0)]


def test_container_logs(spark, tmp_path):
    logs = {run_name("broad", "Sort", 96, 0.5): ("time: 71.5 ", 71.5), run_name("huge", "Join", 144, 1): ("killed", None),
            run_name("lean", "Rank", 24, 0.35): ("time: 203.25", 203.25)}
    for name, (first, _) in logs.items():
        with gzip.open(tmp_path / f"{name}-stdout.gz", "wt") as log:
            log.write("\n".join([first, *[f"time: {n}" for n in range(5_000)]]))
    rows = runlogs.read_container_logs(spark, str(tmp_path / "*.gz")).collect()
    assert {r["name"]: r["time"] for r in rows} == {name: time for name, (_, time) in logs.items() if time}


def test_result_files_and_run_names(spark, tmp_path):
    for algorithm, seconds in SECONDS.items():
        (tmp_path / run_name("broad", algorithm, 48, 1)).write_text(f"  {seconds}\n")
    (tmp_path / "notes").write_text("12")
    (tmp_path / run_name("lean", "Sort", 24, 0.35)).write_text("out of memory")
    rows = runlogs.parse_run_names(runlogs.read_result_files(spark, str(tmp_path))).collect()
    assert {(r["instance_type"], r["algorithm"], r["fraction"], r["cores"], r["instances"], r["worker_cores"], r["dataset"],
             r["time"]) for r in rows} == {("broad", name, 1.0, 60.0, 5.0, 48.0, f"{ALGORITHMS[name]}.parquet", seconds)
                                           for name, seconds in SECONDS.items()}


def test_cluster_list(spark, tmp_path):
    wanted = {run_name(instance, "Join", 96, 0.5): f"id{n}" for n, instance in enumerate(TYPES)}
    path = tmp_path / "clusters"
    path.write_text("\n".join([f" {name}\t  {ident}" for name, ident in wanted.items()] + ["", "alone"]))
    assert {r["name"]: r["cluster_id"] for r in runlogs.read_cluster_list(spark, str(path)).collect()} == wanted


CAMPAIGN = {
    "instance_type": [{"name": name, "cores": cores} for name, cores in TYPES.items()],
    "algorithm": [{"name": name, "program": f"{name.lower()}.jar", "dataset": f"lake/{data}.parquet"}
                  for name, data in ALGORITHMS.items()],
    "design": [{"cores": cores, "partition": fraction} for cores, fraction in DESIGNS],
}


def test_campaign(spark, tmp_path):
    path = tmp_path / "campaign.json"
    path.write_text(json.dumps(CAMPAIGN, indent=1))
    plan = campaign.plan_rows(runlogs.read_campaigns(spark, str(path)))
    every = [(i, a, c, f) for i in TYPES for a in ALGORITHMS for c, f in DESIGNS]
    assert plan.count() == len(every)
    sized = campaign.sized_plan(plan).collect()
    assert {r["name"] for r in sized} == {run_name(*row) for row in every}
    assert {(r["instance_type"], r["cores"], r["instances"]) for r in sized} == {
        (i, c, c // TYPES[i] + 1) for i, _, c, _ in every}
    sampled = [row for row in every if row[3] < 1]
    full = campaign.with_full_runs(plan)
    assert full.count() == len(every) + len(sampled) and full.distinct().count() == full.count()
    assert campaign.with_full_runs(full).count() == full.count()
    assert campaign.repeated(plan).count() == 3 * len(every)


def test_companions_of_rows_with_nulls_and_repeats(spark):
    rows = [("a", None, 0.5), ("a", None, 0.5), ("a", None, 1.0), ("b", 1, None), (None, 2, 0.1)]
    plan = spark.createDataFrame(rows, "name string, cores int, fraction double")
    got = sorted(map(str, (tuple(r) for r in campaign.with_full_runs(plan).collect())))
    assert got == sorted(map(str, [*rows, (None, 2, 1.0)]))


def test_published_plan_repeats(spark):
    plan = spark.range(18).select(F.col("id").cast("int").alias("cores"))
    assert campaign.repeated(plan).count() == 54


def test_small_fraction_in_a_name(spark):
    plan = spark.createDataFrame([("t", 2, "A", "p", "d/x", 4, 0.00001)],
                                 "instance_type string, cores_per_instance int, algorithm string, program string, "
                                 "dataset string, cores int, fraction double")
    assert campaign.sized_plan(plan).first()["name"] == "t-6.0-3.0-A-0.00001-x"


def test_libsvm(spark, tmp_path):
    rows = spark.createDataFrame([(1.0, Vectors.sparse(4, [0, 3], [1.5, -2.0])), (-1.0, Vectors.sparse(4, [1], [1.0]))],
                                 ["label", "features"])
    path = str(tmp_path / "data")
    mldata.write_libsvm(rows, path)
    text = sorted(r["value"] for r in spark.read.text(path).collect())
    assert text == ["-1.0 2:1.0", "1.0 1:1.5 4:-2.0"]
    back = mldata.read_libsvm(spark, path, 4).orderBy("label").collect()
    assert [list(r["features"].toArray()) for r in back] == [[0, 1, 0, 0], [1.5, 0, 0, -2.0]]
    assert mldata.read_libsvm(spark, path).count() == 2


def test_preview(spark, capsys):
    sinks.preview(spark.range(2))
    assert "id" in capsys.readouterr().out


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            values = {"spark.sql.warehouse.dir": "file:/opt/spark-warehouse"}

            @classmethod
            def get(cls, name, default=None):
                return cls.values.get(name, default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_folder(Session)
    Session.conf.values["spark.sql.warehouse.dir"] = "hdfs://store/warehouse/"
    assert scratch_folder(Session) == "hdfs://store/warehouse/_scratch"
    Session.conf.values["spark.checkpoint.dir"] = "file:///shared"
    assert scratch_folder(Session) == "file:///shared"
