import os

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from runcast.operators import prepare, stats, workloads
from runcast.session import clear_scratch, materialize, scratch_folder
from runcast.sources import mldata, synthetic


@pytest.fixture(scope="module")
def clouds(spark):
    return synthetic.blobs(synthetic.row_ids(spark, 4000, 8)).cache()


def test_clouds(spark, clouds):
    assert clouds.groupBy("label").count().where("count <> 1000").count() == 0
    means = clouds.groupBy("label").agg(*[F.avg(F.get(vector_to_array("features"), F.lit(i))).alias(f"m{i}") for i in (0, 49)],
                                        F.stddev(F.get(vector_to_array("features"), F.lit(7))).alias("s"))
    for row in means.collect():
        for i in (0, 49):
            center = 10 * (2 * synthetic.constants(37, f"center {int(row['label'])}", 50)[i] - 1)
            assert abs(row[f"m{i}"] - center) < 0.15
        assert abs(row["s"] - 1) < 0.1


def test_rows_do_not_depend_on_partitions(spark):
    one, many = (synthetic.classification(synthetic.row_ids(spark, 500, parts)).orderBy("id").collect() for parts in (1, 7))
    assert one == many


def test_classes_are_balanced(spark):
    rows = synthetic.classification(synthetic.row_ids(spark, 4000, 8))
    shares = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    assert set(shares) == {0.0, 1.0} and abs(shares[0.0] - 2000) < 60
    noise = rows.select(F.get(vector_to_array("features"), F.lit(30)).alias("v")).agg(F.avg("v"), F.var_pop("v")).first()
    assert abs(noise[0]) < 0.06 and abs(noise[1] - 1) < 0.08


def test_regression_is_found_again(spark):
    rows = synthetic.regression(synthetic.row_ids(spark, 3000, 8))
    model = workloads.linear_fit(rows, penalty=0.0)
    expected = [100 * c for c in synthetic.constants(37, "coefficient", 4)]
    assert np.allclose(model.coefficients.toArray()[:4], expected, atol=1e-3)
    assert np.abs(model.coefficients.toArray()[4:]).max() < 1e-3


def test_kmeans_finds_the_clouds(spark, clouds):
    model = workloads.kmeans_fit(clouds)
    assigned = workloads.kmeans_assign(clouds, model)
    assert workloads.cluster_quality(assigned) > 0.5
    own = workloads.nearest(F.col("features"), np.array(model.clusterCenters()))
    assert assigned.where(own != F.col("prediction")).count() == 0
    assert workloads.kmeans_centers(clouds, model).count() == 200
    start = np.array([r["features"].toArray() for r in clouds.orderBy("id").limit(4).collect()])
    settled = workloads.lloyd(clouds, start, 3)
    assert workloads.assignment_cost(clouds, settled) <= workloads.assignment_cost(clouds, start)
    assert model.summary.trainingCost <= workloads.assignment_cost(clouds, start)


def test_minus_one_labels_need_the_remap(spark):
    rows = spark.createDataFrame([(-1.0, 0.0), (1.0, 1.0), (-1.0, 1.0), (1.0, 0.0)] * 5, "label double, x double")
    vectors = mldata.assemble(rows, ["x"], "label")
    with pytest.raises(Exception):
        workloads.logistic_fit(vectors)
    fixed = vectors.withColumn("label", prepare.zero_one_label(F.col("label")))
    assert abs(workloads.logistic_fit(fixed).intercept) < 1e-6


def test_three_components(spark, clouds):
    model = workloads.pca_fit(clouds)
    assert workloads.pca_axes(clouds, model).count() == 150
    row = workloads.pca_project(clouds, model).first()
    axes = model.pc.toArray()
    signs = np.sign(axes[np.abs(axes).argmax(0), range(3)])
    assert np.allclose(row["projected"], row["features"].toArray() @ axes * signs)


def test_correlation_forms_agree(spark, clouds):
    plain = clouds.select(*[F.get(vector_to_array("features"), F.lit(i)).alias(f"c{i}") for i in range(4)])
    by_column = {(r["i"], r["j"]): r["value"] for r in stats.correlation_columns(plain, plain.columns).collect()}
    by_vector = {(r["i"], r["j"]): r["value"] for r in stats.correlation_matrix(clouds).collect()}
    assert all(abs(by_vector[k] - v) < 1e-9 for k, v in by_column.items())


def test_samples(spark):
    rows = spark.range(20_000)
    assert prepare.sample_rows(rows, 0.1).collect() == prepare.sample_rows(rows, 0.1).collect()
    first = prepare.sample_by_key(rows, F.col("id"), 0.1)
    again = prepare.sample_by_key(rows.repartition(5), F.col("id"), 0.1)
    assert sorted(r["id"] for r in first.collect()) == sorted(r["id"] for r in again.collect())
    assert abs(first.count() - 2000) < 200


def test_partition_counts(spark):
    rows = spark.range(0, 100, 1, 4)
    assert prepare.at_most_partitions(rows, 2).rdd.getNumPartitions() == 2
    assert prepare.at_most_partitions(rows, 256).rdd.getNumPartitions() == 4
    assert prepare.exactly_partitions(rows, 9).rdd.getNumPartitions() == 9


def test_partitions_count_what_has_to_be_read(spark, tmp_path):
    spark.range(0, 400_000, 1, 4).select("id", F.sha1(F.col("id").cast("string")).alias("text")).write.parquet(f"{tmp_path}/rows")
    rows, size = spark.read.parquet(f"{tmp_path}/rows"), sum(f.stat().st_size for f in tmp_path.glob("rows/*.parquet"))
    for read in (rows, rows.select("id"), prepare.sample_rows(rows.select("id"), 0.01), rows.where("id < 0")):
        assert prepare.partitions_for(read, size // 20) in (20, 21)


def test_input_of_many_files_is_prepared_on_all_cores(spark, tmp_path):
    spark.range(0, 1000, 1, 64).write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    assert prepare.prepare(rows, 0.1).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism < 64


def test_one_column_of_a_table_is_cached_in_several_tasks(spark, tmp_path):
    spark.range(0, 400_000, 1, 4).select("id", F.sha1(F.col("id").cast("string")).alias("text")).write.parquet(f"{tmp_path}/rows")
    kept, rows = prepare.load_into_cache(prepare.at_most_partitions(spark.read.parquet(f"{tmp_path}/rows").select("id")))
    held = [r["n"] for r in kept.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    kept.unpersist()
    assert rows == sum(held) == 400_000 and max(held) < rows


def test_total_order(spark):
    rows = spark.range(1000).select(F.hash("id").alias("k"))
    found = [r["k"] for r in prepare.sorted_ranges(rows, "k").collect()]
    assert found == sorted(found)


def test_timing_rows(spark, clouds):
    for name in ("kmeans", "summary", "pca"):
        told, cores, machines, fraction, seconds = workloads.timed_run(lambda: clouds, name, workloads.TIMED[name], 0.2)
        assert (told, machines, fraction) == (name, 1, 0.2) and cores > 0 and seconds > 0


def test_positions_follow_the_order(spark):
    rows = prepare.with_positions(prepare.sorted_ranges(spark.range(500).select((F.col("id") * 7 % 500).alias("k")), "k"))
    assert all(r["position"] == r["k"] for r in rows.collect()) and rows.count() == 500


def test_scratch_tables_can_be_deleted(spark):
    kept = materialize(spark.range(3), "three")
    assert kept.count() == 3 and clear_scratch(spark) >= 1
    assert not os.path.exists(kept.inputFiles()[0].removeprefix("file://")) and clear_scratch(spark) == 0


def test_scratch_follows_the_session(spark):
    assert scratch_folder(spark) == spark.conf.get("spark.checkpoint.dir")
