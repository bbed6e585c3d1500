import pyarrow as pa
from pyspark.sql import functions as F

from metricloom.operators import numbers
from metricloom.session import by_rows, settle


def test_settled_results_are_written_small(spark):
    kept = settle(spark.range(1000))
    assert kept.count() == 1000 and all(f.endswith(".zstd.parquet") for f in kept.inputFiles())


def most_rows(df):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    return df.coalesce(1).mapInArrow(sizes, "n long").agg(F.max("n")).first()[0]


def test_batches_of_numbers_end_by_rows(spark):
    name, df = "spark.sql.execution.arrow.maxBytesPerBatch", spark.range(5000)
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "1024b")
        assert most_rows(df) < 1000
        with by_rows(spark):
            with by_rows(spark):
                assert most_rows(df) == 5000
            assert most_rows(df) == 5000  # one job side by side has ended, the other has not
        assert spark.conf.get(name) == "1024b" and most_rows(df) < 1000
    finally:
        spark.conf.set(name, before)


def test_profiled_numbers_go_to_python_by_rows(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(numbers, "by_rows", lambda session: seen.append(1) or by_rows(session))
    got = numbers.summarise(spark.range(100), 100, 2, {"q50": 0.5}, ["id"])
    assert got["id"]["distinct"] == 100 and got["id"]["q50"] == 50.0 and len(seen) == 2
