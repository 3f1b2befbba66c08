"""How tables are dealt out to tasks, and how saved ones look to the planner."""

from pathlib import Path

from pyspark.sql import functions as F

from codelode.queries.codebase import code_files
from codelode.queries.registry import doc_units
from codelode.sources.scratch import DROP_SHUFFLES, dealt, saved, spread


def one_file(spark, rows, path, **columns):
    made = spark.range(rows).select("id", *[c.alias(n) for n, c in columns.items()])
    made.coalesce(1).write.parquet(str(path))
    return spark.read.parquet(str(path))


def scans(df):
    """Partitions of the scan that the work on the rows runs in."""
    return df.rdd.getNumPartitions()


def test_rows_of_one_file_are_dealt_out(spark, tmp_path):
    df = one_file(spark, 2000, tmp_path / "t")
    assert df.rdd.getNumPartitions() == 1
    assert dealt(df).rdd.getNumPartitions() == 1
    assert dealt(df, 100).rdd.getNumPartitions() == 20
    assert sorted(r.id for r in spread(df, 100).collect()) == list(range(2000))
    assert scans(spread(df, 100).where("id % 3 = 0")) > 1


def test_no_rows_and_few_rows(spark, tmp_path):
    df = one_file(spark, 3, tmp_path / "t")
    assert sorted(r.id for r in spread(df).collect()) == [0, 1, 2]
    assert spread(df.where("id < 0")).collect() == []


def test_filters_on_source_files_stay_with_the_dealt_rows(spark, tmp_path):
    one_file(spark, 2000, tmp_path / "part.parquet", p_partkey=F.col("id"), p_size=(F.col("id") % 40).cast("int"),
             p_brand=F.lit("Brand#1"), p_name=F.lit("red nut"), p_type=F.lit("x"))
    files = code_files(spark, str(tmp_path))
    assert scans(files.where(F.length("text") > 10)) > 1
    assert files.count() == 2000


def test_documents_of_one_row_group_are_dealt_out(spark, tmp_path):
    one_file(spark, 2000, tmp_path / "documents.parquet", doc_id=F.col("id"), text=F.lit("some words"),
             source=F.lit("a1"), lang=F.lit("en"))
    assert scans(doc_units(spark, str(tmp_path))) > 1


def test_plain_tables_do_not_hide_their_size(spark):
    rows = spark.range(20_000).select(F.lit("the same text in every row").alias("text"))

    def size(df):
        return sum(Path(f.removeprefix("file://")).stat().st_size for f in df.inputFiles())

    assert size(saved(rows, "t")) < 200_000
    assert size(saved(rows, "t", plain=True)) > 20_000 * 26


def test_saved_tables_leave_no_shuffled_rows(spark):
    disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()

    def shuffled():
        return {f.getName() for f in iter_java(disk.getAllFiles()) if f.getName().startswith("shuffle_")}

    def iter_java(files):
        return [files.apply(i) for i in range(files.size())]

    before = shuffled()
    rows = saved(spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count(), "t")
    left = shuffled() - before
    assert rows.count() == 7
    assert not left
    assert spark.conf.get(DROP_SHUFFLES) == "false"
