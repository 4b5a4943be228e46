"""The stored document table: same results, and plans that skip days and row groups."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from secstream.operators import doc_store as DS
from secstream.operators import search as S
from secstream.plans.inputs import event_docs, stored_event_docs
from secstream.session import checkpoint_dir

SF = "/root/testdata/sf0.001"


def place(spark, name):
    import uuid
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"



def plan(df):
    return df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize("key,partitions,pushed", [
    ("search_filter", True, ["EqualTo(log_type", "EqualTo(labels.sus", "GreaterThanOrEqual(event_time"]),
    ("search_page", True, ["EqualTo(log_type", "EqualTo(labels.sus", "LessThanOrEqual(event_time"]),
    ("search_host", True, ["EqualTo(attributes.host_name", "EqualTo(attributes.process_name", "EqualTo(labels.evil"]),
    ("recent_flagged", True, ["Or(EqualTo(labels.sus", "GreaterThanOrEqual(event_time"]),
    ("flagged_scan", False, ["Or(EqualTo(labels.sus"]),
])
def test_filters_reach_the_scan(spark, key, partitions, pushed):
    text = plan(E.queries()[key](spark, SF))
    line = next(x for x in text.splitlines() if x.startswith("PushedFilters"))
    for p in pushed:
        assert p in line
    if partitions:
        assert "day" in next(x for x in text.splitlines() if x.startswith("PartitionFilters"))


def test_reads_only_the_days_and_columns_asked_for(spark):
    docs = stored_event_docs(spark, SF)
    few = docs.filter(S.build_predicate(timestamp_from="2024-01-05T00:00:00Z", timestamp_to="2024-01-05T12:00:00Z",
                                        stored=True))
    days = {r[0].split("day=")[1].split("/")[0] for r in few.select(F.input_file_name()).distinct().collect()}
    assert days == {"2024-01-05"}
    line = next(x for x in plan(few.select("doc_id")).splitlines() if x.startswith("ReadSchema"))
    assert "args" not in line and "features" not in line


def test_same_documents_as_the_ingest(spark):
    a, b = event_docs(spark, SF), stored_event_docs(spark, SF).drop("day")
    assert a.schema.simpleString() == b.select(a.columns).schema.simpleString()
    assert a.exceptAll(b.select(a.columns)).count() == b.select(a.columns).exceptAll(a).count() == 0


def test_the_table_is_written_once_a_session(spark):
    one, two = stored_event_docs(spark, SF), stored_event_docs(spark, SF)
    assert sorted(one.inputFiles()) == sorted(two.inputFiles())


def document_rows(spark, rows):
    schema = ("doc_id string, log_type string, event_time timestamp, attributes struct<host_name: string, "
              "process_name: string>, labels struct<sus: int, evil: int>")
    return spark.createDataFrame(rows, schema)


def test_documents_without_time_host_or_labels_stay(spark):
    t = dt.datetime(2024, 1, 5, 23, 59, 59)
    rows = [("a", "dns", None, ("h", "p"), (1, 0)), ("b", None, t, (None, None), (None, None)),
            ("c", "dns", t, None, None), ("c", "dns", t, None, None), (None, "dns", None, None, (0, 1))]
    docs = document_rows(spark, rows)
    path = place(spark, "odd")
    DS.write_documents(docs, path)
    back = DS.read_documents(spark, path, docs.schema).drop("day")
    assert back.select(docs.columns).exceptAll(docs).count() == docs.exceptAll(back.select(docs.columns)).count() == 0
    timed = DS.read_documents(spark, path, docs.schema).filter(S.build_predicate(timestamp_from="2024-01-05", stored=True))
    assert timed.count() == 3
    assert DS.read_documents(spark, path, docs.schema).filter(S.build_predicate(stored=True)).count() == 5


def test_an_empty_table(spark):
    docs = document_rows(spark, [])
    path = place(spark, "empty")
    DS.write_documents(docs, path)
    back = DS.read_documents(spark, path, docs.schema)
    assert back.count() == 0 and back.columns == [*docs.columns, "day"]


def test_a_column_named_day_is_refused(spark):
    with pytest.raises(ValueError):
        DS.write_documents(document_rows(spark, []).withColumn("day", F.lit(1)), place(spark, "clash"))


def test_a_large_day_is_written_by_several_tasks(spark):
    docs = spark.range(40000).select(
        F.col("id").cast("string").alias("doc_id"), F.lit("dns").alias("log_type"),
        F.to_timestamp(F.lit("2024-01-05T01:00:00")).alias("event_time"),
        F.struct((F.col("id") % 50).cast("string").alias("host_name"), F.lit("p").alias("process_name")).alias("attributes"),
        F.struct(F.lit(1).alias("sus"), F.lit(0).alias("evil")).alias("labels"))
    path = place(spark, "hot")
    DS.write_documents(docs, path, tasks=8)
    stored = DS.read_documents(spark, path)
    assert len(stored.inputFiles()) == 8
    hosts = stored.groupBy(F.input_file_name()).agg(F.countDistinct("attributes.host_name").alias("n"))
    assert hosts.agg(F.max("n")).first()[0] < 12  # clustered by host
