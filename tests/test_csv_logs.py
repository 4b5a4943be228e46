"""CSV files by header, discovery, missing cells, order and delivery counts."""

import os

import pytest

from secstream.operators.ingest import enrich_messages
from secstream.sources import envelope
from secstream.sources.csv_logs import discover, read_csv_logs, write_keyed

DNS = "Timestamp,SourceIP,DestinationIP,DnsQuery,DnsResponseCode,sus,evil,Extra\n"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a-dns.csv").write_text(DNS + "2021-05-16T17:13:14Z,10.0.0.1,10.0.0.2,x.org,0,1,0,e\n"
                                        "2021-05-16T17:13:15Z,10.0.0.1,10.0.0.2,\"a,\"\"b\",NaN,,1,\n")
    (tmp_path / "b-dns.csv").write_text("evil,DnsQuery,Timestamp,SourceIP\n1,y.org,1621184000.5,10.0.0.9\n")
    (tmp_path / "c_training.csv").write_text("timestamp,userId,hostName,args,eventName,sus,evil\n"
                                             "1.5,0,h,[],execve,0,0\n2.5,abc,NA,\"p q\",,0,0\n")
    (tmp_path / "notes.txt").write_text("no log")
    return str(tmp_path)


def test_discovery(spark, folder):
    assert [os.path.basename(f) for f in discover(spark, folder=folder)] == ["a-dns.csv", "b-dns.csv", "c_training.csv"]
    one = [os.path.join(folder, "b-dns.csv")]
    assert discover(spark, paths=one) == one
    with pytest.raises(FileNotFoundError, match="none.csv"):
        discover(spark, paths=one + [os.path.join(folder, "none.csv")])
    with pytest.raises(FileNotFoundError, match="No files"):
        discover(spark, folder=os.path.join(folder, "empty"))


def test_rows_by_header_with_missing_cells(spark, folder):
    got = {(r["source_file"], r["row_in_split"] & 0xFFFF): (r["log_type"], r["raw"].asDict())
           for r in read_csv_logs(spark, discover(spark, folder=folder)).collect()}
    assert len(got) == 5
    by_query = {raw["DnsQuery"]: raw for _, raw in got.values()}
    assert by_query["x.org"]["sus"] == 1.0 and by_query["x.org"]["DnsResponseCode"] == 0.0
    assert by_query['a,"b']["sus"] is None and by_query['a,"b']["DnsResponseCode"] is None
    # columns in another order, labels absent (0), the time as its own text
    y = by_query["y.org"]
    assert (y["DnsTimestamp"], y["SourceIP"], y["evil"], y["sus"]) == ("1621184000.5", "10.0.0.9", 1.0, 0.0)
    kernel = sorted((raw for kind, raw in got.values() if kind == "deep_kernel"), key=lambda r: r["timestamp"])
    assert [(r["userId"], r["hostName"], r["args"]) for r in kernel] == [(0.0, "h", "[]"), (None, None, "p q")]


def test_keyed_sink_counts_and_order(spark, folder, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sink") / "messages")
    report = write_keyed(envelope.encode(read_csv_logs(spark, discover(spark, folder=folder))), path)
    assert sorted(tuple(r) for r in report.select("source_file", "delivered", "rows_read").collect()) == [
        ("a-dns.csv", 2, 5), ("b-dns.csv", 1, 5), ("c_training.csv", 2, 5)]
    sink = spark.read.parquet(path)
    values = [r["value"] for r in sink.filter("key = 'a-dns.csv'").orderBy("split_start", "row_in_split").collect()]
    assert "x.org" in values[0] and "x.org" not in values[1]
    assert enrich_messages(sink).count() == 5
