"""A fourth log type in the one routing pass; dead letters still account for every message."""

import json
import uuid

import pytest
from pyspark.sql import functions as F

from secstream.operators import ingest as I
from secstream.operators.dedup import read_upserted
from secstream.operators.registry import PARSERS
from secstream.session import checkpoint_dir
from secstream.streaming.ingest import MESSAGE_SCHEMA, read_dead_letters, run_ingest
from test_doc_store import plan


def with_proxy():
    parsers = PARSERS.copy()
    parsers.register_parser("proxy", "url string, bytes double, hostName string", lambda raw: {
        "timestamp": raw("timestamp"), "event_name": F.lit("request"),
        "attributes": {"host_name": F.coalesce(raw("hostName"), F.lit("")), "url": raw("url"),
                       "bytes": raw("bytes").try_cast("bigint")}},
        ranges={"bytes": "bigint"}, id_fields=("url",))
    return parsers


def message(log_type, **raw):
    return json.dumps({"source_file": "f.csv", "log_type": log_type, "raw": raw})


VALUES = [
    message("proxy", timestamp="2024-01-01T00:00:00Z", url="/a", bytes=10, hostName="h1", sus=1, evil=0),
    message("proxy", timestamp="2024-01-01T00:00:00Z", url="/b", bytes="20"),
    message("proxy", timestamp="2024-01-01T00:00:00Z", url="/c", bytes=1e30),
    message("proxy", url=None),
    message("standard_host", timestamp="2024-01-01T00:00:00Z", hostName="h2", eventName="write", processId=7),
    message("dns", Timestamp="2024-01-01T00:00:00Z", DnsQuery="x.example.com"),
    message("mail", subject="x"), "no json",
]


def messages(spark, values=VALUES):
    return spark.createDataFrame([("f.csv", v, i, i) for i, v in enumerate(values)], MESSAGE_SCHEMA)


def test_a_fourth_log_type(spark):
    docs = {r["event_id"]: r for r in I.accepted_documents(messages(spark), parsers=with_proxy()).collect()}
    assert sorted(docs) == [0, 1, 3, 4, 5]
    a = docs[0]
    assert (a["attributes"]["url"], a["attributes"]["bytes"], a["attributes"]["host_name"], a["event_name"]) == ("/a", 10, "h1", "request")
    assert a["labels"]["sus"] == 1 and a["event_time"] is not None
    assert docs[1]["attributes"]["bytes"] == 20 and docs[3]["attributes"]["url"] is None and docs[3]["timestamp"] == ""
    assert docs[4]["attributes"]["host_name"] == "h2" and docs[4]["attributes"]["url"] is None
    assert docs[5]["attributes"]["dns_query"] == "x.example.com"
    assert len({d["doc_id"] for d in docs.values()}) == 5


def test_dead_letters_add_up(spark):
    dead = {r["event_id"]: r["reason"] for r in I.dead_letters(messages(spark), parsers=with_proxy()).collect()}
    assert dead == {2: "out_of_range", 6: "unknown_type", 7: "undecodable"}
    built_in = {r["event_id"]: r["reason"] for r in I.dead_letters(messages(spark)).collect()}
    assert built_in == {**{i: "unknown_type" for i in (0, 1, 2, 3, 6)}, 7: "undecodable"}


def test_known_types_are_parsed_as_before(spark):
    rows = [VALUES[4], VALUES[5]]
    old, new = (I.flat_documents(I.accepted_documents(messages(spark, rows), parsers=p)) for p in (PARSERS, with_proxy()))
    assert set(new.columns) - set(old.columns) == {"url", "bytes"}
    assert old.exceptAll(new.select(old.columns)).count() == 0


def test_one_scan_whatever_the_types(spark):
    path = f"{checkpoint_dir(spark)}/registry-{uuid.uuid4().hex}"
    messages(spark).write.parquet(path)
    parsers = with_proxy()
    for i in range(3):
        parsers.register_parser(f"more{i}", f"m{i} string", lambda raw, i=i: {"attributes": {f"m{i}": raw(f"m{i}")}})
    text = plan(I.accepted_documents(spark.read.parquet(path), parsers=parsers)).split("\n\n")[0]
    assert text.count("Scan parquet") == 1 and "Union" not in text and "Python" not in text and "Exchange" not in text


def test_the_stream_takes_the_registry(spark):
    base = f"{checkpoint_dir(spark)}/registry-{uuid.uuid4().hex}"
    messages(spark).write.parquet(f"{base}/src")
    run_ingest(spark, f"{base}/src", f"{base}/docs", f"{base}/ckpt", parsers=with_proxy())
    assert sorted(r["event_id"] for r in read_upserted(spark, f"{base}/docs").collect()) == [0, 1, 3, 4, 5]
    assert read_dead_letters(spark, f"{base}/docs-dead").count() == 3


def test_wrong_registrations_are_refused():
    parsers = with_proxy()
    with pytest.raises(ValueError):
        parsers.register_parser("proxy", "x string", lambda raw: {})
    with pytest.raises(ValueError):
        parsers.register_parser("other", "url double", lambda raw: {})
    with pytest.raises(ValueError):
        parsers.register_parser("other", "x double", lambda raw: {}, ranges={"y": "int"})
    with pytest.raises(ValueError):
        parsers.register_parser("other", "x double", lambda raw: {}, ranges={"bytes": "int"})
    assert "proxy" not in PARSERS.log_types and "url" not in PARSERS.raw_schema().fieldNames()


def test_unknown_columns_are_refused(spark):
    parsers = PARSERS.copy()
    parsers.register_parser("odd", "x string", lambda raw: {"colour": raw("x")})
    with pytest.raises(ValueError):
        I.accepted_documents(messages(spark), parsers=parsers)
