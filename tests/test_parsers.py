"""Parser, envelope and feature-routing cases (restated reference unit tests)."""

from pyspark.sql import functions as F

from secstream.operators.ingest import enrich, enrich_messages, flat_documents
from secstream.sources.envelope import RAW_SCHEMA

DNS = {"DnsTimestamp": "2021-05-16T17:13:14Z", "SourceIP": "10.100.1.95", "DestinationIP": "10.100.0.2",
       "DnsQuery": "ssm.us-east-2.amazonaws.com", "DnsResponseCode": 0.0, "sus": 0.0, "evil": 0.0}
KERNEL = {"timestamp": "1621184000.0", "eventName": "execve", "hostName": "ip-10-100-1-105", "eventId": 59.0,
          "returnValue": 0.0, "processId": 1234.0, "parentProcessId": 1.0, "processName": "bash", "userId": 1000.0,
          "threadId": 1234.0, "mountNamespace": 4026531840.0, "stackAddresses": "[]", "sus": 0.0, "evil": 0.0}
HOST = {"timestamp": "1621184000.0", "eventName": "openat", "hostName": "ip-10-100-1-26", "eventId": 257.0,
        "returnValue": 3.0, "processId": 5678.0, "parentProcessId": 1000.0, "processName": "python3", "userId": 1000.0,
        "sus": 1.0, "evil": 0.0}


def raw_df(spark, rows):
    data = [(i, sf, lt, tuple(r.get(f.name) for f in RAW_SCHEMA.fields)) for i, (sf, lt, r) in enumerate(rows)]
    return spark.createDataFrame(data, f"event_id long, source_file string, log_type string, raw {RAW_SCHEMA.simpleString()}")


def docs(spark, rows):
    return {r["event_id"]: r.asDict(recursive=True) for r in enrich(raw_df(spark, rows)).collect()}


def test_dns_mapping(spark):
    d = docs(spark, [("x-dns.csv", "dns", DNS)])[0]
    assert d["log_attribute"] == "network_dns"
    assert d["timestamp"] == "2021-05-16T17:13:14Z"
    assert d["attributes"]["source_ip"] == "10.100.1.95"
    assert d["attributes"]["dns_response_code"] == 0
    assert d["labels"] == {"sus": 0, "evil": 0}
    assert d["features"]["feat_dns_failed"] == 0
    assert d["features"]["feat_dns_num_subdomains"] == 3
    assert d["event_name"] is None


def test_dns_null_response_code(spark):
    row = dict(DNS, DnsResponseCode=None)
    d = docs(spark, [("x-dns.csv", "dns", row)])[0]
    assert d["attributes"]["dns_response_code"] is None
    assert d["features"]["feat_dns_failed"] == 1


def test_kernel_and_host_mapping(spark):
    out = docs(spark, [("training.csv", "deep_kernel", KERNEL), ("host.csv", "standard_host", HOST)])
    k, h = out[0], out[1]
    assert k["timestamp"] == "1621184000.0" and k["event_name"] == "execve"
    assert k["attributes"]["thread_id"] == 1234 and k["attributes"]["mount_namespace"] == 4026531840
    assert k["features"]["feat_event_category"] == "process_exec"
    assert h["attributes"]["thread_id"] is None and h["attributes"]["stack_addresses"] is None
    assert h["features"]["feat_event_category"] == "file_access"
    assert h["labels"]["sus"] == 1


def test_defaults_on_empty_rows(spark):
    out = docs(spark, [("a-dns.csv", "dns", {}), ("t.csv", "deep_kernel", {}), ("h.csv", "standard_host", {})])
    assert out[0]["timestamp"] == "" and out[0]["attributes"]["dns_query"] == ""
    assert out[1]["event_name"] == "unknown_kernel_event"
    assert out[2]["event_name"] == "unknown_event"
    assert out[1]["labels"] == {"sus": 0, "evil": 0}
    # missing user id -> not root (G2), missing return value -> not failed
    assert out[1]["features"]["feat_is_root_user"] == 0
    assert out[1]["features"]["feat_return_failed"] == 0


def test_unknown_log_type_yields_no_row(spark):
    out = docs(spark, [("x.csv", "mystery", HOST), ("h.csv", "standard_host", HOST)])
    assert list(out) == [1]


def test_envelope_round_trip_with_nan(spark):
    msgs = spark.createDataFrame([
        ("a-dns.csv", '{"source_file":"a-dns.csv","log_type":"dns","raw":{"Timestamp":"2021-05-16T17:13:14Z",'
                      '"DnsQuery":"google.com","DnsResponseCode":NaN,"sus":0,"evil":1}}'),
        ("t.csv", '{"source_file":"t.csv","log_type":"deep_kernel","raw":{"timestamp":1621184000.0,'
                  '"userId":0,"returnValue":-1,"args":"/bin/bash -c wget http://x"}}'),
    ], "key string, value string")
    rows = {r["log_type"]: r for r in flat_documents(enrich_messages(msgs)).collect()}
    assert rows["dns"]["dns_response_code"] is None and rows["dns"]["feat_dns_failed"] == 1
    assert rows["dns"]["evil"] == 1
    assert rows["deep_kernel"]["timestamp"] == "1621184000.0"
    k = rows["deep_kernel"]
    assert (k["feat_is_root_user"], k["feat_return_failed"], k["feat_args_has_shell"], k["feat_args_has_network"]) \
        == (1, 1, 1, 1)


def test_doc_id_stable_and_replay_safe(spark):
    a = docs(spark, [("x-dns.csv", "dns", DNS)])[0]["doc_id"]
    b = docs(spark, [("x-dns.csv", "dns", DNS)])[0]["doc_id"]
    assert a == b and len(a) == 32


def test_no_python_udf_in_feature_plan(spark):
    df = enrich(raw_df(spark, [("x-dns.csv", "dns", DNS)]))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert df.select(F.col("features.feat_dns_query_entropy")).first()[0] > 0
