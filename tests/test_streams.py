"""Streams: equal to the batch form, over many files and after a restart."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from telltale import streaming as S
from telltale.operators.windows import previous_version
from telltale.queries.streams import _payload
from telltale.sources.tables import table
from telltale.streaming.store import EpochStore

SF = "/root/testdata/sf0.001"


@pytest.fixture
def arriving(spark, tmp_path):
    """A folder that files are added to, and a stream that takes them one per micro-batch."""

    def build(df):
        folder = str(tmp_path / "in")

        def add(part):
            part.coalesce(1).write.mode("append").parquet(folder)

        def stream():
            return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)

        return add, stream

    return build


def test_restart_adds_no_rows(spark, arriving, tmp_path, rows):
    events = table(spark, SF, "events")
    add, stream = arriving(events)
    ingest = lambda df: S.ingest_webhooks(df.withColumn("payload", _payload()), "payload", "ts", ["event_id"])
    out, offsets = str(tmp_path / "out"), str(tmp_path / "offsets")
    add(events.filter("event_id < 400"))
    assert S.run_available(ingest(stream()), out, offsets).count() == 400
    assert S.run_available(ingest(stream()), out, offsets).count() == 400
    add(events.filter("event_id >= 400"))
    assert rows(S.run_available(ingest(stream()), out, offsets)) == rows(ingest(events))


def test_last_chunk_over_several_epochs(spark, arriving, tmp_path, rows):
    turns = table(spark, SF, "conversations")
    add, stream = arriving(turns)
    for late in (False, True):
        add(turns.filter((F.col("turn") > 1) == late))
    last = lambda df: S.last_chunk(df, ["conv_id"], "turn", ["role", "text"])
    got = S.run_available(last(stream()), str(tmp_path / "out"), str(tmp_path / "offsets"), keys=["conv_id"])
    assert rows(got) == rows(last(turns))


def test_buckets_over_several_epochs(spark, arriving, tmp_path, rows):
    events = table(spark, SF, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    add, stream = arriving(events)
    for low in range(0, 1000, 250):
        add(events.filter(F.col("event_id").between(low, low + 249)))
    counts = S.bucket_counts(stream(), "ts", ["event_type"], late="1 hour")
    got = S.run_available(counts, str(tmp_path / "out"), str(tmp_path / "offsets"), keys=["bucket", "event_type"])
    assert rows(got) == rows(S.bucket_counts(events, "ts", ["event_type"]))


def test_a_redelivery_in_a_later_batch_adds_no_row(spark, arriving, tmp_path, rows):
    events = table(spark, SF, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    add, stream = arriving(events)
    ingest = lambda df: S.ingest_webhooks(df.withColumn("payload", _payload()), "payload", "ts", ["event_id"], "event_id", "400 days")
    out, offsets = str(tmp_path / "out"), str(tmp_path / "offsets")
    add(events.filter("event_id < 500"))
    add(events.filter("event_id BETWEEN 300 AND 700"))
    S.run_available(ingest(stream()), out, offsets)
    add(events.filter("event_id >= 100").withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 MINUTE")))
    got = S.run_available(ingest(stream()), out, offsets)
    assert rows(got, "event_id") == rows(events, "event_id")
    assert rows(got) != []


def test_a_payload_is_parsed_once(spark):
    events = table(spark, SF, "events").withColumn("payload", _payload())
    accepted = S.ingest_webhooks(events, "payload", "ts", ["event_id"], "event_id").filter("accepted AND username = 'u1'")
    plan = accepted._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1 and "get_json_object" not in plan


VERSIONS = "k string, at long, v string, status string"
ROLLED = ["k", "at", "previous_value", "effective_value"]


def test_a_late_failure_falls_between(spark, arriving, tmp_path, rows):
    first = spark.createDataFrame([("x", 1, "a", "ok"), ("x", 3, "c", "ok")], VERSIONS)
    late = spark.createDataFrame([("x", 2, "b", "failed")], VERSIONS)
    add, stream = arriving(first)
    add(first)
    args = (["k"], ["at"], "v", F.col("status") == "failed", str(tmp_path / "state"))
    assert rows(S.rollback_stream(stream(), *args), *ROLLED) == [("x", 1, None, "a"), ("x", 3, "a", "c")]
    add(late)
    want = [("x", 1, None, "a"), ("x", 2, "a", "a"), ("x", 3, "b", "c")]
    assert rows(S.rollback_stream(stream(), *args), *ROLLED) == want
    add(late)  # comes again: it replaces itself
    assert rows(S.rollback_stream(stream(), *args), *ROLLED) == want


@pytest.mark.parametrize("seed", [1, 2])
def test_rollback_in_any_order_and_split(spark, arriving, tmp_path, rows, seed):
    rng = random.Random(seed)
    made = [(rng.choice(["hot", "hot", "a", None]), i, f"v{i}", rng.choice(["ok", "failed"])) for i in range(60)]
    rng.shuffle(made)
    whole = spark.createDataFrame(made, VERSIONS)
    add, stream = arriving(whole)
    while made:
        n = rng.randint(10, 30)
        add(spark.createDataFrame(made[:n], VERSIONS))
        made = made[n:]
    got = S.rollback_stream(stream(), ["k"], ["at"], "v", F.col("status") == "failed", str(tmp_path / "state"), fan=2)
    assert rows(got, *ROLLED) == rows(previous_version(whole, ["k"], ["at"], "v", F.col("status") == "failed"), *ROLLED)


def test_versions_beyond_the_horizon_are_rejected_and_counted(spark, arriving, tmp_path, rows):
    def some(*ats):
        return spark.createDataFrame([("x", at, f"v{at}", "ok") for at in ats], VERSIONS)

    add, stream = arriving(some(1))
    for ats in ([10, 20], [15], [40], [14, 29, 31], [41]):
        add(some(*ats))
    base = str(tmp_path / "state")
    got = S.rollback_stream(stream(), ["k"], ["at"], "v", F.col("status") == "failed", base, late=10, fan=2)
    kept = some(10, 20, 15, 40, 31, 41)
    assert rows(got, *ROLLED) == rows(previous_version(kept, ["k"], ["at"], "v", F.col("status") == "failed"), *ROLLED)
    stores = S.rollback_stores(spark, base, some(1), ["k"], ["at"], "v", 10, 2)
    assert rows(stores["rejects"].read(), "at") == [(14,), (29,)]
    assert stores["state"].notes()["rejected"] == 2
    assert stores["state"].read().count() < 6  # versions that can't be a predecessor any more are gone


def test_rollback_over_events(spark, arriving, tmp_path, rows):
    events = table(spark, SF, "events").select("user_id", "event_id", "ts", "event_type", "props")
    add, stream = arriving(events)
    failed = F.col("event_type") == "error"
    args = (["user_id"], ["ts", "event_id"], "props", failed)
    columns = ["user_id", "event_id", "previous_value", "effective_value"]
    for low in (600, 0, 300):
        add(events.filter(F.col("event_id").between(low, low + 399)))
    got = S.rollback_stream(stream(), *args, path=str(tmp_path / "state"), late="400 days")
    assert rows(got, *columns) == rows(previous_version(events, *args), *columns)


KEYED = StructType().add("k", "long").add("v", "long")


def test_two_hundred_epochs_open_few_files(spark, tmp_path, rows):
    store = EpochStore(spark, str(tmp_path / "s"), KEYED, ["k"], fan=6)
    want = {}
    for epoch in range(200):
        changed = {(epoch * 7 + i) % 50: epoch for i in range(3)}
        want |= changed
        assert store.commit(epoch, spark.createDataFrame([*changed.items()], KEYED).coalesce(1))
    read = store.read()
    assert rows(read) == sorted(want.items(), key=repr)
    assert len(read.inputFiles()) <= 25
    folders = [f for f in (tmp_path / "s").iterdir() if f.is_dir()]
    assert len(folders) <= 40
    assert rows(store.read_keys(spark.createDataFrame([(3,), (49,), (77,)], "k long"))) == [(3, want[3]), (49, want[49])]


def test_a_retried_epoch_changes_nothing(spark, tmp_path, rows):
    store = EpochStore(spark, str(tmp_path / "s"), KEYED, ["k"])
    assert store.read().count() == 0
    assert store.commit(0, spark.createDataFrame([(1, 1)], KEYED))
    assert store.commit(1, spark.createDataFrame([(1, 2), (2, 2)], KEYED))
    before = store.manifest()
    assert not store.commit(1, spark.createDataFrame([(1, 9), (5, 9)], KEYED))
    assert store.manifest() == before and rows(store.read()) == [(1, 2), (2, 2)]


def test_an_attempt_that_died_is_not_read(spark, tmp_path, rows):
    store = EpochStore(spark, str(tmp_path / "s"), KEYED, ["k"])
    store.commit(0, spark.createDataFrame([(1, 1)], KEYED))
    broken = spark.range(1000).select(F.col("id").alias("k"), F.when(F.col("id") == 999, F.raise_error(F.lit("lost"))).otherwise(1).cast("long").alias("v"))
    with pytest.raises(Exception, match="lost"):
        store.commit(1, broken)
    assert rows(store.read()) == [(1, 1)]
    store.commit(1, spark.createDataFrame([(2, 2)], KEYED))
    assert rows(store.read()) == [(1, 1), (2, 2)]
