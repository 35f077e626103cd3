"""Column functions on single values, with the edges that tables do not have."""

import base64
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from telltale import functions as T

SHA = "0123456789abcdef0123456789abcdef01234567"


@pytest.fixture
def one(spark):
    def evaluate(column):
        return spark.range(1).select(column.alias("v")).first()["v"]

    return evaluate


# Reference lines and the parts they must give.
ACTION_REFS = [
    ("uses: actions/test", ("actions", "test", None, None)),
    ("uses: actions-test/test", ("actions-test", "test", None, None)),
    ("uses: actions/test3@v1.0.0", ("actions", "test3", None, "v1.0.0")),
    ("uses: actions/test4@v2", ("actions", "test4", None, "v2")),
    (f"uses: actions/test5@{SHA} # v3.28.18", ("actions", "test5", None, SHA)),
    ("uses: actions/test6/test-action@v1.2", ("actions", "test6", "test-action", "v1.2")),
    (f"uses: actions/test7/test-action@{SHA} # v3.28.18", ("actions", "test7", "test-action", SHA)),
    ("uses: actions/test8/nested/test-action@v1.2", ("actions", "test8", "nested/test-action", "v1.2")),
    (f"uses: actions/test9/nested/test-action@{SHA} # v3", ("actions", "test9", "nested/test-action", SHA)),
    ("-      - uses: a/b@v1", ("a", "b", None, "v1")),
    ("+  uses:   a/b/c@feature/x", ("a", "b", "c", "feature/x")),
    ("uses: a/b@feature/x", ("a", "b", None, "feature/x")),
]


@pytest.mark.parametrize("line,expected", ACTION_REFS)
def test_action_ref(one, line, expected):
    assert tuple(one(T.parse_action_ref(F.lit(line)))) == expected


def test_token_rate(one):
    rate = one(T.token_rate(F.lit(73), F.lit(420_000_000)))
    assert rate == pytest.approx(174.56, rel=0.01)
    assert one(T.token_rate(F.lit(679), F.lit(82_580_000_000))) == pytest.approx(8.22, rel=0.01)
    assert one(T.token_rate(F.lit(5), F.lit(0))) is None


def test_fmt2_rounds_like_c(spark):
    rng = random.Random(7)
    values = [0.125, 0.375, 1.005, 2.675, 1e7 + 0.005, -0.001, -2.5, 0.0, 123456789.987]
    values += [rng.uniform(-1e6, 1e6) for _ in range(500)] + [round(rng.uniform(0, 99), 3) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for row in df.select("v", T.fmt2("v").alias("s")).collect():
        assert row["s"] == f"{row['v']:.2f}"


@pytest.mark.parametrize(
    "size,shown",
    [
        (0, "0 B"), (9, "9 B"), (999, "999 B"), (1000, "1.0 kB"), (8416614, "8.4 MB"), (22542794, "22 MB"),
        (155854616, "156 MB"), (10**12, "1.0 TB"),
    ],
)
def test_human_size(one, size, shown):
    assert one(T.human_size(F.lit(size).cast("bigint"))) == shown


@pytest.mark.parametrize(
    "text,expected",
    [("12", True), (" -7 ", True), ("+1_000", True), ("1__0", False), ("", False), ("1.5", False), ("x1", False),
     ("9" * 40, True), (None, False)],
)
def test_is_number(one, text, expected):
    assert one(T.is_number(F.lit(text).cast("string"))) is expected


@pytest.mark.parametrize(
    "ref,expected",
    [
        ("alpine", (None, "alpine", None)),
        ("library/alpine:3.20", (None, "library/alpine", "3.20")),
        ("reg.example.com:5000/a/b:v1", ("reg.example.com:5000", "a/b", "v1")),
        ("localhost/a", ("localhost", "a", None)),
        ("reg.example.com/a/b:v1@sha256:abc", ("reg.example.com", "a/b", "v1")),
        ("reg.example.com/a@sha256:abc", ("reg.example.com", "a", None)),
    ],
)
def test_image_ref(one, ref, expected):
    assert tuple(one(T.parse_image_ref(F.lit(ref)))) == expected


def test_strip_ref_prefix_keeps_a_value_without_slash(one):
    assert one(T.strip_ref_prefix(F.lit("docker://reg/a/b:1"))) == "reg/a/b:1"
    assert one(T.strip_ref_prefix(F.lit("plain"))) == "plain"


def test_post_url(one):
    assert one(T.post_url(F.lit("2024-01-31-a-b.md"), "https://x/")) == "https://x/a-b"


def test_maps_keep_the_last_of_a_repeated_key(one):
    assert one(T.kv_string_to_map(F.lit("name=seccomp,profile=builtin,name=x"))) == {"profile": "builtin", "name": "x"}
    assert one(T.kv_string_to_map(F.lit("S:net;P:a:b;;"), ";", ":")) == {"S": "net", "P": "a:b"}
    assert one(T.kv_string_to_map(F.lit(""))) == {}
    pairs = F.array(F.array(F.lit("a"), F.lit("1")), F.array(F.lit("a"), F.lit("2")), F.array(F.lit("b")))
    assert one(T.pairs_to_map(pairs)) == {"a": "2", "b": None}


def test_payload_round_trip_and_digest(one):
    body = json.dumps({"hash": "ü"}, ensure_ascii=False).encode()
    text, digest = base64.b64encode(body).decode(), hashlib.sha256(body).hexdigest()
    assert one(T.decode_json_payload(F.lit(text), "hash string"))["hash"] == "ü"
    assert one(T.payload_digest_matches(F.lit(text), F.lit(digest.upper()))) is True
    assert one(T.payload_digest_matches(F.lit(text), F.lit("00"))) is False
    assert one(T.decode_json_payload(F.lit("!"), "hash string")) is None


def test_cve_ids_with_both_hyphens(one):
    text = "see CVE-2021-44228, CVE‑2014‑0160 and CVE-2020-1"
    assert one(T.extract_cve_ids(F.lit(text))) == ["CVE-2021-44228", "CVE-2014-0160"]


@pytest.mark.parametrize(
    "value,expected",
    [
        ("not vulnerable (OK), no heartbeat", "ok"), ("potentially NOT ok, gzip", "potential"),
        ("potentially VULNERABLE, uses CBC", "potential"), ("VULNERABLE (NOT ok)", "not ok"),
        ("not offered (OK)", "ok"), ("--", "info"),
    ],
)
def test_verdict(one, value, expected):
    assert one(T.verdict(F.lit(value))) == expected


def test_missing_values_stay_missing(one):
    none = F.lit(None).cast("string")
    assert one(T.risk_score(F.lit("odd"))) is None
    assert one(T.fenced_json(F.lit("no block"), "a int")) is None
    assert one(T.embedded_json(F.lit("{broken"), "$.a")) is None
    assert one(T.epoch_to_ts(F.lit("later"))) is None
    assert one(T.choose_scan_mode(none, F.lit("docker")))["mode"] == "directory"
    assert one(T.is_pinned_ref(none)) is False


@pytest.mark.parametrize(
    "glob,path,hit",
    [
        ("a/**", "a/b/c", True), ("a/*", "a/b/c", False), ("**/*.md", "x.md", True), ("**/*.md", "a/b/x.md", True),
        ("a?.txt", "ab.txt", True), ("a.txt", "aXtxt", False),
    ],
)
def test_globs(one, glob, path, hit):
    assert one(F.lit(path).rlike(T.glob_to_regex(glob))) is hit


def test_times_do_not_depend_on_the_session_zone(spark, one):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert str(one(T.epoch_to_ts(F.lit("1733896498")))) == "2024-12-11 05:54:58"
        assert str(one(T.offset_to_ts(F.lit("2024-01-31T16:49:14.123456789Z")))) == "2024-01-31 16:49:14.123456"
        assert str(one(T.offset_to_ts(F.lit("2024-01-31T09:49:14-07:00")))) == "2024-01-31 16:49:14"
        assert one(T.offset_to_ts(F.lit("soon"))) is None
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_is_number_agrees_with_python(spark):
    rng = random.Random(11)
    texts = ["".join(rng.choice("0123_+- .x") for _ in range(rng.randint(0, 6))) for _ in range(3000)]

    def python_says(text):
        try:
            int(text)
        except ValueError:
            return False
        return True

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in df.select("t", T.is_number("t").alias("n")).collect():
        assert row["n"] == python_says(row["t"]), row["t"]
