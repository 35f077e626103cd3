"""Joins, aggregates, windows and filters on small rows with edges."""

import datetime

import random
import re

import pytest
from pyspark.sql import functions as F

from telltale.functions import kv_string_to_map
from telltale.operators import aggs, filters, joins, quality, sets, windows
from telltale.sources.sinks import with_empty_fallback

TS = datetime.datetime


@pytest.fixture
def df(spark):
    return lambda data, schema: spark.createDataFrame(data, schema)


def test_summary_is_a_ratio_of_sums(df):
    runs = df([("m", 10, 1_000_000_000, 10, 1_000_000_000), ("m", 10, 1_000_000_000, 10, 9_000_000_000)],
              "model string, pc bigint, pn bigint, ec bigint, en bigint")
    row = aggs.benchmark_summary(runs, ["model"], "pc", "pn", "ec", "en").first()
    mean_of_rates = (10 / 1 + 10 / 9) / 2
    assert row["eval_rate"] == pytest.approx(2.0) and row["eval_rate"] != pytest.approx(mean_of_rates)
    assert row["total_rate"] == pytest.approx(40 / 12)
    assert aggs.benchmark_summary(runs.filter("false"), ["model"], "pc", "pn", "ec", "en").count() == 0


def test_snapshot_diff_matches_null_keys(df, rows):
    a = df([("f", None, 1), ("f", "r1", 1), ("f", "r2", 1)], "file string, rule string, v int")
    b = df([("f", None, 2), ("f", "r2", 1), ("g", "r1", None)], "file string, rule string, v int")
    got = rows(joins.snapshot_diff(a, b, ["file", "rule"], "v"), "file", "rule", "status")
    assert got == [("f", "r1", "removed"), ("f", None, "changed"), ("g", "r1", "added")]


def test_last_pair_takes_the_last_line_of_either_sign(df, rows):
    lines = df([("c", 1, "-", "o1"), ("c", 2, "+", "n1"), ("c", 3, "-", "o2"), ("c", 4, "+", "n2"), ("d", 1, "+", "x")],
               "c string, n int, s string, v string")
    assert rows(joins.last_pair(lines, ["c"], "s", ["n"], "v")) == [("c", "o2", "n2"), ("d", None, "x")]


def test_copied_then_removed_against_pairs(spark, rows):
    data = [(i % 7, (i * 31) % 50, "add" if (i * 17) % 3 else "rm") for i in range(200)]
    table = spark.createDataFrame(data, "f int, pos int, kind string")
    table.createOrReplaceTempView("layers")
    pairs = spark.sql(
        "SELECT a.f, min(a.pos) added_at, max(b.pos) removed_at FROM layers a JOIN layers b ON a.f = b.f AND b.pos > a.pos "
        "WHERE a.kind = 'add' AND b.kind = 'rm' GROUP BY a.f"
    )
    got = joins.copied_then_removed(table, ["f"], "pos", "add", "rm", "kind")
    assert rows(got) == rows(pairs)


def test_suffix_block_takes_the_most_specific_entry(df, rows):
    asked = df([("events.ads.example.com",)] * 3 + [("ads.example.com",), ("badads.example.com",), ("example.com",)], "d string")
    listed = df([("ads.example.com",), ("events.ads.example.com",), ("ads.example.com",)], "d string")
    assert rows(joins.blocklist_suffix(asked, listed, "d")) == [
        ("ads.example.com", 1, "ads.example.com"),
        ("events.ads.example.com", 3, "events.ads.example.com"),
    ]
    assert joins.blocklist_exact(asked, listed, "d").count() == 4


def test_reachability_ends_on_a_cycle(df, rows):
    edges = df([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("c", "d")], "spdx_element_id string, related_spdx_element string")
    got = joins.sbom_reachable(edges, df([("a",)], "spdx_id string"), 5)
    assert rows(got) == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]


def test_signatures_do_not_multiply_attestations(df, rows):
    images = df([("i1", "x"), ("i2", "y")], "image string, digest string")
    signed = df([("x",), ("x",)], "digest string")
    assert rows(joins.signed_images(images, signed)) == [("x", "i1", 2)]
    assert rows(joins.unsigned_images(images, signed)) == [("y", "i2")]


def test_client_changes(df, rows):
    a = df([("c1", "TLSv1.2", "s"), ("c2", None, None), ("c3", "x", "y")], "client string, protocol string, suite string")
    b = df([("c1", "TLSv1.3", "s"), ("c2", None, "t")], "client string, protocol string, suite string")
    assert rows(joins.client_changes(a, b, "client", ["protocol", "suite"]), "client", "changed") == [
        ("c1", "protocol"), ("c2", "suite")]


def test_seccomp_default_and_repeated_rules(df, rows):
    calls = df([("read",), ("mount",), ("read",)], "name string")
    rules = df([("read", "SCMP_ACT_ALLOW"), ("read", "SCMP_ACT_ALLOW")], "name string, action string")
    assert rows(filters.seccomp_decision(calls, rules, "name")) == [
        ("mount", "SCMP_ACT_ERRNO", 1), ("read", "SCMP_ACT_ALLOW", None), ("read", "SCMP_ACT_ALLOW", None)]


def test_filters(df, rows):
    names = df([("a",), ("b",), (None,)], "n string")
    assert filters.skip_list(names, "n", []).count() == 3
    assert rows(filters.skip_list(names, "n", ["a"])) == [("b",), (None,)]
    assert filters.domain_regex_block(names, "n", []).count() == 0
    assert filters.domain_regex_block(df([("x.y",), ("",)], "n string"), "n", [r"(\.|^)*$"]).count() == 2
    levels = df([("LOW",), ("high",), ("odd",), ("CRITICAL",)], "risk_level string")
    assert rows(filters.min_risk_level(levels, "high")) == [("CRITICAL",), ("high",)]
    keys = df([(2048, 65537, "SHA256"), (1024, 1, "md5"), (None, None, None)], "bits int, e int, h string")
    assert rows(filters.crypto_policy(keys, "bits", "e", "h"), "violations", "weak_exponent") == [
        ("", False), ("key_size,exponent,hash", False), ("key_size,hash", True)]


def test_secret_redaction(df):
    text = df([('a password=hunter2 b API_KEY: "k1" token="t"',), ("no secret here",)], "line string")
    got = [r["redacted"] for r in filters.secret_lines(text, "line").collect()]
    assert got == ['a password=*** b API_KEY: "***" token="***"']


def test_certificates(df):
    certs = df([(TS(2024, 1, 31),), (TS(2023, 12, 31),)], "t timestamp_ntz")
    out = filters.cert_validity(certs, "t", "2024-01-01 00:00:00", 30).orderBy("t").collect()
    assert [(r["expired"], r["days_left"], r["expires_within"]) for r in out] == [(True, -1, False), (False, 30, False)]


def test_latest_five_of_seed_rows(df):
    stamps = [TS(2022, 2, 22, 20, 22, 6), *(TS(2022, 3, d) for d in range(1, 5)), TS(2022, 4, 20, 20, 33, 5)]
    events = df([(i, t) for i, t in enumerate(stamps, 1)], "event_id int, t timestamp_ntz")
    got = sets.latest_n(events, [F.desc("t"), F.desc("event_id")], 5).collect()
    assert [r["event_id"] for r in got] == [6, 5, 4, 3, 2]


def test_set_operations(df, rows):
    a, b = df([("x",), ("x",), ("y",), (None,)], "s string"), df([("x",), ("z",)], "s string")
    assert rows(sets.compare_sets(a, b, "s")) == [("x", "common"), ("y", "only_first"), ("z", "only_second"), (None, "only_first")]
    assert rows(sets.only_in_first(a, b)) == [("x", 1), ("y", 1), (None, 1)]
    assert sets.dedup_rerun(a.unionByName(a), ["s"]).count() == 3
    loads = df([(7, "u", 1.0), (2, "u", 3.0), (5, None, 2.0)], "id int, u string, v double")
    assert rows(sets.dedup_rerun(loads, ["u"], "id")) == [(2, "u", 3.0), (5, None, 2.0)]


@pytest.mark.parametrize("numbers", [range(7), [99_999, 100_000, 200_000, 5_000_000, 5_000_001, 10**9, 10**12]], ids=["dense", "far apart"])
def test_concat_cuts_by_bytes_and_not_by_numbers(df, rows, numbers):
    turns = df([("c", n, f"t{i}") for i, n in enumerate(numbers)] + [("d", 1, "ü"), ("d", 2, None), ("e", 3, "x" * 40)], "c string, seq long, t string")
    whole = "'".join(f"t{i}" for i in range(7))
    assert rows(aggs.concat_in_order(turns, ["c"], "seq", "t", "'")) == [("c", 0, 7, whole), ("d", 0, 2, "ü"), ("e", 0, 1, "x" * 40)]
    got = sorted(rows(aggs.concat_in_order(turns, ["c"], "seq", "t", "'", 9)))
    assert got == [("c", 0, 3, "t0't1't2"), ("c", 9, 3, "t3't4't5"), ("c", 18, 1, "t6"), ("d", 0, 2, "ü"), ("e", 0, 1, "x" * 40)]


def test_many_long_texts_of_one_group(spark):
    """Rows stay small however many texts a group has, and their positions give the whole back."""
    texts = spark.range(20_000).select(F.lit("hot").alias("g"), (F.col("id") * 1_000_003).alias("seq"), F.repeat(F.lit("word "), 40).alias("t"))
    got = aggs.concat_in_order(texts, ["g"], "seq", "t", "", 100_000)
    sizes = got.select("position", F.octet_length("text").alias("n")).orderBy("position").collect()
    assert len(sizes) == 40 and all(r["n"] <= 100_200 for r in sizes)
    assert sum(r["n"] for r in sizes) == 20_000 * 200
    assert all(b["position"] == a["position"] + a["n"] for a, b in zip(sizes, sizes[1:], strict=False))


def test_bucket_index(df, rows):
    data = [(1, TS(2024, 1, 1, 16, 49)), (2, TS(2024, 1, 1, 19, 17)), (3, TS(2024, 1, 1, 16, 45))]
    out = windows.bucket_index(df(data, "id int, ts timestamp_ntz").withColumn("g", F.lit("g")), ["g"], "ts")
    assert rows(out, "id", "bucket_index", "bucket_reverse_index") == [(1, 0, 1), (2, 1, 0), (3, 0, 1)]


def test_rollback_uses_one_step(df, rows):
    data = [("k", 1, "a", False), ("k", 2, "b", True), ("k", 3, "c", True), ("l", 1, "z", True)]
    versions = df(data, "k string, n int, v string, bad boolean")
    out = windows.previous_version(versions, ["k"], ["n"], "v", F.col("bad"))
    assert rows(out, "k", "n", "effective_value") == [("k", 1, "a"), ("k", 2, "a"), ("k", 3, "b"), ("l", 1, None)]


def test_continuations_before_the_first_start(df, rows):
    data = [("f", 1, " lost", False), ("f", 2, "key a", True), ("f", 3, "  b", False), ("f", 4, "key c", True)]
    out = windows.merge_continuations(df(data, "f string, n int, t string, s boolean"), ["f"], "n", "t", F.col("s"))
    assert rows(out, "start_line", "n_lines", "text") == [(2, 2, "key a b"), (4, 1, "key c"), (None, 1, "lost")]


def test_quality(df, rows):
    table = df([(1, "a"), (1, None), (2, "b")], "id int, v string")
    assert rows(quality.null_counts(table, ["id", "v"])) == [("id", 0, 3), ("v", 1, 3)]
    assert rows(quality.duplicate_keys(table, ["id"])) == [(1, 2)]
    payloads = df([('{"a": 1}',), ('{"a": "x"}',), ("{",), ('{"b": 1}',), (None,)], "p string")
    checked = quality.validate_records(payloads, "p", "a int", ["a"])
    assert [r["valid"] for r in checked.collect()] == [True, False, False, False, False]
    pins = df([("flask==3.0 # web",), ("# none",), ("",), ("requests",)], "line string")
    assert rows(quality.pin_inventory(pins, "line"), "package", "version") == [("flask", "3.0"), ("requests", None)]


def test_fallback_only_when_empty(df, rows):
    spare, full = df([("none", 0)], "k string, n int"), df([("x", 1), ("y", 2)], "k string, n int")
    assert rows(with_empty_fallback(full, spare)) == [("x", 1), ("y", 2)]
    assert rows(with_empty_fallback(full.filter("n > 5"), spare)) == [("none", 0)]


def test_top_findings_score(spark):
    row = spark.range(1).select(windows.impact_score(F.lit(3), F.lit(True), F.lit(80)).alias("s")).first()
    assert row["s"] == 3 * 100 + 50 + 49


def test_weighted_score_and_points(df):
    specs = df([("s", 100, 0.3), ("s", 90, 0.3), ("s", 90, 0.4)], "scan string, score int, weight double")
    row = aggs.weighted_score(specs, ["scan"], F.col("score"), F.col("weight")).first()
    assert row["weighted_score"] == pytest.approx(93)


def test_shrink_ratio(df):
    sizes = df([("i", 22542794, 155854616)], "image string, size bigint, source bigint")
    row = aggs.size_totals(sizes, ["image"], "size", F.col("source")).first()
    assert row["shrink_ratio"] == pytest.approx(6.913722229817653)


def test_severity_total(df, rows):
    data = df([("critical",)] * 11 + [("high",)] * 27 + [("medium",)] * 44, "severity string")
    assert rows(aggs.severity_counts(data, "severity")) == [
        ("critical", 11, 0), ("high", 27, 0), ("medium", 44, 0), (None, 82, 1)]


def test_elapsed_figures(df):
    footers = df([(f"Done 2025-01-01 00:00:00 [{s}s] -->> h:443 <<--",) for s in ("0185", "0135", "0116")] + [("none",)], "f string")
    row = aggs.elapsed_stats(footers.withColumn("g", F.lit(1)), ["g"], "f").first()
    assert (row["n_scans"], row["min_seconds"], row["max_seconds"]) == (3, 116, 185)
    assert row["avg_seconds"] == pytest.approx(436 / 3)


def test_latest_signature_per_digest(df, rows):
    data = df([("d", 1733000000, "old"), ("d", 1733896498, "new"), ("e", 1, "only")], "digest string, t bigint, body string")
    assert rows(windows.latest_record(data, ["digest"], ["t"])) == [("d", 1733896498, "new"), ("e", 1, "only")]


def test_rankings_and_briefing(df, rows):
    data = df([("s", i) for i in range(20)] + [("t", 1)], "scan string, v int")
    top = windows.briefing(data, ["scan"], [F.desc("v")])
    assert rows(top.filter("scan = 's'"), "rank", "v", "part") == sorted(
        ((r, 20 - r, "headline" if r <= 3 else "extra") for r in range(1, 9)), key=repr)
    assert top.filter("scan = 't'").count() == 1


def test_layer_joins(df, rows):
    history = df([("i", 0, "COPY"), ("i", 1, "RUN")], "image string, pos int, created_by string")
    ids = df([("i", 0, "a"), ("i", 1, "b")], "image string, pos int, diff_id string")
    layers = df([("i", 0, "x"), ("i", 1, "x")], "image string, pos int, digest string")
    sources = df([("i", "x", 5)], "image string, digest string, size int")
    assert rows(joins.layer_table(history, ids, layers, sources, "image"), "pos", "created_by", "size") == [
        (0, "COPY", 5), (1, "RUN", 5)]


def test_an_oversized_entry_is_cut_by_bytes(df, rows):
    lines = df([("f", 5, i, f"l{i % 10} ") for i in [5, 6, 100_007, 100_008, 900_009]], "f string, start_line int, n int, t string")
    got = windows.glue_lines(lines, ["f", "start_line"], "n", "t", 6)
    assert rows(got, "position", "n_lines", "text") == [(0, 2, "l5 l6"), (12, 1, "l9"), (6, 2, "l7 l8")]
    assert rows(windows.glue_lines(lines, ["f", "start_line"], "n", "t"), "position", "text") == [(0, "l5 l6 l7 l8 l9")]


def test_files_copied_into_an_image_and_removed(df, rows):
    """One image from its commands alone: the file copied and removed can still be taken out of its layer."""
    history = ["apko", "COPY secret.txt /not-a-secret.txt # buildkit", "RUN /bin/sh -c rm -rf /not-a-secret.txt # buildkit", None, "COPY a.txt /a.txt"]
    layers = df([("i", n, c) for n, c in enumerate(history)] + [("j", 0, "RUN rm /a.txt"), ("j", 1, "COPY a.txt /")], "image string, pos int, created_by string")
    assert rows(joins.recoverable_files(layers, ["image"], "pos")) == [("i", "/not-a-secret.txt", 1, 2)]
    assert rows(joins.layer_file_actions(layers, ["image", "pos"]), "image", "pos", "action", "file", "source")[1] == ("i", 2, "removed", "/not-a-secret.txt", None)


def test_secret_files_copied(df, rows):
    text = ["COPY secret.txt /not-a-secret.txt # buildkit", "copy --from=b a.txt b.txt /x/", 'ADD ["deploy key.pem", "/k"]', "COPY id_rsa.pub .env /root/", "# COPY secret.txt /", "RUN cp secret.txt /y"]
    got = filters.secret_lines(df([(t,) for t in text], "line string"), "line")
    assert rows(got.withColumn("f", F.array_join("secret_files", ",")), "f") == [(".env",), ("deploy key.pem",), ("secret.txt",)]


PATTERNS = [r"(^|\.)ads[-.]", r"^m\.", "farm", "ab|cd", r"ad[0-9]+server", r"foo?bar", r"x\.y\.z$", "[abc]x$", "(?i)TRACK", r"(t[0-9]\.)?evil\.org", "a{2,3}b", None]


def test_a_table_of_patterns_equals_each_by_itself(df, rows):
    rng = random.Random(4)
    parts = ["ads-", "ads.", "m.", "farm", "ab", "cd", "ad7server", "fobar", "foobar", "x.y.z", "cx", "track", "TRACK", "evil.org", "evilxorg", "aab", "aaab", "www."]
    hosts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(300)] + [None, "", "m", "ax"]
    names = df([(i, h) for i, h in enumerate(hosts)], "id int, host string")
    java = {h: [p for p in PATTERNS if p and re.search(p, h)] for h in hosts if h is not None}
    want = [(i, h) for i, h in enumerate(hosts) if h is not None and java[h]]
    got = filters.domain_pattern_block(names, "host", df([(p,) for p in PATTERNS * 2], "pattern string"))
    assert rows(got) == sorted(want, key=repr)
    assert rows(filters.domain_pattern_block(names, "host", df([], "pattern string"))) == []
    for p in filter(None, PATTERNS):
        alone = filters.domain_pattern_block(names, "host", df([(p,)], "pattern string"))
        assert rows(alone) == sorted([(i, h) for i, h in enumerate(hosts) if h is not None and p in java[h]], key=repr)


def test_ten_thousand_patterns_meet_hosts_by_a_piece(spark):
    hosts = spark.range(20_000).select(F.concat(F.lit("h"), F.col("id").cast("string"), F.lit(".example.com")).alias("host"))
    known = spark.range(10_000).select(F.concat(F.lit(r"(^|\.)h"), (F.col("id") * 3).cast("string"), F.lit(r"\.example\.com$")).alias("pattern"))
    out = filters.domain_pattern_block(hosts, "host", known)
    text = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text
    assert out.count() == 6_667


def test_repeated_keys_keep_their_last_value(spark):
    n = 20_000
    text = ",".join(f"k{i % 5_000}={i}" for i in range(n)) + ",=x,,k0,é=ü"
    made = spark.createDataFrame([(text,)], "s string").select(kv_string_to_map("s").alias("m")).first()["m"]
    want = {f"k{i % 5_000}": str(i) for i in range(n)} | {"": "x", "k0": None, "é": "ü"}
    assert made == want


def test_joins_run_nothing_while_they_are_planned(spark):
    tracker, group = spark.sparkContext.statusTracker(), "planning"
    spark.sparkContext.setJobGroup(group, group)
    rules = spark.range(20).select(F.col("id").alias("rule"), F.lit("n").alias("name"))
    found = spark.range(50).select((F.col("id") % 20).alias("rule"))
    kev = spark.range(9).select(F.col("id").cast("string").alias("cve_id"))
    frames = [joins.with_rule(found, rules, "rule"), joins.kev_inner(found.select(F.col("rule").cast("string").alias("cve_id")), kev), with_empty_fallback(found, found)]
    assert list(tracker.getJobIdsForGroup(group)) == []
    assert [f.count() for f in frames] == [50, 27, 50]
    spark.sparkContext.setJobGroup("rest", "rest")


def test_sbom_relations_stay_in_their_document(df):
    """Ids repeat over documents: an edge in each of three gives three rows."""
    packages = df([(d, i, f"{d}{i}") for d in "abc" for i in (1, 2)], "doc string, spdx_id int, name string")
    edges = df([(d, 1, 2, "CONTAINS") for d in "abc"], "doc string, spdx_element_id int, related_spdx_element int, relationship_type string")
    got = joins.sbom_edges(packages, edges, ["doc"]).collect()
    assert sorted((r["doc"], r["source_name"], r["target_name"]) for r in got) == [(d, f"{d}1", f"{d}2") for d in "abc"]
    more = edges.union(df([("a", 2, 3, "CONTAINS")], edges.schema))
    roots = df([(d, 1) for d in "abc"], "doc string, spdx_id int")
    reached = joins.sbom_reachable(more, roots, document=["doc"])
    assert sorted((r["doc"], r["spdx_id"], r["depth"]) for r in reached.collect()) == [
        ("a", 1, 0), ("a", 2, 1), ("a", 3, 2), ("b", 1, 0), ("b", 2, 1), ("c", 1, 0), ("c", 2, 1),
    ]
    near = joins.sbom_reachable(more, roots, 1, ["doc"])
    assert [tuple(r) for r in joins.sbom_beyond(more, near, ["doc"]).collect()] == [("a", 3)]


def test_rules_that_repeat_do_not_multiply_findings(df):
    rules = df([("f1", "R", "n"), ("f2", "R", "m"), ("f3", "R", "m")], "path string, rule_id string, name string")
    findings = df([("f2", "R")], "path string, rule_id string")
    assert joins.with_rule(findings.drop("path"), rules.drop("path"), "rule_id").count() == 1
    assert [r["name"] for r in joins.with_rule(findings, rules, ["path", "rule_id"]).collect()] == ["m"]


def test_many_locations_outrank_fifty(df):
    from telltale.plans.findings import rank_findings

    rows = [("s", "A", 3, "", f"u{i}") for i in range(50)] + [("s", "B", 3, "", f"u{i}") for i in range(200)]
    ranked = rank_findings(df(rows, "scan string, rule_id string, severity int, message string, uri string"), df([], "cve_id string"), 1)
    assert [(r["rule_id"], r["locations"]) for r in ranked.collect()] == [("B", 200)]
