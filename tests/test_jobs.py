"""End-to-end jobs on small rows."""

import json

import pytest
from pyspark.sql import functions as F

from telltale.plans import actions, benchmark, findings, webhooks
from telltale.sources.lines import LINES


@pytest.fixture
def df(spark):
    return lambda data, schema: spark.createDataFrame(data, schema)


def test_findings_report(df, rows):
    found = df(
        [("s", "r1", 3, "CVE-2024-0001 twice CVE-2024-0001", "a"), ("s", "r1", 2, "none", "b"), ("s", "r2", 3, "none", "a"),
         ("s", "r3", 1, "CVE‑2024‑0001", "a"), *(("s", f"x{i}", 1, "", "a") for i in range(6)), ("t", "r1", 1, "", "a")],
        "scan string, rule_id string, severity int, message string, uri string",
    )
    kev = df([("CVE-2024-0001",)], "cve_id string")
    logs = df([("r1", 1, "old"), ("r1", 2, "new"), ("x9", 1, "other")], "rule_id string, seq int, line string")
    out = findings.findings_report(found, kev, logs)
    got = rows(out.filter("scan = 's'").orderBy("rank"), "rank", "rule_id", "score", "in_kev", "n_logs", "last_log")
    assert got == [
        (1, "r1", 352, True, 2, "new"), (2, "r2", 301, False, 0, None), (3, "r3", 151, True, 0, None),
        (4, "x0", 101, False, 0, None), (5, "x1", 101, False, 0, None)]
    text = [r["text"] for r in findings.report_text(out, "2024-02-01", "scan").orderBy("ordinal", "part", "line_key").collect()]
    assert text[:3] == ["# Findings report", "_Generated: 2024-02-01_", "_Source: scan_"]
    assert text[8] == "1. s / r1: 352" and text.count("---") == 4


def test_webhooks(df):
    body = lambda login, name: json.dumps({"repository": {"owner": {"login": login}, "name": name}})
    sent = df([(i, body("u", f"r{i}"), f"2024-01-0{i} 00:00:00") for i in range(1, 8)] + [(8, "{}", "2024-02-01 00:00:00")],
              "id int, payload string, ts string").withColumn("ts", F.to_timestamp_ntz("ts"))
    got = webhooks.latest_webhooks(sent.unionByName(sent), "payload", "ts", "id").collect()
    assert [r["target_repo"] for r in got] == ["r7", "r6", "r5", "r4", "r3"]


def test_action_change(df, rows):
    text = "+++ b/w.yml\n-  uses: o/scan@v1\n+  uses: o/scan@v2 # new\n+  run: x\n+++ b/z.yml\n+ none"
    lines = df([("pr1", i, line) for i, line in enumerate(text.split("\n"), 1)], LINES)
    changes = actions.action_changes(lines)
    assert rows(changes, "old.ref", "new.ref") == [("v1", "v2")]
    caps = df([("scan", "v1", "f", "a", 3), ("scan", "v2", "f", "a", 4), ("scan", "v2", "f", "b", 2), ("scan", "v2", "g", "c", 3)],
              "repo string, ref string, file string, rule_id string, risk_score int")
    diff = actions.capability_changes(changes, caps)
    assert rows(diff, "file", "rule_id", "status") == [("f", "a", "changed"), ("g", "c", "added")]
    assert actions.change_comment(diff).count() == 2
    assert rows(actions.change_comment(diff.filter("false")), "text") == [("## Capability diff",), ("No differences found.",)]


def test_all_capabilities_of_two_containers(df, rows):
    change = "struct<repo:string,ref:string>"
    changes = df([("pr1", ("scan", "v1"), ("scan", "v2"))], f"path string, old {change}, new {change}")
    caps = df([("scan", "v1", "f", "a", 3), ("scan", "v2", "f", "a", 4), ("scan", "v2", "f", "b", 2)],
              "repo string, ref string, file string, rule_id string, risk_score int")
    types = df([("scan", "v1", "docker"), ("scan", "v2", "docker")], "repo string, ref string, using string")
    high, low = ("f", "a", "changed"), ("f", "b", "added")
    assert rows(actions.capability_changes(changes, caps, types=types), "file", "rule_id", "status") == [high, low]
    assert rows(actions.capability_changes(changes, caps, types=types.filter("ref = 'v1'")), "file", "rule_id", "status") == [high]
    assert rows(actions.capability_changes(changes, caps), "file", "rule_id", "status") == [high]


def test_model_benchmark(df):
    runs = df([("m", 73, 420_000_000, 679, 82_580_000_000), ("m", -1, 0, None, None), ("skip", 1, 1, 1, 1), ("z", 1, 0, 1, 0)],
              "model string, prompt_eval_count bigint, prompt_eval_duration bigint, eval_count bigint, eval_duration bigint")
    out = {r["model"]: r for r in benchmark.model_benchmark(runs, ["skip"]).collect()}
    assert set(out) == {"m", "z"}
    assert float(out["m"]["prompt_rate_text"]) == pytest.approx(174.56, rel=0.01)
    assert float(out["m"]["total_rate_text"]) == pytest.approx(9.06, rel=0.01)
    assert out["z"]["eval_rate"] is None
