"""Readers on files, parsers on small documents."""

import base64
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from telltale import session
from telltale.operators import joins, ordered, sets
from telltale.sources import documents as D
from telltale.sources import lines as L
from telltale.sources import accounting, pointer, published, sinks


@pytest.fixture
def lines(spark):
    def build(text, path="f"):
        numbered = [(path, i, line) for i, line in enumerate(text.split("\n"), start=1)]
        return spark.createDataFrame(numbered, L.LINES)

    return build


@pytest.fixture
def doc(spark):
    return lambda value: spark.createDataFrame([("p", json.dumps(value))], L.DOCUMENTS)


def test_lines_are_numbered_across_splits(spark, tmp_path, rows):
    texts = {"big.txt": [f"line {i}" for i in range(5000)], "crlf.txt": ["a\r", "", "b"], "empty.txt": []}
    for name, body in texts.items():
        (tmp_path / name).write_text("\n".join(body) + ("\n" if body else ""), newline="")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = L.read_lines(spark, str(tmp_path)).withColumn("path", F.regexp_extract("path", "([^/]+)$", 1))
        got = sorted((r["path"], r["line_no"], r["line"]) for r in got.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = [(n, i, line.rstrip("\r")) for n, body in texts.items() for i, line in enumerate(body, start=1)]
    assert got == sorted(want)


def test_trace(lines, rows):
    text = (
        'execve("/bin/x", ["x"], 0xff /* 22 vars */) = 0\n'
        "brk(NULL)                               = 0xb3a4\n"
        'openat(AT_FDCWD, "/etc/a) = b", R_OK) = -1 ENOENT (No such file or directory)\n'
        "connect(5, {sa_family=AF_INET}, 16)     = -1 EINPROGRESS (Operation now in progress)\n"
        "exit_group(0)                           = ?\n"
        "+++ exited with 0 +++"
    )
    assert rows(L.parse_trace(lines(text)), "line_no", "syscall", "ret", "errno") == [
        (1, "execve", "0", None),
        (2, "brk", "0xb3a4", None),
        (3, "openat", "-1", "ENOENT"),
        (4, "connect", "-1", "EINPROGRESS"),
        (5, "exit_group", "?", None),
    ]


REPORT = """## reg.example.com/app:latest ∴ /usr/bin/one [🛑 HIGH]

| RISK | KEY | DESCRIPTION | EVIDENCE |
|--|--|--|--|
| HIGH | [anti/entropy](https://rules.example.com/e#x) | high entropy (>7.4) | |
| LOW | [net/dns](https://rules.example.com/d) | looks \\| up names | [a](https://e.com/a)<br>[b c](https://e.com/b) |

## reg.example.com/app:latest ∴ /usr/bin/two [🛑 HIGH]

## reg.example.com/app:latest ∴ /usr/bin/three [⚠ MEDIUM]

| RISK | KEY | DESCRIPTION | EVIDENCE |
|--|--|--|--|
| HIGH | [x](https://rules.example.com/x) | d1 | |

| RISK | KEY | DESCRIPTION | EVIDENCE |
|--|--|--|--|
| HIGH | [y](https://rules.example.com/y) | d2 | |
"""


def test_capability_markdown(lines, rows):
    got = rows(L.parse_capability_md(lines(REPORT)), "line_no", "file", "file_level", "risk", "key", "description", "evidence")
    assert got == [
        (14, "/usr/bin/three", "MEDIUM", "HIGH", "x", "d1", []),
        (18, "/usr/bin/three", "MEDIUM", "HIGH", "y", "d2", []),
        (5, "/usr/bin/one", "HIGH", "HIGH", "anti/entropy", "high entropy (>7.4)", []),
        (6, "/usr/bin/one", "HIGH", "LOW", "net/dns", "looks \\| up names", ["a", "b c"]),
    ]


def test_ambiguous_headings(lines, rows):
    assert rows(L.capability_headings(lines(REPORT)), "file", "n_tables", "ambiguous") == [
        ("/usr/bin/one", 1, False),
        ("/usr/bin/three", 2, True),
        ("/usr/bin/two", 0, True),
    ]


TLS = """ Testing protocols via sockets except NPN+ALPN

 SSLv2      not offered (OK)
 TLS 1.3    offered (OK): final
 ALPN/HTTP2 h2, http/1.1 (offered)

 Testing server's cipher preferences

Hexcode  Cipher Suite Name (OpenSSL)       KeyExch.   Encryption  Bits     Cipher Suite Name (IANA/RFC)
---------------------------------------------------------------
SSLv3
 -
TLSv1.2 (server order)
 xc02f   SUITE-ONE       EXCH 111   AESGCM      128      TLS_SUITE_ONE
 x2f     SUITE-TWO                        RSA        AES         128      TLS_SUITE_TWO

 Testing robust forward secrecy (FS)

 FS is offered (OK)           SUITE_A SUITE_B
                              SUITE_C

 Running client simulations (HTTP) via sockets

 Browser                      Protocol  Cipher Suite Name (OpenSSL)       Forward Secrecy
---------------------------------------------------------------
 Hand 1 (own)          TLSv1.3   TLS_SUITE_THREE            111 bit EXCH (CURVE)
 Old Browser 8                No connection
"""


def test_tls_report(lines, rows):
    settings = rows(L.parse_tls_settings(lines(TLS)), "section", "key", "value")
    assert ("Testing protocols via sockets except NPN+ALPN", "SSLv2", "not offered (OK)") in settings
    assert ("Testing protocols via sockets except NPN+ALPN", "TLS 1.3", "offered (OK): final") in settings
    assert ("Testing protocols via sockets except NPN+ALPN", "ALPN/HTTP2", "h2, http/1.1 (offered)") in settings
    assert ("Testing robust forward secrecy (FS)", "FS is offered (OK)", "SUITE_A SUITE_B SUITE_C") in settings
    assert len(settings) == 4
    assert rows(L.parse_tls_suites(lines(TLS)), "protocol", "hexcode", "key_exchange", "bits") == [
        ("TLSv1.2", "x2f", "RSA", 128),
        ("TLSv1.2", "xc02f", "EXCH 111", 128),
    ]
    assert rows(L.parse_tls_clients(lines(TLS)), "client", "protocol", "suite", "forward_secrecy") == [
        ("Hand 1 (own)", "TLSv1.3", "TLS_SUITE_THREE", "111 bit EXCH (CURVE)"),
        ("Old Browser 8", None, None, None),
    ]


def test_diff(lines, rows):
    text = "--- a/x.yml\n+++ b/x.yml\n@@ -1 +1 @@\n-  uses: a/b@v1\n+  uses: a/b@v2\n same\n--- a/y\n+++ b/y\n+new"
    assert rows(L.parse_diff(lines(text)), "file", "line_no", "sign", "text") == [
        ("x.yml", 4, "-", "  uses: a/b@v1"),
        ("x.yml", 5, "+", "  uses: a/b@v2"),
        ("y", 9, "+", "new"),
    ]


def test_diff_headers_only_outside_hunks(lines, rows):
    text = (
        "--- a/x.sql\n+++ b/x.sql\n@@ -1,3 +1,3 @@\n--- drop old\n+++ odd\n same\n-c\n+d\n"
        "diff --git a/y b/y\n--- a/y\n+++ /dev/null\n@@ -1,2 +0,0 @@\n-one\n--- two\n-- \n2.1"
    )
    assert rows(L.parse_diff(lines(text)), "line_no", "file", "sign", "text") == [
        (13, "y", "-", "one"),
        (14, "y", "-", "-- two"),
        (4, "x.sql", "-", "-- drop old"),
        (5, "x.sql", "+", "++ odd"),
        (7, "x.sql", "-", "c"),
        (8, "x.sql", "+", "d"),
    ]
    assert rows(L.diff_rejects(lines(text)), "line_no") == [(15,), (16,), (9,)]


def test_diff_hunks_over_blocks(spark, rows):
    """A hunk of more lines than a block has, all of which look like headers."""
    n = 150_000
    sized = spark.range(1, n + 1).selectExpr("'p' AS path", "id + 3 AS line_no", "if(id % 2 = 0, '--- x', '+++ y') AS line")
    head = spark.createDataFrame([("p", 1, "--- a/f"), ("p", 2, "+++ b/f"), ("p", 3, f"@@ -1,{n // 2} +1,{n // 2} @@")], sized.schema)
    tail = spark.createDataFrame([("p", n + 4, "--- a/g"), ("p", n + 5, "+++ b/g"), ("p", n + 6, "@@ -1 +1 @@"), ("p", n + 7, "+++ z")], sized.schema)
    out = L.parse_diff(head.unionByName(sized).unionByName(tail))
    assert rows(out.groupBy("file", "sign", "text").count()) == [("f", "+", "++ y", n // 2), ("f", "-", "-- x", n // 2), ("g", "+", "++ z", 1)]


def test_diff_without_a_path(spark, rows):
    """Lines in two blocks under a NULL path still find the header and the counts of the first."""
    text = [(None, 1, "+++ b/f"), (None, 2, "@@ -0,0 +1,2 @@"), (None, 3, "+++ x"), (None, 70_000, "+++ y"), ("", 70_000, "+z")]
    out = L.parse_diff(spark.createDataFrame(text, "path string, line_no bigint, line string"))
    assert rows(out, "path", "file", "text") == [("", None, "z"), (None, "f", "++ x"), (None, "f", "++ y")]


def test_trace_with_clocks_and_rejects(lines, rows):
    text = (
        "[pid 7] 10:11:12.345 brk(NULL) = 0\n12  1700000000.25 close(3) = -1 EBADF (Bad file descriptor)\n10:11:12 dup(1) = 2\n"
        "[pid 8] read(3, <unfinished ...>\n[pid 8] <... read resumed>\"x\", 1) = 1\n+++ exited with 0 +++\nnoise"
    )
    assert rows(L.parse_trace(lines(text)), "syscall", "ret", "errno") == [("brk", "0", None), ("close", "-1", "EBADF"), ("dup", "2", None)]
    assert rows(L.trace_rejects(lines(text)), "line_no", "reason") == [
        (4, "unfinished"), (5, "resumed"), (6, "trailer or signal"), (7, "no call")]


def test_lists_and_tags(lines, rows):
    hosts = rows(L.parse_domain_list(lines("Ads.example.com \n\nexample.net/ads\na-b.example.org")), "domain", "is_host")
    assert hosts == [("a-b.example.org", True), ("ads.example.com", True), ("example.net/ads", False)]
    tags = rows(L.parse_tagged_lines(lines("FN;CHARSET=UTF-8:A B\nurl:https://x.y/z\nplain")), "key", "params", "value")
    assert tags == [("FN", {"CHARSET": "UTF-8"}, "A B"), ("url", {}, "https://x.y/z")]
    assert rows(L.parse_tagged_lines(lines("a.b=c=d"), "="), "key", "value") == [("a.b", "c=d")]
    refs = rows(L.parse_image_refs(lines("# c\n alpine:3 \n'reg.io/a:b' # d\n")), "ref")
    assert refs == [("alpine:3",), ("reg.io/a:b",)]


def test_posts(spark, rows):
    body = '---\nlayout: post\ntitle: "A: b"\nexcerpt: about a\n---\ntext\n---\nmore'
    df = spark.createDataFrame([("/p/2024-01-02-a.md", body), ("/p/b.md", "no front matter")], L.DOCUMENTS)
    assert rows(L.parse_posts(df)) == [
        ("2024-01-02-a.md", "A: b", "about a", "text\n---\nmore", True),
        ("b.md", None, None, "no front matter", False),
    ]


def test_missing_paths_read_as_documented(spark, tmp_path):
    assert D.read_kev(spark, str(tmp_path / "none.json")).count() == 0
    assert L.read_log_sample(spark, str(tmp_path / "none")).first()["line"] == "(no logs provided)"
    (tmp_path / "bad.json").write_text("<html>")
    assert D.read_kev(spark, str(tmp_path / "bad.json")).count() == 0


def test_log_sample_takes_the_first_files(spark, tmp_path):
    for i in range(25):
        (tmp_path / f"{i:02d}.log").write_text(f"one {i}\ntwo {i}\n")
    got = L.read_log_sample(spark, str(tmp_path), 20)
    assert got.count() == 40
    assert got.select("path").distinct().count() == 20
    assert got.filter("line = 'one 20'").count() == 0


def test_kev_file(spark, tmp_path, rows):
    entry = {"cveID": "CVE-2024-0001", "vendorProject": "v", "product": "p", "shortDescription": "d", "other": 1}
    (tmp_path / "kev.json").write_text(json.dumps({"title": "t", "vulnerabilities": [entry]}, indent=1))
    assert rows(D.read_kev(spark, str(tmp_path))) == [("CVE-2024-0001", "v", "p", "d")]


def test_findings_without_location_stay(doc, rows):
    sarif = {"runs": [{"tool": {"driver": {"name": "s", "rules": [{"id": "R1", "name": "n"}]}}, "results": [
        {"ruleId": "R1", "message": {"text": "m"}},
        {"ruleId": "R1", "level": "error", "message": {"text": "n"}, "locations": [
            {"physicalLocation": {"artifactLocation": {"uri": "a.c"}, "region": {"startLine": 3}}}]},
    ]}]}
    assert rows(D.parse_findings(doc(sarif), []), "rule_id", "level", "uri", "start_line") == [
        ("R1", "error", "a.c", 3), ("R1", "warning", None, None)]


def test_capability_report(doc, rows):
    low, medium = {"ID": "a", "RiskScore": 1, "RiskLevel": "LOW"}, {"ID": "b", "RiskScore": 2, "RiskLevel": "MEDIUM"}
    report = {"Files": {"/bin/x": {"SHA256": "00", "Size": 9, "Syscalls": ["read"], "Behaviors": [low, medium],
                                   "RiskScore": 2}, "/bin/y": {"Size": 1}}}
    got = D.parse_capability(doc(report), [])
    assert rows(got, "file", "rule_id", "risk_score") == [("/bin/x", "a", 1), ("/bin/x", "b", 2), ("/bin/y", None, None)]


def test_allowlist_round_trip(spark, doc, rows):
    names = ["brk", "execve", "mmap"]
    profile = {"defaultAction": "SCMP_ACT_ERRNO", "defaultErrnoRet": 1,
               "archMap": [{"architecture": "X", "subArchitectures": ["Y", "Z"]}, {"architecture": "W"}],
               "syscalls": [{"names": names, "action": "SCMP_ACT_ALLOW"}]}
    rules = D.parse_seccomp_rules(doc(profile), [])
    used = spark.createDataFrame([(n,) for n in names * 3], "name string")
    assert joins.allowlist_gaps(used, rules, "name").count() == 0
    assert [r["name"] for r in sets.derive_allowlist(used, "name").collect()] == names
    assert rows(D.parse_seccomp_archs(doc(profile), [])) == [("W", None), ("X", "Y"), ("X", "Z")]


def test_layers_skip_history_without_content(doc, rows):
    config = {"history": [{"created": "2024-05-06T07:08:09.123456789Z", "created_by": "COPY a"},
                          {"created_by": "ENV x", "empty_layer": True}, {"created_by": "RUN rm a"}],
              "rootfs": {"diff_ids": ["sha256:1", "sha256:2"]}}
    assert rows(D.parse_image_layers(doc(config), []), "pos", "created_by", "diff_id") == [
        (0, "COPY a", "sha256:1"), (1, "RUN rm a", "sha256:2")]
    manifest = [{"Layers": ["blobs/sha256/aa", "blobs/sha256/bb"],
                 "LayerSources": {"sha256:aa": {"mediaType": "t", "size": 5, "digest": "sha256:aa"}}}]
    assert rows(D.parse_manifest(doc(manifest), []), "pos", "digest", "size") == [(0, "sha256:aa", 5), (1, "sha256:bb", None)]


def test_signing_records(doc, rows):
    statement = base64.b64encode(json.dumps({"predicateType": "spdx"}).encode()).decode()
    envelope = {"payloadType": "t", "payload": statement, "signatures": [{"keyid": "", "sig": "x"}]}
    got = D.parse_dsse(doc(envelope), [], "predicateType string").first()
    assert got["statement"]["predicateType"] == "spdx" and got["n_signatures"] == 1
    digest = hashlib.sha256(base64.b64decode(statement)).hexdigest()
    assert len(digest) == 64
    entry = lambda t: {"critical": {"image": {"docker-manifest-digest": "sha256:f"}},
                       "optional": {"Bundle": {"Payload": {"integratedTime": t, "logIndex": 1}}}}
    signatures = D.parse_signatures(doc([entry(1700000000), entry(1733896498)]), [])
    assert rows(signatures, "digest", "integrated_time") == [("sha256:f", 1700000000), ("sha256:f", 1733896498)]
    tlog = {"verificationMaterial": {"tlogEntries": [{"logIndex": "15", "integratedTime": "1733896498"}]}}
    assert rows(D.parse_tlog(doc(tlog), []), "log_index", "integrated_time") == [(15, 1733896498)]


def test_replace_section(spark):
    df = spark.createDataFrame([("a\n<!-- s -->\nold\n<!-- e -->\nb",)], "t string")
    out = df.select(sinks.replace_section(F.col("t"), "<!-- s -->", "<!-- e -->", "new \\1 $2\n").alias("t"))
    assert out.first()["t"] == "a\n<!-- s -->\nnew \\1 $2\n<!-- e -->\nb"
    with pytest.raises(Exception, match="no section"):
        df.select(sinks.replace_section(F.col("t"), "<!-- x -->", "<!-- e -->", "n")).collect()


def test_write_if_changed(spark, tmp_path, rows):
    path, df = str(tmp_path / "t"), spark.range(10).withColumn("v", F.col("id") % 3)
    other = df.withColumn("v", F.lit(1).cast("bigint"))
    assert sinks.write_if_changed(df, spark, path, df.columns) is True
    assert sinks.write_if_changed(df.orderBy(F.desc("id")), spark, path, df.columns) is False
    assert len([f for f in (tmp_path / "t").iterdir() if f.is_dir()]) == 1
    assert sinks.write_if_changed(other, spark, path, df.columns) is True
    assert rows(published.read_published(spark, path)) == rows(other)


def test_a_reader_never_sees_half_a_table(spark, tmp_path, rows):
    """Neither during a write nor after a writer that died in it; a reader that has begun keeps its version."""
    path, old = str(tmp_path / "t"), spark.range(10)
    published.publish(old, path)
    begun = published.read_published(spark, path)
    version = published.write_beside(spark.range(5), path)  # written, not switched to yet
    assert rows(published.read_published(spark, path)) == rows(old)
    dies = spark.range(1000).select(F.when(F.col("id") == 999, F.raise_error(F.lit("killed"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="killed"):
        sinks.write_if_changed(dies, spark, path, ["id"])
    assert rows(published.read_published(spark, path)) == rows(old)
    published.switch_to(spark, path, version)
    assert rows(published.read_published(spark, path)) == rows(spark.range(5)) and rows(begun) == rows(old)
    assert published.drop_versions(spark, path) == []  # all younger than a day
    assert len(published.drop_versions(spark, path, 0)) == 2
    assert rows(published.read_published(spark, path)) == rows(spark.range(5))


def test_written_copies_are_listed_in_one_folder(spark):
    """What an application lays down is below one folder of its own, which a job removes at its end."""
    path = session.fresh_path(spark, "cut")
    spark.range(3).write.parquet(path)
    name = f"telltale-{spark.sparkContext.applicationId}"
    assert name in pointer.folders(spark, session.shared_dir(spark)) and f"/{name}/" in path
    pointer.remove_folder(spark, path)
    assert path.rsplit("/", 1)[1] not in pointer.folders(spark, path.rsplit("/", 1)[0])


def test_the_pointer_is_replaced_in_one_step(spark, tmp_path):
    path = str(tmp_path / "p" / "_current")
    assert pointer.read_text(spark, path) is None
    for text in ("eins", "zwei — ü", ""):
        pointer.replace_text(spark, path, text)
        assert pointer.read_text(spark, path) == text
    assert [f.name for f in (tmp_path / "p").iterdir() if not f.name.endswith(".crc")] == ["_current"]
    with pytest.raises(FileNotFoundError):
        published.read_published(spark, str(tmp_path / "nothing"))


def test_report_file_order(spark, tmp_path):
    body = spark.createDataFrame([(2, "second"), (10, "third"), (1, "first")], "k int, text string")
    report = sinks.report_lines(["# T"], [("S", body)], ["k"], "text")
    sinks.write_report(report, str(tmp_path / "r"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "r").glob("part-*")))
    assert text.split("\n") == ["# T", "", "---", "", "## S", "", "first", "second", "third", ""]


def test_a_separator_inside_a_line_does_not_shift_groups(lines, rows):
    text = 'write(1, "a\u0001b", 3) = 3\nread(0, "x") = -1 EAGAIN (Resource temporarily unavailable)'
    assert rows(L.parse_trace(lines(text)), "syscall", "args", "ret", "errno") == [
        ("read", '0, "x"', "-1", "EAGAIN"), ("write", '1, "a\u0001b", 3', "3", None)]


def test_suites_with_one_blank_and_a_combined_exchange(lines, rows):
    text = """TLSv1.3 (no server order)
 x9901   TLS_SUITE_NINE                    EXCH/HYBRID AEADX     256      TLS_SUITE_NINE_LONG
 x9902   TLS_SUITE_TEN                     EXCH 111   AEADX       128      TLS_SUITE_TEN_LONG

 Testing other things

 Key                          value"""
    assert rows(L.parse_tls_suites(lines(text)), "protocol", "hexcode", "key_exchange", "encryption", "bits") == [
        ("TLSv1.3", "x9901", "EXCH/HYBRID", "AEADX", 256), ("TLSv1.3", "x9902", "EXCH 111", "AEADX", 128)]
    assert rows(L.parse_tls_settings(lines(text)), "key", "value") == [("Key", "value")]


def test_all_rows_of_a_long_setting_have_its_key(spark, monkeypatch):
    monkeypatch.setattr(ordered, "SEGMENT_BYTES", 50_000)
    n = 100_005
    text = F.when(F.col("id") == 1, F.lit(" Testing it")).when(F.col("id") == 2, F.lit(" Key one   first")).otherwise(F.lit(" " * 12 + "x"))
    long = spark.range(1, n).select(F.lit("f").alias("path"), F.col("id").alias("line_no"), text.alias("line"))
    got = sorted(L.parse_tls_settings(long).collect(), key=lambda r: r["position"])
    assert len(got) > 1 and {r["key"] for r in got} == {"Key one"}
    assert " ".join(r["value"] for r in got) == "first" + " x" * (n - 3)


def test_lines_of_no_section_are_no_settings(lines, rows):
    text = """ Start 2025-01-02 03:04:05        -->> 10.0.0.1:443 <<--
 rDNS 10.0.0.1:               host.example.

 Rating (experimental)

 Key Exchange     (weighted)  90 (27)
 Protocol Support (weighted)  100 (30)
 Cipher (x) y  z"""
    assert rows(L.parse_tls_settings(lines(text)), "section", "key", "value") == [
        ("Rating (experimental)", "Cipher (x) y", "z"),
        ("Rating (experimental)", "Key Exchange (weighted)", "90 (27)"),
        ("Rating (experimental)", "Protocol Support (weighted)", "100 (30)"),
    ]


SCRIPT = """#!/bin/bash
# pulls images
images=(
    "docker.io/library/ubuntu:24.04"
    'reg.example.com:5000/a/b_c:latest'  # second
)

for image in "${images[@]}"; do
    echo "Pulling $image..."
    docker pull "$image"
done
more=(alpine busybox:1 "x@sha256:%s")
podman pull docker.io/library/ubuntu:24.04
""" % ("0" * 64)


def test_references_in_a_shell_array(lines, rows):
    refs = ["docker.io/library/ubuntu:24.04", "reg.example.com:5000/a/b_c:latest", "alpine", "busybox:1", "x@sha256:" + "0" * 64]
    assert rows(L.parse_image_refs(lines(SCRIPT)), "ref") == sorted([(r,) for r in refs], key=repr)
    assert rows(L.parse_image_refs(lines("python\nnot a ref\nreg.io/x:1 # y\ndone\n$i\n")), "ref") == [("python",), ("reg.io/x:1",)]


@pytest.mark.parametrize(
    "kinds, text, want",
    [
        (accounting.image_ref_kinds, SCRIPT, {"lines": 14, "accepted": 14, "rejected": 0}),
        (accounting.image_ref_kinds, "python\nnot a ref\n", {"lines": 3, "accepted": 2, "rejected": 1}),
        (accounting.tls_kinds, " Start 2025  now\n" + TLS, {"lines": 29, "accepted": 24, "rejected": 5}),
        (accounting.trace_kinds, "read(3) = 0\n+++ exited with 0 +++\nx", {"lines": 3, "accepted": 1, "rejected": 2}),
        (accounting.domain_kinds, "a.example\n b.example \na.example/x\n", {"lines": 4, "accepted": 3, "rejected": 1}),
        (accounting.diff_kinds, "--- a/x\n+++ b/x\n@@ -1 +1 @@\n-a\n+b\nindex 1\n", {"lines": 7, "accepted": 5, "rejected": 2}),
        (accounting.capability_kinds, "| LOW | [a](b) | c | [d](e) |\n## i ∴ /f [x LOW]\n\n| LOW | [a](b) | c | [d](e) |\nz", {"lines": 5, "accepted": 3, "rejected": 2}),
    ],
)
def test_every_line_is_accounted_for(lines, spark, tmp_path, kinds, text, want):
    """One pass writes the lines by verdict and counts them, and what is written adds up to what came in."""
    path = str(tmp_path / "routed")
    assert accounting.route(kinds(lines(text)), path) == want
    back = spark.read.parquet(path)
    assert back.count() == want["lines"] == len(text.split("\n"))
    assert back.filter("NOT accepted").count() == want["rejected"]


def test_only_the_first_section_is_replaced(spark):
    df = spark.createDataFrame([("s\\E\r\nold\r\ne\r\nmid\r\ns\\E\r\nkeep\r\ne",)], "t string")
    out = df.select(sinks.replace_section(F.col("t"), "s\\E", "e", "new\r\n").alias("t")).first()["t"]
    assert out == "s\\E\r\nnew\r\ne\r\nmid\r\ns\\E\r\nkeep\r\ne"


def test_digests_tell_values_with_separators_apart(spark):
    a = spark.createDataFrame([("a\u0001b", "c")], "x string, y string")
    b = spark.createDataFrame([("a", "b\u0001c")], "x string, y string")
    c = spark.createDataFrame([("a", None)], "x string, y string")
    assert sinks.changed(a, b, ["x", "y"]) and sinks.changed(c, c.fillna("-"), ["x", "y"])


def test_report_order_of_doubles_and_nulls(spark, tmp_path):
    body = spark.createDataFrame([(10.5, "c"), (-1.0, "a"), (9.5, "b"), (None, "n")], "k double, text string")
    sinks.write_report(sinks.report_lines(["# T"], [("S", body)], ["k"], "text"), str(tmp_path / "r"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "r").glob("part-*")))
    assert text.split("\n")[-5:] == ["n", "a", "b", "c", ""]


def test_rules_are_found_by_their_place(doc, rows):
    rules = [{"id": "R0"}, {"id": "R1"}]
    results = [{"ruleIndex": 1}, {"rule": {"index": 0}}, {"rule": {"id": "R9"}}, {"ruleIndex": -1}, {"ruleId": "R5", "level": "error"}]
    value = {"runs": [{"tool": {"driver": {"name": "t", "rules": rules}}, "results": results}]}
    found = D.parse_findings(doc(value), [])
    assert [r[0] for r in found.orderBy("result_index").select("rule_id").collect()] == ["R1", "R0", "R9", None, "R5"]
    assert rows(found.select(D.level_severity(F.col("level")).alias("s"), "result_index")) == [(2, 0), (2, 1), (2, 2), (2, 3), (3, 4)]


def test_bill_of_materials_inside_a_statement(doc, rows):
    bill = {
        "packages": [{"SPDXID": "A", "name": "a"}, {"SPDXID": "B", "name": "b"}],
        "relationships": [{"spdxElementId": "A", "relatedSpdxElement": "B", "relationshipType": "CONTAINS"}],
    }
    for value in (bill, {"predicateType": "x", "predicate": bill}):
        assert rows(D.parse_sbom_packages(doc(value), []), "spdx_id", "name") == [("A", "a"), ("B", "b")]
        assert rows(D.parse_sbom_relationships(doc(value), []), "related_spdx_element") == [("B",)]
