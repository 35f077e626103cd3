"""Native formats: Spark derives the documents and lines from whole tables, the readers parse them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telltale import functions as T
from telltale.operators.joins import layer_table, sbom_edges, sbom_reachable
from telltale.operators.nested import lines_of
from telltale.plans.findings import rank_findings
from telltale.queries.filtering import diff_source, trace_source
from telltale.queries.registry import query
from telltale.session import fresh_path
from telltale.sources import accounting as A
from telltale.sources import documents as D
from telltale.sources import lines as L
from telltale.sources import sinks
from telltale.sources.tables import read_events

# Every line of every document with its place.
_LINES = """
    (SELECT doc_id, source, CAST(i - 1 AS INTEGER) AS pos, l FROM (SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents),
            LATERAL (SELECT unnest(ls) AS l, generate_subscripts(ls, 1) AS i))
"""


def _string(name: str):
    return F.col(name).cast("string")


def _text_lines(fn):
    return F.transform(lines_of(F.col("text")), fn)


# --- O-S1, O-S2 --------------------------------------------------------------


@query(
    """
    SELECT 'CVE-2024-' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS cve_id, p_brand AS vendor, p_name AS product, p_type AS description
    FROM part WHERE p_size <> 13
    """
)
def kev_catalog(t):
    """O-S1: a catalog document per part; those of size 13 are broken and read as empty."""
    entry = F.struct(
        F.concat(F.lit("CVE-2024-"), F.lpad(_string("p_partkey"), 6, "0")).alias("cveID"),
        F.col("p_brand").alias("vendorProject"),
        F.col("p_name").alias("product"),
        F.col("p_type").alias("shortDescription"),
        F.col("p_retailprice").alias("ignored"),
    )
    whole = F.to_json(F.struct(F.lit("catalog").alias("title"), F.array(entry).alias("vulnerabilities")))
    content = F.when(F.col("p_size") == 13, F.lit("<html>not found</html>")).otherwise(whole)
    return D.parse_kev(t.part.select(content.alias("content")))


def _sarif(t, message=lambda x, i: x) -> DataFrame:
    result = lambda x, i: F.struct(
        F.concat(F.lit("R"), (i % 5).cast("string")).alias("ruleId"),
        F.when(i % 2 == 0, F.lit("error")).alias("level"),
        F.struct(message(x, i).alias("text")).alias("message"),
        F.when(
            i % 3 > 0,
            F.array(
                F.struct(
                    F.struct(
                        F.struct(F.col("source").alias("uri")).alias("artifactLocation"),
                        F.struct((i + 1).alias("startLine")).alias("region"),
                    ).alias("physicalLocation")
                )
            ),
        ).alias("locations"),
    )
    rules = F.transform(
        F.sequence(F.lit(0), F.lit(4)),
        lambda i: F.struct(
            F.concat(F.lit("R"), i.cast("string")).alias("id"),
            F.concat(F.col("lang"), i.cast("string")).alias("name"),
            F.lit("https://rules.example.com/").alias("helpUri"),
        ),
    )
    driver = F.struct(F.lit("scanner").alias("name"), rules.alias("rules"))
    run = F.struct(F.struct(driver.alias("driver")).alias("tool"), _text_lines(result).alias("results"))
    return t.documents.select("doc_id", F.to_json(F.struct(F.array(run).alias("runs"))).alias("content"))


@query(
    f"""
    SELECT doc_id, CAST(0 AS INTEGER) AS run_index, pos AS result_index, 'R' || pos % 5 AS rule_id,
           CASE WHEN pos % 2 = 0 THEN 'error' ELSE 'warning' END AS level, l AS message,
           CASE WHEN pos % 3 > 0 THEN source END AS uri, CASE WHEN pos % 3 > 0 THEN pos + 1 END AS start_line
    FROM {_LINES}
    """,
    headline=True,
)
def sarif_findings(t):
    """O-S2: a scan file per document, a result per line."""
    return D.parse_findings(_sarif(t), ["doc_id"])


@query(
    """
    SELECT doc_id, CAST(0 AS INTEGER) AS run_index, 'R' || i AS rule_id, lang || i AS name, 'https://rules.example.com/' AS help_uri
    FROM documents, range(5) r(i)
    """
)
def sarif_rules(t):
    """O-S2, the rule metadata."""
    return D.parse_rules(_sarif(t), ["doc_id"])


# --- O-S4, O-S5 --------------------------------------------------------------


@query(
    f"""
    SELECT d.doc_id, '/srv/' || source || '/' || d.doc_id AS file, sha256(text) AS sha256, n_chars AS size, 'read,write' AS syscalls,
           CAST(2 AS INTEGER) AS file_risk_score, pos, description, CASE WHEN pos IS NOT NULL THEN 'LOW' END AS risk_level
    FROM documents d JOIN (SELECT doc_id, CASE WHEN n > 1 THEN pos END AS pos, CASE WHEN n > 1 THEN l END AS description
                           FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM {_LINES}) WHERE n > 1 OR pos = 0) USING (doc_id)
    """
)
def capability_json(t):
    """O-S4: a report per document; those of one line have no behaviors and stay."""
    behavior = lambda x, i: F.struct(
        x.alias("Description"),
        F.array(F.lit("m")).alias("MatchStrings"),
        F.lit(1).alias("RiskScore"),
        F.lit("LOW").alias("RiskLevel"),
        i.cast("string").alias("ID"),
    )
    behaviors = F.when(F.size(lines_of(F.col("text"))) > 1, _text_lines(behavior))
    path = F.concat(F.lit("/srv/"), "source", F.lit("/"), _string("doc_id"))
    file = F.struct(
        path.alias("Path"),
        F.sha2("text", 256).alias("SHA256"),
        F.col("n_chars").alias("Size"),
        F.array(F.lit("read"), F.lit("write")).alias("Syscalls"),
        behaviors.alias("Behaviors"),
        F.lit(2).alias("RiskScore"),
        F.lit("MEDIUM").alias("RiskLevel"),
    )
    content = F.to_json(F.struct(F.create_map(path, file).alias("Files")))
    rows = D.parse_capability(t.documents.select("doc_id", content.alias("content")), ["doc_id"])
    return rows.select(
        "doc_id",
        "file",
        "sha256",
        "size",
        F.array_join("syscalls", ",").alias("syscalls"),
        "file_risk_score",
        F.col("rule_id").cast("int").alias("pos"),
        "description",
        "risk_level",
    )


def _capability_md(t) -> DataFrame:
    """Documents as report sections of their source's file; by length they have no, two or one table."""
    clean = lambda x: F.translate(x, "|[]()<>", "")
    row = lambda x, i: F.concat(
        F.when(i % 2 == 0, F.lit("| HIGH | [key/")).otherwise(F.lit("| LOW | [key/")),
        (i % 4).cast("string"),
        F.lit("](https://rules.example.com/"),
        i.cast("string"),
        F.lit(") | "),
        clean(x),
        F.lit(" | [a"),
        i.cast("string"),
        F.lit("](https://example.com/a)<br>[b](https://example.com/b) |"),
    )
    doc = F.concat(F.lit("/usr/bin/d "), _string("doc_id"))
    heading = F.concat(F.lit("## reg.example.com/"), "lang", F.lit(":latest ∴ "), doc, F.lit(" [🛑 HIGH]"))
    head = F.array(F.lit("| RISK | KEY | DESCRIPTION | EVIDENCE |"), F.lit("|--|--|--|--|"))
    once = F.concat(head, _text_lines(row))
    table = F.when(F.col("n_chars") % 3 == 0, F.array(F.lit(""))).when(
        F.col("n_chars") % 3 == 1, F.concat(once, F.array(F.lit("")), head)
    ).otherwise(once)
    lines = F.concat(F.array(heading, F.lit("")), table, F.array(F.lit("")))
    return t.documents.select(F.col("source").alias("path"), "doc_id", F.posexplode(lines).alias("i", "line")).select(
        "path", (F.col("doc_id") * 1000000 + F.col("i")).alias("line_no"), "line"
    )


@query(
    f"""
    SELECT source AS report, doc_id * 1000000 + pos + 4 AS line_no, doc_id * 1000000 AS heading_line,
           'reg.example.com/' || lang || ':latest' AS image, '/usr/bin/d ' || doc_id AS file, 'HIGH' AS file_level,
           CASE WHEN pos % 2 = 0 THEN 'HIGH' ELSE 'LOW' END AS risk, 'key/' || pos % 4 AS key,
           'https://rules.example.com/' || pos AS rule_url, translate(l, '|[]()<>', '') AS description, 'a' || pos || ',b' AS evidence
    FROM {_LINES} JOIN (SELECT doc_id, lang, n_chars FROM documents) USING (doc_id) WHERE n_chars % 3 > 0
    """,
    headline=True,
)
def capability_md(t):
    """O-S5."""
    rows = L.parse_capability_md(_capability_md(t))
    return rows.withColumn("evidence", F.array_join("evidence", ","))


@query(
    """
    SELECT source AS report, doc_id * 1000000 AS heading_line, CASE n_chars % 3 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS n_tables,
           n_chars % 3 <> 2 AS ambiguous
    FROM documents
    """
)
def ambiguous_headings(t):
    """O-W8."""
    headings = L.capability_headings(_capability_md(t))
    return headings.select("report", "heading_line", "n_tables", "ambiguous")


# --- O-S7 --------------------------------------------------------------------


@query(
    """
    SELECT CAST(c_nationkey AS VARCHAR) AS scan, 'Testing ' || c_mktsegment AS section, c_custkey * 10 + 1 AS line_no, 0::BIGINT AS position,
           'Owner of ' || c_name AS key, 'offered (OK), ' || c_custkey || ' more ' || c_name || ' and on' AS value
    FROM customer
    """
)
def tls_settings(t):
    """O-S7: a nation is a report, a customer a section of it with a setting over three lines."""
    return L.parse_tls_settings(_tls_lines(t))


def _tls_lines(t) -> DataFrame:
    lines = F.array(
        F.concat(F.lit(" Testing "), "c_mktsegment"),
        F.concat(F.lit(" Owner of "), "c_name", F.lit("      offered (OK), "), _string("c_custkey")),
        F.concat(F.lit(" " * 30), F.lit("more "), "c_name"),
        F.lit(" " * 30 + "and on"),
        F.lit(""),
    )
    rows = t.customer.select(_string("c_nationkey").alias("path"), "c_custkey", F.posexplode(lines).alias("i", "line"))
    # every report begins with lines of no section
    banner = t.nation.select(_string("n_nationkey").alias("path"), F.posexplode(F.array(F.lit(" Start 2025-01-02  -->> host"), F.lit(" " * 30 + "10.0.0.1"), F.lit("---"))).alias("i", "line"))
    return rows.select("path", (F.col("c_custkey") * 10 + F.col("i")).alias("line_no"), "line").unionByName(
        banner.select("path", (F.col("i") - 100).cast("bigint").alias("line_no"), "line")
    )


@query(
    """
    SELECT 'section' AS kind, true AS accepted, count(*) AS n FROM customer UNION ALL SELECT 'setting', true, count(*) FROM customer
    UNION ALL SELECT 'continuation', true, 2 * count(*) FROM customer UNION ALL SELECT 'blank', true, count(*) FROM customer
    UNION ALL SELECT 'before a section', false, 2 * count(*) FROM nation UNION ALL SELECT 'other', false, count(*) FROM nation
    UNION ALL SELECT 'all', NULL, 5 * (SELECT count(*) FROM customer) + 3 * count(*) FROM nation
    """
)
def tls_accounts(t):
    """O-S7: accepted and rejected lines add up to all."""
    return A.accounts(A.tls_kinds(_tls_lines(t)))


@query(
    """
    SELECT 'call' AS kind, true AS accepted, count(*) AS n FROM events UNION ALL SELECT 'trailer or signal', false, count(*) FROM events
    UNION ALL SELECT 'all', NULL, 2 * count(*) FROM events
    """
)
def trace_accounts(t):
    """O-S6."""
    return A.accounts(A.trace_kinds(trace_source(t)))


@query(
    """
    SELECT page_id * 10 + i AS line_no, reason FROM pages, (VALUES (1, 'unfinished'), (2, 'resumed'), (3, 'trailer or signal'), (4, 'no call')) v(i, reason)
    """
)
def trace_rejects(t):
    """O-S6: of every page a call and four lines that are none."""
    lines = F.array(
        F.concat(F.lit('openat(AT_FDCWD, "'), "url", F.lit('", O_RDONLY) = 3')),
        F.concat(F.lit('[pid 7] read(3, "'), "url", F.lit('", <unfinished ...>')),
        F.lit('[pid 7] <... read resumed>"", 9) = 0'),
        F.lit("--- SIGCHLD {si_signo=SIGCHLD} ---"),
        F.concat(F.lit("strace: "), "url"),
    )
    rows = t.pages.select(F.lit("t").alias("path"), "page_id", F.posexplode(lines).alias("i", "line"))
    return L.trace_rejects(rows.select("path", (F.col("page_id") * 10 + F.col("i")).alias("line_no"), "line")).select("line_no", "reason")


@query(
    f"""
    WITH l AS (SELECT * FROM {_LINES}), d AS (SELECT * FROM documents)
    SELECT 'old' AS kind, true AS accepted, count(*) AS n FROM d UNION ALL SELECT 'new', true, count(*) FROM d UNION ALL SELECT 'hunk', true, count(*) FROM d
    UNION ALL SELECT 'changed', true, count(*) FROM l UNION ALL SELECT 'context', true, count(*) FROM d UNION ALL SELECT 'other', false, count(*) FROM d
    UNION ALL SELECT 'all', NULL, 5 * (SELECT count(*) FROM d) + (SELECT count(*) FROM l)
    """
)
def diff_accounts(t):
    """O-S18."""
    return A.accounts(A.diff_kinds(diff_source(t)))


@query("SELECT source AS path, doc_id * 1000000 + 4 + len(string_split(text, chr(10))) AS line_no, 'Binary files differ' AS line FROM documents")
def diff_rejects(t):
    """O-S18."""
    return L.diff_rejects(diff_source(t))


@query(
    f"""
    WITH l AS (SELECT trim(l, ' ') = '' AS empty FROM {_LINES}), t AS (SELECT count(*) AS n FROM {_LINES} JOIN (SELECT doc_id, n_chars FROM documents) USING (doc_id) WHERE n_chars % 3 > 0),
         d AS (SELECT count(*) AS n, count_if(n_chars % 3 = 0) AS a, count_if(n_chars % 3 = 1) AS b, count_if(n_chars % 3 = 2) AS c FROM documents),
         k AS (SELECT 'heading' AS kind, true AS accepted, n FROM d UNION ALL SELECT 'blank', true, 2 * n + a + b + (SELECT count(*) FROM l WHERE empty) FROM d
               UNION ALL SELECT 'table head', true, 2 * b + c FROM d UNION ALL SELECT 'rule', true, 2 * b + c FROM d UNION ALL SELECT 'row', true, n FROM t
               UNION ALL SELECT 'other', false, (SELECT count(*) FROM l WHERE NOT empty) UNION ALL SELECT 'row without heading', false, count(*) FROM nation)
    SELECT kind, accepted, CAST(n AS BIGINT) AS n FROM k UNION ALL SELECT 'all', NULL, CAST(sum(n) AS BIGINT) FROM k
    """
)
def capability_accounts(t):
    """O-S5: reports, the bare texts behind them, and rows that no heading stands above."""
    texts = t.documents.select(F.col("source").alias("path"), "doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    texts = texts.select("path", (F.col("doc_id") * 1000000 + 500000 + F.col("i")).alias("line_no"), "line")
    alone = t.nation.select(F.lit("alone").alias("path"), F.col("n_nationkey").cast("bigint").alias("line_no"), F.lit("| LOW | [a](b) | c | [d](e) |").alias("line"))
    return A.accounts(A.capability_kinds(_capability_md(t).unionByName(texts).unionByName(alone)))


@query(
    """
    SELECT 'host' AS kind, true AS accepted, count(*) AS n FROM pages UNION ALL SELECT 'no host', false, count(*) FROM pages
    UNION ALL SELECT 'blank', true, count(*) FROM pages UNION ALL SELECT 'all', NULL, 3 * count(*) FROM pages
    """
)
def domain_accounts(t):
    """O-S13."""
    return A.accounts(A.domain_kinds(_domain_lines(t)))


@query(
    """
    SELECT p_type AS scan, CASE WHEN p_size > 25 THEN 'TLSv1.3' ELSE 'TLSv1.2' END AS protocol, 'x' || printf('%x', p_partkey) AS hexcode,
           'SUITE-' || p_partkey AS suite, 'ECDH 253' AS key_exchange, 'AESGCM' AS encryption, p_size AS bits, 'TLS_' || p_partkey AS iana
    FROM part
    """
)
def tls_suites(t):
    """O-S7: a part is a suite below a protocol line."""
    lines = F.array(
        F.when(F.col("p_size") > 25, F.lit("TLSv1.3 (server order)")).otherwise(F.lit("TLSv1.2 (no server order)")),
        F.concat(
            F.lit(" x"), F.lower(F.hex("p_partkey")), F.lit("     SUITE-"), _string("p_partkey"),
            F.lit("       ECDH 253   AESGCM      "), _string("p_size"), F.lit("      TLS_"), _string("p_partkey"),
        ),
    )
    rows = t.part.select(F.col("p_type").alias("path"), "p_partkey", F.posexplode(lines).alias("i", "line"))
    return L.parse_tls_suites(rows.select("path", (F.col("p_partkey") * 10 + F.col("i")).alias("line_no"), "line"))


@query(
    """
    SELECT CAST(c_nationkey AS VARCHAR) AS scan, c_name || ' (native)' AS client, CASE WHEN c_acctbal >= 0 THEN 'TLSv1.3' END AS protocol,
           CASE WHEN c_acctbal >= 0 THEN 'SUITE-' || c_mktsegment END AS suite, CASE WHEN c_acctbal >= 0 THEN '253 bit ECDH (X25519)' END AS forward_secrecy
    FROM customer
    """
)
def tls_clients(t):
    """O-S7: customers in debt get no connection."""
    line = F.concat(
        F.lit(" "), "c_name", F.lit(" (native)         "),
        F.when(F.col("c_acctbal") >= 0, F.concat(F.lit("TLSv1.3   SUITE-"), "c_mktsegment", F.lit("     253 bit ECDH (X25519)"))).otherwise(
            F.lit("No connection")
        ),
    )
    rows = t.customer.select(_string("c_nationkey").alias("path"), F.col("c_custkey").alias("line_no"), line.alias("line"))
    return L.parse_tls_clients(rows)


# --- O-S8, O-S9 --------------------------------------------------------------


def _seccomp(t) -> DataFrame:
    profile = F.struct(
        F.lit("SCMP_ACT_ERRNO").alias("defaultAction"),
        F.lit(1).alias("defaultErrnoRet"),
        F.array(F.struct(F.col("p_type").alias("architecture"), F.when(F.col("p_size") > 9, F.split("p_name", " ")).alias("subArchitectures"))).alias("archMap"),
        F.array(
            F.struct(F.split("p_name", " ").alias("names"), F.lit("SCMP_ACT_ALLOW").alias("action"), F.col("p_brand").alias("comment"))
        ).alias("syscalls"),
    )
    return t.part.select("p_partkey", F.to_json(profile).alias("content"))


@query(
    """
    SELECT p_partkey, 'SCMP_ACT_ERRNO' AS default_action, CAST(1 AS INTEGER) AS default_errno, unnest(string_split(p_name, ' ')) AS name,
           'SCMP_ACT_ALLOW' AS action, p_brand AS comment FROM part
    """
)
def seccomp_rules(t):
    """O-S8."""
    return D.parse_seccomp_rules(_seccomp(t), ["p_partkey"])


@query(
    """
    SELECT p_partkey, p_type AS architecture, unnest(CASE WHEN p_size > 9 THEN string_split(p_name, ' ') ELSE [NULL] END) AS sub_architecture FROM part
    """
)
def seccomp_archs(t):
    """O-S8, the architectures."""
    return D.parse_seccomp_archs(_seccomp(t), ["p_partkey"])


def _slim(t) -> DataFrame:
    step = lambda x, i: F.struct(
        F.when(i % 2 == 0, F.lit("RUN")).otherwise(F.lit("ENV")).alias("type"),
        F.lit("2024-01-31T16:49:14Z").alias("time"),
        F.length(x).cast("bigint").alias("size"),
        i.alias("layer_index"),
        x.alias("command_all"),
    )
    report = F.struct(
        F.struct(F.col("n_chars").alias("size"), F.array(F.lit("A=1")).alias("env_vars")).alias("source_image"),
        (F.col("doc_id") % 7).alias("minified_image_size"),
        F.array(F.struct(F.lit(True).alias("is_top_image"), F.col("n_chars").alias("new_size"), _text_lines(step).alias("instructions"))).alias("image_stack"),
    )
    return t.documents.select("doc_id", F.to_json(report).alias("content"))


@query(
    """
    SELECT doc_id, n_chars AS source_size, doc_id % 7 AS minified_size, n_chars::DOUBLE / nullif(doc_id % 7, 0)::DOUBLE AS minified_by,
           CAST(1 AS INTEGER) AS n_images FROM documents
    """
)
def slim_images(t):
    """O-S9, the images."""
    return D.parse_slim_images(_slim(t), ["doc_id"])


@query(
    f"""
    SELECT doc_id, CAST(0 AS INTEGER) AS image_pos, pos, CASE WHEN pos % 2 = 0 THEN 'RUN' ELSE 'ENV' END AS type,
           TIMESTAMP '2024-01-31 16:49:14' AS time, len(l) AS size, pos AS layer_index, l AS command_all FROM {_LINES}
    """
)
def slim_instructions(t):
    """O-S9: a build step per line."""
    return D.parse_slim_instructions(_slim(t), ["doc_id"])


# --- O-S10 -------------------------------------------------------------------


@query(
    """
    SELECT doc_id, 'sha256:' || sha256(text) AS digest, source AS reference, lang AS issuer, doc_id + 1 AS log_index,
           1700000000 + doc_id AS integrated_time, TIMESTAMP '2023-11-14 22:13:20' + to_seconds(doc_id) AS integrated_at, sha256(text) AS inner_hash
    FROM documents
    """
)
def signatures(t):
    """O-S10: a signature record per document with a base64 body."""
    body = F.base64(F.encode(F.to_json(F.struct(F.sha2("text", 256).alias("hash"))), "UTF-8"))
    entry = F.struct(
        F.struct(
            F.struct(F.col("source").alias("docker-reference")).alias("identity"),
            F.struct(F.concat(F.lit("sha256:"), F.sha2("text", 256)).alias("docker-manifest-digest")).alias("image"),
            F.lit("signature").alias("type"),
        ).alias("critical"),
        F.struct(
            F.struct(
                F.struct(
                    body.alias("body"), (F.col("doc_id") + 1700000000).alias("integratedTime"), (F.col("doc_id") + 1).alias("logIndex")
                ).alias("Payload")
            ).alias("Bundle"),
            F.col("lang").alias("Issuer"),
        ).alias("optional"),
    )
    rows = D.parse_signatures(t.documents.select("doc_id", F.to_json(F.array(entry)).alias("content")), ["doc_id"])
    return rows.withColumn("inner_hash", T.decode_json_payload("body", "hash string")["hash"]).drop("subject", "body")


@query("SELECT doc_id, 'application/vnd.in-toto+json' AS payload_type, text AS body, lang AS predicate, CAST(1 AS INTEGER) AS n_signatures FROM documents")
def dsse(t):
    """O-S10: whole texts inside base64 JSON inside JSON."""
    statement = F.to_json(F.struct(F.col("text").alias("body"), F.col("lang").alias("predicate")))
    envelope = F.struct(
        F.lit("application/vnd.in-toto+json").alias("payloadType"),
        F.base64(F.encode(statement, "UTF-8")).alias("payload"),
        F.array(F.struct(F.lit("").alias("keyid"), F.lit("c2ln").alias("sig"))).alias("signatures"),
    )
    docs = t.documents.select("doc_id", F.to_json(envelope).alias("content"))
    rows = D.parse_dsse(docs, ["doc_id"], "body string, predicate string")
    return rows.select("doc_id", "payload_type", "statement.body", "statement.predicate", "n_signatures")


@query("SELECT doc_id, doc_id AS log_index, CAST(1700000000 + doc_id AS BIGINT) AS integrated_time, true AS digest_matches FROM documents")
def tlog(t):
    """O-S10: numbers as text, and the payload digest recorded in the log body."""
    payload = F.base64(F.encode("text", "UTF-8"))
    log_body = F.base64(F.encode(F.to_json(F.struct(F.sha2("text", 256).alias("payloadHash"))), "UTF-8"))
    bundle = F.struct(
        F.struct(
            F.array(
                F.struct(
                    _string("doc_id").alias("logIndex"),
                    (F.col("doc_id") + 1700000000).cast("string").alias("integratedTime"),
                    log_body.alias("canonicalizedBody"),
                )
            ).alias("tlogEntries")
        ).alias("verificationMaterial"),
        F.struct(payload.alias("payload"), F.lit("t").alias("payloadType")).alias("dsseEnvelope"),
    )
    rows = D.parse_tlog(t.documents.select("doc_id", F.to_json(bundle).alias("content")), ["doc_id"])
    recorded = T.decode_json_payload("canonicalized_body", "payloadHash string")["payloadHash"]
    return rows.select(
        "doc_id", "log_index", "integrated_time", T.payload_digest_matches("payload", recorded).alias("digest_matches")
    )


@query(
    f"""
    SELECT doc_id, 'SPDXRef-' || pos AS spdx_id, l AS name, 'sha1:' || pos AS checksum FROM {_LINES}
    """
)
def sbom_packages(t):
    """O-S10, the decoded bill of materials: a package per line."""
    return D.parse_sbom_packages(_sbom(t), ["doc_id"]).select(
        "doc_id", "spdx_id", "name", F.concat(F.lower(F.col("checksums")[0]["algorithm"]), F.lit(":"), F.col("checksums")[0]["checksumValue"]).alias("checksum")
    )


@query(
    f"""
    SELECT doc_id, 'SPDXRef-0' AS spdx_element_id, 'SPDXRef-' || pos AS related_spdx_element, 'VARIANT_OF' AS relationship_type
    FROM {_LINES}
    """
)
def sbom_relationships(t):
    """O-S10, the edges."""
    return D.parse_sbom_relationships(_sbom(t), ["doc_id"])


@query(
    f"""
    SELECT b.doc_id, 'SPDXRef-0' AS spdx_element_id, a.l AS source_name, 'SPDXRef-' || b.pos AS related_spdx_element, b.l AS target_name,
           'VARIANT_OF' AS relationship_type
    FROM {_LINES} a JOIN {_LINES} b ON a.doc_id = b.doc_id WHERE a.pos = 0
    """
)
def sbom_edges_by_document(t):
    """O-J10 within documents: every one has the same ids, and none meets another's."""
    bills = _sbom(t)
    return sbom_edges(D.parse_sbom_packages(bills, ["doc_id"]), D.parse_sbom_relationships(bills, ["doc_id"]), ["doc_id"])


@query(f"SELECT doc_id, 'SPDXRef-' || pos AS spdx_id, CAST(floor(log2(pos + 1)) AS INTEGER) AS depth FROM {_LINES}")
def sbom_reachable_by_document(t):
    """O-J10 without a depth: the lines of a document as a tree, line i above 2i+1 and 2i+2."""
    ref = lambda i: F.concat(F.lit("SPDXRef-"), i.cast("string"))
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    edges = lines.filter("i > 0").select("doc_id", ref(F.expr("(i - 1) div 2")).alias("spdx_element_id"), ref(F.col("i")).alias("related_spdx_element"))
    roots = lines.filter("i = 0").select("doc_id", ref(F.col("i")).alias("spdx_id"))
    return sbom_reachable(edges, roots, None, ["doc_id"])


@query(
    f"""
    WITH f AS (SELECT doc_id, 'R' || pos % 5 AS rule_id, CASE WHEN pos % 2 = 0 THEN 3 ELSE 2 END AS severity,
                      CASE WHEN pos % 3 > 0 THEN source END AS uri, pos % 400 IN (SELECT p_partkey FROM part WHERE p_size <> 13) AS listed FROM {_LINES}),
         r AS (SELECT doc_id, rule_id, max(severity) AS severity, bool_or(listed) AS in_kev, count(DISTINCT uri) AS locations FROM f GROUP BY ALL)
    SELECT doc_id AS scan, rule_id, CAST(severity AS INTEGER) AS severity, locations, in_kev, severity * 100 + CASE WHEN in_kev THEN 50 ELSE 0 END + locations AS score,
           CAST(row_number() OVER (PARTITION BY doc_id ORDER BY severity DESC, in_kev DESC, locations DESC, rule_id) AS INTEGER) AS rank
    FROM r QUALIFY rank <= 3
    """
)
def scan_report(t):
    """From the scanner's own files to ranks: levels become severities, and messages name ids that a catalog document
    lists or not."""
    named = lambda x, i: F.concat(x, F.lit(" CVE-2024-"), F.lpad((i % 400).cast("string"), 6, "0"))
    scans = _sarif(t, named)
    findings = D.parse_findings(scans, ["doc_id"]).select(
        F.col("doc_id").alias("scan"), "rule_id", D.level_severity(F.col("level")).alias("severity"), "message", "uri"
    )
    return rank_findings(findings, kev_catalog(t), 3)


def _sbom(t) -> DataFrame:
    name = lambda i: F.concat(F.lit("SPDXRef-"), i.cast("string"))
    package = lambda x, i: F.struct(
        name(i).alias("SPDXID"),
        x.alias("name"),
        F.array(F.struct(F.lit("SHA1").alias("algorithm"), i.cast("string").alias("checksumValue"))).alias("checksums"),
    )
    edge = lambda x, i: F.struct(
        F.lit("SPDXRef-0").alias("spdxElementId"), name(i).alias("relatedSpdxElement"), F.lit("VARIANT_OF").alias("relationshipType")
    )
    doc = F.struct(_text_lines(package).alias("packages"), _text_lines(edge).alias("relationships"))
    return t.documents.select("doc_id", F.to_json(doc).alias("content"))


# --- O-S11, O-S12 ------------------------------------------------------------


def _digest(x, i):
    return F.sha2(F.concat(i.cast("string"), F.lit(":"), x), 256)


def _image_documents(t) -> tuple[DataFrame, DataFrame]:
    """A config and a manifest per document, a layer per line."""
    step = lambda x, i: F.struct(F.lit("2024-05-06T07:08:09.123456789Z").alias("created"), x.alias("created_by"))
    config = F.struct(
        _text_lines(step).alias("history"),
        F.struct(_text_lines(lambda x, i: F.concat(F.lit("sha256:d"), i.cast("string"))).alias("diff_ids")).alias("rootfs"),
    )
    source = lambda x, i: F.struct(
        F.concat(F.lit("sha256:"), _digest(x, i)).alias("key"),
        F.struct(F.lit("application/vnd.oci.image.layer.v1.tar").alias("mediaType"), F.length(x).alias("size")).alias("value"),
    )
    manifest = F.array(
        F.struct(
            _text_lines(lambda x, i: F.concat(F.lit("blobs/sha256/"), _digest(x, i))).alias("Layers"),
            F.map_from_entries(_text_lines(source)).alias("LayerSources"),
        )
    )
    configs = t.documents.select("doc_id", F.to_json(config).alias("content"))
    manifests = t.documents.select("doc_id", F.to_json(manifest).alias("content"))
    return configs, manifests


@query(
    f"""
    SELECT doc_id, pos, l AS created_by, TIMESTAMP '2024-05-06 07:08:09.123456' AS created, 'sha256:d' || pos AS diff_id,
           'sha256:' || sha256(pos || ':' || l) AS digest, 'application/vnd.oci.image.layer.v1.tar' AS media_type, len(l) AS size
    FROM {_LINES}
    """,
    headline=True,
)
def image_layers(t):
    """O-S11, O-J8: a config and a manifest per document; only the two documents have to be joined."""
    configs, manifests = _image_documents(t)
    layers = D.parse_image_layers(configs, ["doc_id"])
    return layers.join(D.parse_manifest(manifests, ["doc_id"]), ["doc_id", "pos"], "inner")


@query(
    f"""
    SELECT doc_id, pos, l AS created_by, 'sha256:d' || pos AS diff_id, 'sha256:' || sha256(pos || ':' || l) AS digest, len(l) AS size
    FROM {_LINES}
    """
)
def image_layer_tables(t):
    """O-S11, O-J8 from the flattened tables, as four relations."""
    configs, manifests = _image_documents(t)
    return layer_table(
        D.parse_image_history(configs, ["doc_id"]).drop("created"),
        D.parse_image_diff_ids(configs, ["doc_id"]),
        D.parse_manifest_layers(manifests, ["doc_id"]),
        D.parse_manifest_sources(manifests, ["doc_id"]).drop("media_type"),
        "doc_id",
    )


def _daemon(t) -> DataFrame:
    info = F.struct(
        F.col("c_name").alias("ID"),
        F.lit(3).alias("Containers"),
        F.lit(1).alias("ContainersRunning"),
        F.lit(0).alias("ContainersPaused"),
        F.lit(2).alias("ContainersStopped"),
        F.col("c_nationkey").alias("Images"),
        F.array(
            F.array(F.lit("Backing Filesystem"), F.col("c_mktsegment")), F.array(F.lit("Native Overlay Diff"), F.lit("true"))
        ).alias("DriverStatus"),
        F.array(F.concat(F.lit("name=seccomp,profile=p"), _string("c_custkey")), F.lit("name=cgroupns")).alias("SecurityOptions"),
        (F.col("c_custkey") * 5000000000).alias("MemTotal"),
        F.lit(8).alias("NCPU"),
    )
    return t.customer.select("c_custkey", F.to_json(info).alias("content"))


@query(
    """
    SELECT c_custkey, c_name AS id, true AS consistent, c_nationkey AS images, c_mktsegment AS filesystem, 'true' AS native_diff,
           'p' || c_custkey AS profile, CAST(2 AS INTEGER) AS n_options, c_custkey * 5000000000 AS mem_total FROM customer
    """
)
def daemon_info(t):
    """O-S12: a host per customer."""
    rows = D.parse_daemon_info(_daemon(t), ["c_custkey"])
    return rows.select(
        "c_custkey",
        "id",
        (F.col("containers") == F.col("running") + F.col("paused") + F.col("stopped")).alias("consistent"),
        "images",
        F.col("driver_status")["Backing Filesystem"].alias("filesystem"),
        F.col("driver_status")["Native Overlay Diff"].alias("native_diff"),
        F.col("security_options")[0]["profile"].alias("profile"),
        F.size("security_options").alias("n_options"),
        "mem_total",
    )


@query(
    """
    SELECT c_custkey, unnest(['ID', 'Containers', 'ContainersRunning', 'ContainersPaused', 'ContainersStopped', 'Images', 'DriverStatus', 'SecurityOptions', 'MemTotal', 'NCPU']) AS key,
           unnest([c_name, '3', '1', '0', '2', c_nationkey::VARCHAR, '[["Backing Filesystem","' || c_mktsegment || '"],["Native Overlay Diff","true"]]',
                   '["name=seccomp,profile=p' || c_custkey || '","name=cgroupns"]', (c_custkey * 5000000000)::VARCHAR, '8']) AS value FROM customer
    """
)
def daemon_facts(t):
    """O-S12 as key and value, all fields."""
    return D.daemon_facts(_daemon(t), ["c_custkey"])


# --- O-S13 … O-S17 -----------------------------------------------------------

_HOST = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"


@query(
    f"""
    SELECT 'list' AS path, page_id * 3 AS line_no, {_HOST} AS domain, true AS is_host FROM pages
    UNION ALL SELECT 'list', page_id * 3 + 1, {_HOST} || '/ads', false FROM pages
    """
)
def domain_list(t):
    """O-S13: every host with a trailing blank, once more with a path, and an empty line."""
    return L.parse_domain_list(_domain_lines(t))


def _domain_lines(t) -> DataFrame:
    host = T.url_host("url")
    lines = F.array(F.concat(host, F.lit(" ")), F.concat(host, F.lit("/ads")), F.lit("  "))
    rows = t.pages.select("page_id", F.posexplode(lines).alias("i", "line"))
    return rows.select(F.lit("list").alias("path"), (F.col("page_id") * 3 + F.col("i")).alias("line_no"), "line")


@query(r"SELECT 'list' AS path, page_id AS line_no, '(^|\.)' || page_id || '$' AS pattern FROM pages")
def regex_list(t):
    """O-S13, patterns."""
    line = F.concat(F.lit(" (^|\\.)"), _string("page_id"), F.lit("$ "))
    return L.parse_regex_list(t.pages.select(F.lit("list").alias("path"), F.col("page_id").alias("line_no"), line.alias("line")))


@query(
    """
    SELECT 'doc-' || doc_id || '.md' AS file, 'Doc ' || doc_id AS title, CASE WHEN n_chars % 2 = 0 THEN 'About ' || lang END AS excerpt,
           text AS body, n_chars % 2 = 0 AS complete FROM documents
    """
)
def posts(t):
    """O-S14: whole texts below a front matter that lacks the excerpt for every other one."""
    excerpt = F.when(F.col("n_chars") % 2 == 0, F.concat(F.lit("excerpt: About "), "lang", F.lit("\n"))).otherwise(F.lit(""))
    content = F.concat(F.lit('---\nlayout: post\ntitle: "Doc '), _string("doc_id"), F.lit('"\n'), excerpt, F.lit("---\n"), "text")
    path = F.concat(F.lit("/posts/doc-"), _string("doc_id"), F.lit(".md"))
    return L.parse_posts(t.documents.select(path.alias("path"), content.alias("content")))


@query(
    """
    SELECT c_custkey, 'TEL' AS key, 'WORK' AS kind, 'tel:' || c_custkey AS value FROM customer
    UNION ALL SELECT c_custkey, 'FN', NULL, c_name FROM customer
    """
)
def tagged_lines(t):
    """O-S15: contact cards."""
    lines = F.array(
        F.lit("BEGIN"), F.concat(F.lit("FN:"), "c_name"), F.concat(F.lit("TEL;TYPE=HOME;TYPE=WORK:tel:"), _string("c_custkey"))
    )
    rows = t.customer.select("c_custkey", F.posexplode(lines).alias("i", "line"))
    out = L.parse_tagged_lines(rows.select(_string("c_custkey").alias("path"), F.col("i").cast("bigint").alias("line_no"), "line"))
    return out.select(
        F.col("path").cast("bigint").alias("c_custkey"), "key", F.try_element_at("params", F.lit("TYPE")).alias("kind"), "value"
    )


@query("SELECT * FROM events")
def events_scan(t):
    """O-S16."""
    return read_events(t.spark, f"{t.sf_dir}/events.parquet")


def _image_ref_lines(t) -> DataFrame:
    """Of every page a list with a quoted reference, and a script with an array of two and commands around it."""
    ref = F.concat(T.url_host("url"), F.lit("/img:"), _string("page_id"))
    plain = F.array(F.lit("# images"), F.concat(F.lit('  "'), ref, F.lit('"  # pinned')), F.lit(""))
    script = F.array(
        F.lit("#!/bin/bash"), F.lit("set"), F.lit("images=("), F.concat(F.lit('    "'), ref, F.lit('-a"  # first')), F.concat(F.lit("    "), ref, F.lit("-b")),
        F.lit(")"), F.lit('for i in "${images[@]}"; do'), F.lit('    docker pull "$i"'), F.lit("done"),
    )
    file = lambda name, lines: t.pages.select(F.concat(F.lit(name), _string("page_id")).alias("path"), F.posexplode(lines).alias("i", "line"))
    return file("list-", plain).unionByName(file("script-", script)).select("path", F.col("i").cast("bigint").alias("line_no"), "line")


@query(
    f"""
    SELECT 'list-' || page_id AS path, 1::BIGINT AS line_no, {_HOST} || '/img:' || page_id AS ref FROM pages
    UNION ALL SELECT 'script-' || page_id, 3 + i, {_HOST} || '/img:' || page_id || CASE i WHEN 0 THEN '-a' ELSE '-b' END FROM pages, range(2) r(i)
    """
)
def image_refs(t):
    """O-S17."""
    return L.parse_image_refs(_image_ref_lines(t))


@query(
    """
    SELECT 'reference' AS kind, true AS accepted, 3 * count(*) AS n FROM pages UNION ALL SELECT 'script', true, 6 * count(*) FROM pages
    UNION ALL SELECT 'blank', true, 3 * count(*) FROM pages UNION ALL SELECT 'all', NULL, 12 * count(*) FROM pages
    """
)
def image_ref_accounts(t):
    """O-S17."""
    return A.accounts(A.image_ref_kinds(_image_ref_lines(t)))


@query(f"SELECT l AS line, count(*) AS n, true AS dense FROM {_LINES} GROUP BY l")
def read_lines(t):
    """Reader of O-S5 to O-S7: whole texts written as files, read back and numbered per file."""
    path = fresh_path(t.spark, "texts")
    t.documents.select("text").write.text(path)
    lines = L.read_lines(t.spark, path)
    per_file = lines.groupBy("path").agg(
        (
            (F.min("line_no") == 1) & (F.max("line_no") == F.count(F.lit(1))) & (F.count_distinct("line_no") == F.count(F.lit(1)))
        ).alias("ok")
    )
    dense = per_file.agg(F.bool_and("ok").alias("dense")).first()["dense"]
    return lines.groupBy("line").agg(F.count(F.lit(1)).alias("n")).withColumn("dense", F.lit(dense))


@query(
    """
    SELECT * FROM (SELECT source || '/' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS path, text AS content FROM documents ORDER BY path LIMIT 20)
    """
)
def log_sample(t):
    """O-S3 over logs that are rows."""
    path = F.concat("source", F.lit("/"), F.lpad(_string("doc_id"), 8, "0"))
    return L.first_documents(t.documents.select(path.alias("path"), F.col("text").alias("content")), "path")


# --- sinks -------------------------------------------------------------------


@query(
    """
    SELECT event_id, CASE WHEN event_type <> 'error' THEN 'u' || user_id END AS username, event_type AS target_repo, event_type <> 'error' AS accepted FROM events
    """
)
def append_event(t):
    """O-K1: events appended in two loads, errors lack a name and land in quarantine."""
    rows = t.events.select(
        "event_id",
        F.when(F.col("event_type") != "error", F.concat(F.lit("u"), _string("user_id"))).alias("username"),
        F.col("event_type").alias("target_repo"),
    )
    path, early = fresh_path(t.spark, "events"), F.col("target_repo") < "d"
    for load in (rows.filter(early), rows.filter(~early)):
        sinks.append_event(load, path, ["username", "target_repo"])
    return t.spark.read.parquet(path).withColumn("accepted", F.col("accepted").cast("boolean"))


@query(
    """
    WITH r AS (
        SELECT 1 AS ordinal, i AS part, '' AS k, ['# Orders', '_Model: none_'][i + 1] AS text FROM range(2) r(i)
        UNION ALL SELECT o, i, '', ['', '---', '', CASE o WHEN 2 THEN '## By priority' ELSE '## By status' END, ''][i + 1] FROM (VALUES (2), (4)) v(o), range(5) r(i)
        UNION ALL SELECT 3, 0, o_orderpriority, '- ' || o_orderpriority || ': ' || count(*) FROM orders GROUP BY o_orderpriority
        UNION ALL SELECT 5, 0, o_orderstatus, '- ' || o_orderstatus || ': ' || count(*) FROM orders GROUP BY o_orderstatus)
    SELECT row_number() OVER (ORDER BY ordinal, part, k) AS line_no, text FROM r
    """
)
def report_lines(t):
    """O-K2."""

    def section(column: str) -> DataFrame:
        counted = t.orders.groupBy(F.col(column).alias("k")).agg(F.count(F.lit(1)).alias("n"))
        return counted.select("k", F.concat(F.lit("- "), "k", F.lit(": "), _string("n")).alias("text"))

    sections = [("By priority", section("o_orderpriority")), ("By status", section("o_orderstatus"))]
    report = sinks.report_lines(["# Orders", "_Model: none_"], sections, ["k"], "text")
    return sinks.numbered_report(report)


@query(
    """
    SELECT 'none' AS kind, CAST(n AS BIGINT) AS n, note FROM (VALUES (0, 'No differences found.'), (0, 'Nothing to report.')) v(n, note)
    WHERE NOT EXISTS (SELECT 1 FROM events WHERE value < 0)
    UNION ALL SELECT event_type, count(*), '' FROM events GROUP BY event_type
    """
)
def empty_fallback(t):
    """O-K3: once for an empty and once for a filled result."""
    report = lambda df: df.groupBy(F.col("event_type").alias("kind")).agg(
        F.count(F.lit(1)).alias("n"), F.lit("").alias("note")
    )
    spare = t.spark.createDataFrame(
        [("none", 0, "No differences found."), ("none", 0, "Nothing to report.")], "kind string, n bigint, note string"
    )
    return sinks.with_empty_fallback(report(t.events.filter("value < 0")), spare).unionByName(
        sinks.with_empty_fallback(report(t.events), spare)
    )


@query("SELECT doc_id, text || chr(10) || '<!-- a -->' || chr(10) || '1. new $1' || chr(10) || '<!-- b -->' || chr(10) || text AS page FROM documents")
def replace_section(t):
    """O-K4 inside whole texts."""
    page = F.concat("text", F.lit("\n<!-- a -->\nold\nlines\n<!-- b -->\n"), "text")
    new = sinks.replace_section(page, "<!-- a -->", "<!-- b -->", "1. new $1\n")
    return t.documents.select("doc_id", new.alias("page"))


@query(
    """
    SELECT o_orderpriority, count(*) AS n_rows, bool_or(o_orderstatus = 'P' AND o_orderpriority = '3-MEDIUM') AS changed,
           CAST(CAST(sum(('0x' || left(sha256(length(o_orderkey::VARCHAR) || ':' || o_orderkey || length(o_orderstatus) || ':' || o_orderstatus || length(o_orderpriority) || ':' || o_orderpriority), 15))::BIGINT) AS HUGEINT) AS VARCHAR) AS digest
    FROM orders GROUP BY ALL
    """
)
def content_changed(t):
    """O-K5: the digest comparison per priority; one of them has rows that changed."""
    old = t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority")
    hit = (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "3-MEDIUM")
    new = old.withColumn("o_orderstatus", F.when(hit, F.lit("F")).otherwise(F.col("o_orderstatus")))
    before = sinks.content_digest(old, ["o_orderpriority"], old.columns)
    after = sinks.content_digest(new, ["o_orderpriority"], old.columns).withColumnRenamed("digest", "new_digest")
    both = before.join(after, ["o_orderpriority", "n_rows"])
    return both.withColumn("changed", F.col("digest") != F.col("new_digest")).drop("new_digest")
