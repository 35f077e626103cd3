"""Filters and data-quality checks over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from telltale import functions as T
from telltale.operators import filters, nested, quality
from telltale.queries.registry import query
from telltale.sources.lines import parse_diff, parse_trace


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '5-LOW')")
def skip_list(t):
    """O-F1."""
    return filters.skip_list(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority", ["1-URGENT", "5-LOW"])


def diff_source(t):
    """Documents as diff files: a header each, a hunk that counts its lines, every line signed, every third with a
    reference, some that begin like a file header, and a line that is nothing of a diff."""
    body = F.transform(
        nested.lines_of(F.col("text")),
        lambda x, i: F.concat(
            F.when(i % 2 == 0, F.lit("-")).otherwise(F.lit("+")),
            F.when(i % 10 == 4, F.lit("-- ")).when(i % 10 == 7, F.lit("++ ")).when(i % 3 == 0, F.lit(" uses: ")).otherwise(F.lit(" ")),
            x,
        ),
    )
    doc = F.col("doc_id").cast("string")
    # the context counts on both sides
    due = [F.expr("(size(split(text, '\n')) + 1) div 2 + 1").cast("string"), F.expr("size(split(text, '\n')) div 2 + 1").cast("string")]
    hunk = F.concat(F.lit("@@ -1,"), due[0], F.lit(" +1,"), due[1], F.lit(" @@"))
    header = F.array(F.concat(F.lit("--- a/d"), doc), F.concat(F.lit("+++ b/d"), doc), hunk)
    lines = F.concat(header, body, F.array(F.lit(" context"), F.lit("Binary files differ")))
    return t.documents.select(
        F.col("source").alias("path"), "doc_id", F.posexplode(lines).alias("i", "line")
    ).select("path", (F.col("doc_id") * 1000000 + F.col("i")).alias("line_no"), "line")


_DIFF_SQL = """
    SELECT source AS path, 'd' || doc_id AS file, doc_id * 1000000 + i + 2 AS line_no,
           CASE WHEN (i - 1) % 2 = 0 THEN '-' ELSE '+' END AS sign,
           CASE WHEN (i - 1) % 10 = 4 THEN '-- ' WHEN (i - 1) % 10 = 7 THEN '++ ' WHEN (i - 1) % 3 = 0 THEN ' uses: ' ELSE ' ' END || l AS text
    FROM (SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents),
         LATERAL (SELECT unnest(ls) AS l, generate_subscripts(ls, 1) AS i)
"""


@query(_DIFF_SQL)
def diff_reader(t):
    """O-S18: hot "files" are split by line blocks when the header is carried down."""
    return parse_diff(diff_source(t))


@query(f"SELECT file, line_no, text FROM ({_DIFF_SQL}) WHERE sign = '+' AND contains(text, 'uses:')")
def diff_lines(t):
    """O-F2."""
    return filters.diff_lines(parse_diff(diff_source(t)), "+").select("file", "line_no", "text")


@query(
    """
    SELECT event_id, s AS risk_score
    FROM (SELECT event_id, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'error' THEN 3
                 WHEN 'signup' THEN 4 END AS s FROM events) WHERE s >= 3
    """
)
def min_risk(t):
    """O-F3."""
    name = F.expr(
        "CASE event_type WHEN 'view' THEN 'LOW' WHEN 'click' THEN 'MEDIUM' WHEN 'error' THEN 'HIGH' WHEN 'signup' THEN 'CRITICAL' END"
    )
    scored = t.events.select("event_id", T.risk_score(name).alias("risk_score"))
    return filters.min_risk(scored, "HIGH")


@query(
    r"""
    SELECT page_id, path FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*/?([^?#]*)', 1) AS path FROM pages)
    WHERE regexp_matches(path, '^en/[^/]*$') OR regexp_matches(path, '\.html$')
    """
)
def changed_path_match(t):
    """O-F4 on one path per row."""
    paths = t.pages.select("page_id", T.url_path("url").alias("path"))
    return filters.changed_path_match(paths, "path", ["en/*", "**/*.html"])


@query(
    r"""
    SELECT page_id FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*/?([^?#]*)', 1) AS path, html FROM pages)
    WHERE regexp_matches(path, '^fr/.*$') OR contains(html, 'href="/the"')
    """
)
def changed_paths_match(t):
    """O-F4 on an array of paths per row: the page's own and all that it links to."""
    links = F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1))
    paths = F.concat(F.array(T.url_path("url")), links)
    return filters.changed_path_match(t.pages.select("page_id", paths.alias("paths")), "paths", ["fr/**", "the"]).select(
        "page_id"
    )


@query(
    """
    SELECT o_orderkey, o_orderpriority, o_orderstatus FROM orders
    WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW') AND o_orderstatus = 'F'
    """
)
def event_type_in(t):
    """O-F5: priority stands for the event type, status for the branch."""
    orders = t.orders.select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return filters.event_type_in(orders, "o_orderpriority", ["1-URGENT", "2-HIGH", "5-LOW"], o_orderstatus="F")


@query(
    """
    SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN p_size <= 25 THEN 'SCMP_ACT_ALLOW' ELSE 'SCMP_ACT_ERRNO' END AS decision,
           CASE WHEN p_size > 25 THEN CAST(1 AS INTEGER) END AS decision_errno
    FROM lineitem JOIN part ON l_partkey = p_partkey
    """
)
def seccomp_decision(t):
    """O-F6: parts up to size 25 are the listed calls."""
    rules = t.part.filter("p_size <= 25").select(F.col("p_partkey").alias("l_partkey"), F.lit("SCMP_ACT_ALLOW").alias("action"))
    calls = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    return filters.seccomp_decision(calls, rules, "l_partkey")


@query(
    r"""
    SELECT page_id, host FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM pages)
    WHERE regexp_matches(host, '(^|\.)ads[-.]') OR regexp_matches(host, '^m\.') OR regexp_matches(host, 'farm')
    """
)
def domain_regex_block(t):
    """O-F7."""
    hosts = t.pages.select("page_id", T.url_host("url").alias("host"))
    return filters.domain_regex_block(hosts, "host", [r"(^|\.)ads[-.]", r"^m\.", "farm"])


@query(
    """
    WITH h AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) AS host FROM pages)
    SELECT page_id, host FROM h WHERE starts_with(host, 'm.') OR contains(host, '-') OR substr(host, length(host) - 2) = 'org'
        OR split_part(host, '.', 1) IN (SELECT split_part(host, '.', 1) FROM h WHERE page_id % 5 = 0)
    """
)
def domain_patterns(t):
    """O-F7 with a table of patterns: the first label of the host of every fifth page, and some without a fixed piece."""
    hosts = t.pages.select("page_id", T.url_host("url").alias("host"))
    label = F.regexp_extract("host", r"^([^.]+)", 1)
    own = hosts.filter("page_id % 5 = 0").select(F.concat(F.lit("^"), label, F.lit(r"\.([a-z]+\.?)+$")).alias("pattern"))
    few = t.region.select(F.explode(F.array(F.lit(r"^m\."), F.lit("-"), F.lit(r"(\.org|\.[o]rg)$"), F.lit("qqq+unheard"), F.lit(None))).alias("pattern"))
    return filters.domain_pattern_block(hosts, "host", own.unionByName(few))


def trace_source(t):
    """Events as trace lines; errors and signups fail, and every user has an exit trailer."""
    ret = (
        F.when(F.col("event_type") == "error", F.lit("-1 ENOENT (No such file or directory)"))
        .when(F.col("event_type") == "signup", F.lit("-1 EINPROGRESS (Operation now in progress)"))
        .when(F.col("event_type") == "view", F.lit("0x7f00"))
        .otherwise(F.lit("0"))
    )
    call = F.concat("event_type", F.lit("("), F.col("user_id").cast("string"), F.lit(', "'), "props", F.lit('")       = '), ret)
    lines = F.array(call, F.lit("+++ exited with 0 +++"))
    return t.events.select(
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("path"), "event_id", F.posexplode(lines).alias("i", "line")
    ).select("path", (F.col("event_id") * 2 + F.col("i")).alias("line_no"), "line")


_TRACE_SQL = """
    SELECT 'user-' || user_id AS path, event_id * 2 AS line_no, event_type AS syscall,
           user_id || ', "' || props || '"' AS args,
           CASE event_type WHEN 'error' THEN '-1' WHEN 'signup' THEN '-1' WHEN 'view' THEN '0x7f00' ELSE '0' END AS ret,
           CASE event_type WHEN 'error' THEN 'ENOENT' WHEN 'signup' THEN 'EINPROGRESS' END AS errno
    FROM events
"""


@query(_TRACE_SQL, headline=True)
def trace_reader(t):
    """O-S6."""
    return parse_trace(trace_source(t))


@query(f"SELECT path, line_no, errno FROM ({_TRACE_SQL}) WHERE errno IS NOT NULL")
def failed_calls(t):
    """O-F8."""
    return filters.failed_calls(parse_trace(trace_source(t))).select("path", "line_no", "errno")


@query(
    """
    SELECT p_partkey, concat_ws(',', CASE WHEN bits < 2048 THEN 'key_size' END,
             CASE WHEN exponent NOT IN (1, 3, 17, 65537) THEN 'exponent' END,
             CASE WHEN hash NOT IN ('sha256', 'sha384', 'sha512') THEN 'hash' END) AS violations,
           bits >= 2048 AND exponent IN (1, 3, 17, 65537) AND hash IN ('sha256', 'sha384', 'sha512') AS compliant,
           exponent = 1 AS weak_exponent
    FROM (SELECT p_partkey, p_size * 128 AS bits,
                 CASE p_size % 5 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 17 WHEN 3 THEN 65537 ELSE 5 END AS exponent,
                 CASE p_type WHEN 'STANDARD' THEN 'sha256' WHEN 'ECONOMY' THEN 'sha384' WHEN 'PROMO' THEN 'sha512'
                             WHEN 'SMALL' THEN 'sha1' ELSE 'md5' END AS hash FROM part)
    """
)
def crypto_policy(t):
    """O-F9."""
    keys = t.part.select(
        "p_partkey",
        F.expr("p_size * 128").alias("bits"),
        F.expr("CASE p_size % 5 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 17 WHEN 3 THEN 65537 ELSE 5 END").alias("exponent"),
        F.expr(
            "CASE p_type WHEN 'STANDARD' THEN 'sha256' WHEN 'ECONOMY' THEN 'SHA384' WHEN 'PROMO' THEN 'sha512' WHEN 'SMALL' THEN 'sha1' ELSE 'md5' END"
        ).alias("hash"),
    )
    return filters.crypto_policy(keys, "bits", "exponent", "hash").drop("bits", "exponent", "hash")


@query(
    """
    SELECT o_orderkey, o_orderdate < TIMESTAMP '1998-06-01' AS expired,
           CAST(date_diff('day', DATE '1998-06-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS days_left,
           o_orderdate >= TIMESTAMP '1998-06-01' AND date_diff('day', DATE '1998-06-01', CAST(o_orderdate AS DATE)) < 30 AS expires_within
    FROM orders
    """
)
def cert_validity(t):
    """O-F10: the order date is the end of validity."""
    certs = t.orders.select("o_orderkey", "o_orderdate")
    return filters.cert_validity(certs, "o_orderdate", "1998-06-01 00:00:00", 30).drop("o_orderdate")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1996-03-01'")
def cert_expired(t):
    """O-F10 as a filter; the bound reaches the parquet scan."""
    return filters.cert_expired(t.orders, "o_orderdate", "1996-03-01 00:00:00").select("o_orderkey")


@query(
    r"""
    SELECT p_partkey, suite FROM (SELECT p_partkey, 'TLS_' || upper(replace(p_name, ' ', '_')) || '_' || p_size AS suite FROM part)
    WHERE regexp_matches(suite, '(^|[^A-Za-z0-9])(RED|WIDGET|25)([^A-Za-z0-9]|$)')
    """
)
def weak_suites(t):
    """O-F11: suite names built from part names."""
    suite = F.concat(F.lit("TLS_"), F.upper(F.translate("p_name", " ", "_")), F.lit("_"), F.col("p_size").cast("string"))
    return filters.weak_suites(t.part.select("p_partkey", suite.alias("suite")), "suite", ["RED", "WIDGET", "25"])


@query(
    r"""
    SELECT doc_id, pos, line AS redacted, '' AS files FROM (SELECT doc_id, 0 AS pos, 'db_password = ***' AS line FROM documents WHERE doc_id % 3 = 0
        UNION ALL SELECT doc_id, 1, 'X-Api-Key: "***" ' || source FROM documents WHERE doc_id % 4 <> 1)
    UNION ALL SELECT doc_id, 2, 'COPY --chmod=600 ' || CASE doc_id % 3 WHEN 0 THEN 'secret.txt' WHEN 1 THEN '"keys/my id_rsa" a' ELSE 'conf/.env' END || ' /n/' || lang || '/',
           CASE doc_id % 3 WHEN 0 THEN 'secret.txt' ELSE 'conf/.env' END FROM documents WHERE doc_id % 3 <> 1
    UNION ALL SELECT doc_id, CAST(i + 2 AS INTEGER), regexp_replace(l, '(?i)((?:password|passwd|secret|token|api[_-]?key)[ \t]*[=:][ \t]*"?)([^ \t\r\n"]+)', '\1***', 'g'), ''
    FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), LATERAL (SELECT unnest(ls) AS l, generate_subscripts(ls, 1) AS i)
    WHERE regexp_matches(l, '(?i)((?:password|passwd|secret|token|api[_-]?key)[ \t]*[=:][ \t]*"?)([^ \t\r\n"]+)')
    """,
    headline=True,
)
def secret_lines(t):
    """O-F12 on every line of every text below lines with settings and copies, of which some tell no secret."""
    tail = F.concat(F.lit(" /n/"), "lang", F.lit("/"))
    third = F.col("doc_id") % 3
    setting = F.when(third == 0, F.concat(F.lit("db_password = "), "source")).otherwise(F.concat(F.lit("password is "), "source"))
    key = F.when(F.col("doc_id") % 4 != 1, F.concat(F.lit('X-Api-Key: "k'), "doc_id", F.lit('" '), "source")).otherwise(F.lit("token bucket"))
    source = F.when(third == 0, F.lit("secret.txt")).when(third == 1, F.lit('"keys/my id_rsa.pub" a')).otherwise(F.lit("conf/.env"))
    made = F.array(setting, key, F.concat(F.lit("COPY --chmod=600 "), source, tail))
    lines = t.documents.select("doc_id", F.posexplode(F.concat(made, nested.lines_of(F.col("text")))).alias("pos", "line"))
    found = filters.secret_lines(lines, "line")
    return found.select("doc_id", "pos", "redacted", F.array_join("secret_files", ",").alias("files"))


@query("SELECT event_id, event_type NOT IN ('error', 'click') AS ok FROM events")
def handshake_ok(t):
    """O-F13: client transcripts built from events."""
    text = F.expr(
        "CASE event_type WHEN 'error' THEN 'New, (NONE), Cipher is (NONE)' WHEN 'click' THEN 'SSL-Session:\n    Cipher    : 0000' "
        "WHEN 'view' THEN 'New, TLSv1.3, Cipher is TLS_CHACHA20_POLY1305_SHA256' ELSE concat('    Cipher    : AES', user_id) END"
    )
    return t.events.select("event_id", filters.handshake_ok(text).alias("ok"))


# --- data quality -----------------------------------------------------------

_HOLES = "event_id, ts, CASE WHEN event_type <> 'error' THEN event_type END AS event_type, CASE WHEN value > 10 THEN value END AS value"


@query(
    f"""
    SELECT 'event_id' AS "column", count(*) FILTER (event_id IS NULL) AS n_null, count(*) AS n_rows FROM (SELECT {_HOLES} FROM events)
    UNION ALL SELECT 'event_type', count(*) FILTER (event_type IS NULL), count(*) FROM (SELECT {_HOLES} FROM events)
    UNION ALL SELECT 'value', count(*) FILTER (value IS NULL), count(*) FROM (SELECT {_HOLES} FROM events)
    """
)
def null_counts(t):
    """O-Q1."""
    holes = t.events.selectExpr(*(p.strip() for p in _HOLES.split(", ")))
    return quality.null_counts(holes, ["event_id", "event_type", "value"])


@query("SELECT o_custkey, o_orderdate, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(t):
    """O-Q2 on a key that is not unique."""
    return quality.duplicate_keys(t.orders, ["o_custkey", "o_orderdate"])


@query("SELECT o_orderkey, count(*) AS n FROM (SELECT o_orderkey FROM orders UNION ALL SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY ALL HAVING count(*) > 1")
def primary_key(t):
    """O-Q2 on the key itself, with a partly repeated load."""
    again = t.orders.filter("o_orderstatus = 'F'").select("o_orderkey")
    return quality.duplicate_keys(t.orders.select("o_orderkey").unionAll(again), ["o_orderkey"])


@query("SELECT event_id, user_id, row_number() OVER (ORDER BY user_id, ts) AS surrogate_id FROM events", headline=True)
def surrogate_id(t):
    """O-Q3: a dense global number without a global window."""
    events = t.events.select("event_id", "user_id", "ts")
    return quality.surrogate_id(events, ["user_id", "ts"]).drop("ts")


@query("SELECT count(*) AS n_rows, count(DISTINCT event_id) AS n_ids FROM events")
def sparse_id(t):
    """O-Q3, the form with gaps: only uniqueness can be compared."""
    ids = quality.sparse_id(t.events.select("event_id"))
    return ids.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("surrogate_id").alias("n_ids"))


@query(
    """
    SELECT event_id, event_type NOT IN ('error', 'click') AS valid,
           CASE WHEN event_type NOT IN ('error', 'click') THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k
    FROM events
    """
)
def validate_records(t):
    """O-Q4: errors carry broken text, clicks a value of the wrong type."""
    payload = F.expr(
        "CASE event_type WHEN 'error' THEN substring(props, 1, length(props) - 1) WHEN 'click' THEN '{\"k\": \"many\"}' ELSE props END"
    )
    records = t.events.select("event_id", payload.alias("payload"))
    checked = quality.validate_records(records, "payload", "k bigint", ["k"])
    return checked.select("event_id", "valid", F.when(F.col("valid"), F.col("k")).alias("k"))


@query(
    """
    SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
    WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 40)
    """
)
def dangling(t):
    """O-Q5: rules are the parts below size 40."""
    rules = t.part.filter("p_size < 40").select(F.col("p_partkey").alias("l_partkey"))
    return quality.dangling(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), rules, "l_partkey")


@query(
    """
    SELECT p_partkey, replace(p_name, ' ', '-') AS package,
           CASE WHEN p_size % 4 > 0 THEN p_size || '.' || p_partkey END AS version
    FROM part
    """
)
def pin_inventory(t):
    """O-Q7: requirement lines built from parts, one comment line beside each."""
    name, size = F.translate("p_name", " ", "-"), F.col("p_size").cast("string")
    pinned = F.concat(name, F.lit("=="), size, F.lit("."), F.col("p_partkey").cast("string"), F.lit("  # pinned"))
    line = F.when(F.col("p_size") % 4 > 0, pinned).otherwise(name)
    lines = t.part.select("p_partkey", F.explode(F.array(line, F.lit("# comment"))).alias("line"))
    return quality.pin_inventory(lines, "line").drop("line")
