"""Scalar functions and nested-value functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from telltale import functions as T
from telltale.operators import nested
from telltale.queries.registry import query

# A model run derived from an order line: tokens from the quantity, nanoseconds
# from the tax, so that untaxed lines have a duration of zero.
RUN_NS = "CAST(round(l_tax * 100) AS BIGINT) * 10000000"


@query(
    f"""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
           CAST(l_quantity AS BIGINT)::DOUBLE / nullif(({RUN_NS}) / 1e9, 0) AS rate
    FROM lineitem
    """,
    headline=True,
)
def token_rate(t):
    """O-P1."""
    rate = T.token_rate(F.col("l_quantity").cast("bigint"), F.expr(RUN_NS))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", rate.alias("rate"))


@query(
    """
    SELECT l_orderkey, l_linenumber, l_partkey,
           CASE WHEN c = -1 THEN 0 ELSE c END AS n_tokens, c = -1 AS was_missing
    FROM (SELECT *, CASE WHEN l_discount = 0 THEN -1 ELSE CAST(l_quantity AS BIGINT) END AS c FROM lineitem)
    """
)
def sentinel_to_zero(t):
    """O-P2."""
    count = F.when(F.col("l_discount") == 0, F.lit(-1).cast("bigint")).otherwise(F.col("l_quantity").cast("bigint"))
    return t.lineitem.withColumn("c", count).select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        T.sentinel_to_zero("c").alias("n_tokens"),
        (F.col("c") == -1).alias("was_missing"),
    )


@query(
    """
    SELECT event_id, coalesce(CASE WHEN event_type <> 'error' THEN value END, 0.0) AS amount,
           coalesce(nullif(event_type, 'view'), '') AS kind,
           coalesce(CASE WHEN event_type = 'click' THEN false END, true) AS done
    FROM events
    """
)
def default_missing(t):
    """O-P3."""
    kind = F.col("event_type")
    return t.events.select(
        "event_id",
        T.default_missing(F.when(kind != "error", F.col("value")), 0.0).alias("amount"),
        T.default_missing(F.nullif(kind, F.lit("view")), "").alias("kind"),
        T.default_missing(F.when(kind == "click", F.lit(False)), True).alias("done"),
    )


@query("SELECT l_orderkey, l_linenumber, l_partkey, printf('%.2f', l_extendedprice * l_discount) AS shown FROM lineitem")
def fmt2(t):
    """O-P4."""
    shown = T.fmt2(F.col("l_extendedprice") * F.col("l_discount"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", shown.alias("shown"))


@query(
    """
    SELECT p_partkey,
           'org' || (p_size % 7) AS org, split_part(p_name, ' ', 1) AS repo,
           CASE WHEN p_size > 40 THEN 'nested/' || lower(p_type) WHEN p_size > 20 THEN lower(p_type) END AS dir,
           CASE WHEN p_size % 3 = 1 THEN 'v' || p_size || '.0'
                WHEN p_size % 3 = 2 THEN left(sha256(CAST(p_partkey AS VARCHAR)), 40) END AS ref,
           p_size % 3 = 2 AS pinned
    FROM part
    """
)
def action_refs(t):
    """O-P5, O-P7, O-Q6: reference lines built from parts, with markers, comments and nesting."""
    size = F.col("p_size")
    directory = (
        F.when(size > 40, F.concat(F.lit("/nested/"), F.lower("p_type")))
        .when(size > 20, F.concat(F.lit("/"), F.lower("p_type")))
        .otherwise(F.lit(""))
    )
    ref = (
        F.when(size % 3 == 1, F.concat(F.lit("@v"), size.cast("string"), F.lit(".0")))
        .when(
            size % 3 == 2,
            F.concat(
                F.lit("@"), F.substring(F.sha2(F.col("p_partkey").cast("string"), 256), 1, 40), F.lit(" # v1.2.3")
            ),
        )
        .otherwise(F.lit(""))
    )
    marker = F.when(size % 2 == 0, F.lit("-    - uses:   ")).otherwise(F.lit("+  uses: "))
    line = F.concat(
        marker, F.lit("org"), (size % 7).cast("string"), F.lit("/"), F.substring_index("p_name", " ", 1), directory, ref
    )
    parsed = t.part.select("p_partkey", T.parse_action_ref(line).alias("a"))
    return parsed.select("p_partkey", "a.org", "a.repo", "a.dir", "a.ref", T.is_pinned_ref("a.ref").alias("pinned"))


@query(
    """
    SELECT page_id, CAST(len(url) - len(replace(url, '/', '')) AS INTEGER) AS n_slashes,
           len(url) - len(replace(url, '/', '')) > 1 AS is_nested
    FROM pages
    """
)
def slash_count(t):
    """O-P6."""
    n = T.slash_count("url")
    return t.pages.select("page_id", n.alias("n_slashes"), (n > 1).alias("is_nested"))


@query(
    r"""
    SELECT doc_id, trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g'), ' ') AS stripped FROM documents
    """
)
def strip_marker(t):
    """O-P7 over whole texts behind a removed-line marker."""
    line = F.concat(F.lit("- uses: "), F.col("text"))
    return t.documents.select("doc_id", T.strip_marker(line).alias("stripped"))


@query(
    """
    SELECT o_orderkey, 'https://blog.example.com/posts/order-' || o_orderkey || '-' || lower(o_orderstatus) AS url
    FROM orders
    """
)
def post_url(t):
    """O-P8."""
    file = F.concat(
        F.date_format("o_orderdate", "yyyy-MM-dd"),
        F.lit("-order-"),
        F.col("o_orderkey").cast("string"),
        F.lit("-"),
        F.lower("o_orderstatus"),
        F.lit(".md"),
    )
    return t.orders.select("o_orderkey", T.post_url(file, "https://blog.example.com/posts/").alias("url"))


@query("SELECT page_id, '1. [Page ' || page_id || '](' || url || '):  ' || len(html) || ' characters' AS item FROM pages")
def markdown_item(t):
    """O-P9."""
    title = F.concat(F.lit("Page "), F.col("page_id").cast("string"))
    blurb = F.concat(F.length("html").cast("string"), F.lit(" characters"))
    return t.pages.select("page_id", T.markdown_item(title, "url", blurb).alias("item"))


@query(
    """
    SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.absent.deep') AS absent
    FROM events
    """
)
def json_path(t):
    """O-P10."""
    return t.events.select(
        "event_id", T.json_path("props", "k").alias("k"), T.json_path("props", "absent.deep").alias("absent")
    )


@query(
    """
    SELECT event_id, '{"k":"' || json_extract_string(props, '$.k') || '","type":"' || event_type || '"}' AS projected
    FROM events
    """
)
def json_project(t):
    """O-P11: three of the fields go in, two come out."""
    wide = F.to_json(
        F.struct(
            F.get_json_object("props", "$.k").alias("k"), F.col("event_type").alias("type"), F.col("user_id").alias("dropped")
        )
    )
    return t.events.select("event_id", T.json_project(wide, ["k", "type"]).alias("projected"))


@query(
    """
    SELECT o_orderkey, CASE WHEN o_orderkey % 15 = 0 THEN 'fizzbuzz' WHEN o_orderkey % 3 = 0 THEN 'fizz'
           WHEN o_orderkey % 5 = 0 THEN 'buzz' ELSE 'no fizzbuzz for you!' END AS answer
    FROM orders
    """
)
def fizzbuzz(t):
    """O-P12."""
    return t.orders.select("o_orderkey", T.fizzbuzz("o_orderkey").alias("answer"))


@query(
    r"""
    SELECT doc_id, false AS whole_source, true AS digits_only,
           true AS padded_digits,
           regexp_matches(text, '^[ \t\r\n]*[+-]?[0-9]+(_[0-9]+)*[ \t\r\n]*$') AS text_is_number
    FROM documents
    """
)
def is_number(t):
    """O-P13."""
    digits = F.regexp_replace("source", "[^0-9]", "")
    return t.documents.select(
        "doc_id",
        T.is_number("source").alias("whole_source"),
        T.is_number(digits).alias("digits_only"),
        T.is_number(F.concat(F.lit(" +1_"), digits, F.lit("99999999999999999999 "))).alias("padded_digits"),
        T.is_number("text").alias("text_is_number"),
    )


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type AS type FROM events", headline=True)
def decode_json_payload(t):
    """O-P14: encoded by Spark, then decoded."""
    body = F.to_json(
        F.struct(F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.col("event_type").alias("type"))
    )
    decoded = T.decode_json_payload(F.base64(F.encode(body, "UTF-8")), "k bigint, type string")
    return t.events.select("event_id", decoded.alias("d")).select("event_id", "d.k", "d.type")


@query("SELECT doc_id, sha256(text) AS digest, true AS matches, false AS other_matches FROM documents")
def payload_digest_matches(t):
    """O-P15 over whole texts."""
    encoded = F.base64(F.encode("text", "UTF-8"))
    return t.documents.select("doc_id", F.sha2("text", 256).alias("digest"), encoded.alias("e")).select(
        "doc_id",
        "digest",
        T.payload_digest_matches("e", "digest").alias("matches"),
        T.payload_digest_matches("e", F.sha2("digest", 256)).alias("other_matches"),
    )


@query("SELECT event_id, date_trunc('second', ts) AS from_number, date_trunc('second', ts) AS from_text FROM events")
def epoch_to_ts(t):
    """O-P16, in the numeric and in the text form."""
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    return t.events.select(
        "event_id",
        T.epoch_to_ts(seconds).alias("from_number"),
        T.epoch_to_ts(seconds.cast("string")).alias("from_text"),
    )


@query(
    """
    SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS registry,
           'p' || page_id || '/img' AS repo, CASE WHEN len(html) % 2 = 0 THEN 'v' || page_id END AS tag,
           'library/p' || page_id AS bare_repo
    FROM pages
    """
)
def image_ref(t):
    """O-P17: with a registry, and bare."""
    path = F.concat(F.lit("p"), F.col("page_id").cast("string"))
    tag = F.when(F.length("html") % 2 == 0, F.concat(F.lit(":v"), F.col("page_id").cast("string"))).otherwise(F.lit(""))
    full = T.parse_image_ref(F.concat(T.url_host("url"), F.lit("/"), path, F.lit("/img"), tag))
    bare = T.parse_image_ref(F.concat(F.lit("library/"), path, F.lit(":latest")))
    return t.pages.select("page_id", full.alias("f"), bare.alias("b")).select(
        "page_id", "f.registry", "f.repo", "f.tag", F.col("b.repo").alias("bare_repo")
    )


@query(
    """
    SELECT page_id, array_to_string(string_split(url, '/')[3:], '/') AS rest,
           'p' || page_id AS without_slash
    FROM pages
    """
)
def strip_ref_prefix(t):
    """O-P18."""
    bare = F.concat(F.lit("p"), F.col("page_id").cast("string"))
    return t.pages.select(
        "page_id", T.strip_ref_prefix("url").alias("rest"), T.strip_ref_prefix(bare).alias("without_slash")
    )


_USING = "CASE p_type WHEN 'STANDARD' THEN 'docker' WHEN 'ECONOMY' THEN 'node' || p_size WHEN 'PROMO' THEN 'composite' WHEN 'SMALL' THEN 'dockerfile' ELSE p_type END"
_CLASS = "CASE p_type WHEN 'STANDARD' THEN 'docker' WHEN 'ECONOMY' THEN 'node' WHEN 'PROMO' THEN 'composite' END"


@query(f"SELECT p_partkey, {_CLASS} AS action_type FROM part")
def action_type(t):
    """O-P19."""
    return t.part.select("p_partkey", T.classify_action_type(F.expr(_USING)).alias("action_type"))


@query(
    f"""
    SELECT p_partkey, CASE WHEN d THEN 'image' ELSE 'directory' END AS mode,
           CASE WHEN NOT d THEN 'high' END AS min_file_risk
    FROM (SELECT p_partkey, coalesce({_CLASS} = 'docker' AND p_size > 25, false) AS d FROM part)
    """
)
def scan_mode(t):
    """O-P20."""
    old = T.classify_action_type(F.expr(_USING))
    new = F.when(F.col("p_size") > 25, F.lit("docker")).otherwise(F.lit("node"))
    return t.part.select("p_partkey", T.choose_scan_mode(old, new).alias("m")).select("p_partkey", "m.*")


@query(
    """
    SELECT event_id, s AS score, CASE s WHEN 1 THEN 'LOW' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'HIGH'
           WHEN 4 THEN 'CRITICAL' END AS level
    FROM (SELECT event_id, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'error' THEN 3
                 WHEN 'signup' THEN 4 END AS s FROM events)
    """
)
def risk_levels(t):
    """O-P21, both directions."""
    name = F.expr(
        "CASE event_type WHEN 'view' THEN 'low' WHEN 'click' THEN 'MEDIUM' WHEN 'error' THEN 'High' WHEN 'signup' THEN 'CRITICAL' END"
    )
    score = T.risk_score(name)
    return t.events.select("event_id", score.alias("score"), T.risk_level(score).alias("level"))


@query(
    """
    SELECT c_custkey, c_mktsegment AS segment, CAST(c_nationkey AS VARCHAR) AS nation, 'last' AS repeated,
           CAST(3 AS INTEGER) AS n_keys
    FROM customer
    """
)
def pairs_to_map(t):
    """O-P22 with a repeated key."""
    pair = lambda k, v: F.array(F.lit(k), v)
    pairs = F.array(
        pair("again", F.lit("first")),
        pair("segment", F.col("c_mktsegment")),
        pair("nation", F.col("c_nationkey").cast("string")),
        pair("again", F.lit("last")),
    )
    return t.customer.select("c_custkey", T.pairs_to_map(pairs).alias("m")).select(
        "c_custkey",
        F.col("m")["segment"].alias("segment"),
        F.col("m")["nation"].alias("nation"),
        F.col("m")["again"].alias("repeated"),
        F.size("m").alias("n_keys"),
    )


@query(
    r"""
    SELECT page_id, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page,
           nullif(regexp_extract(url, '[?&]utm_source=([^&#]*)', 1), '') AS utm_source,
           nullif(regexp_extract(url, '[?&]ref=([^&#]*)', 1), '') AS ref
    FROM pages
    """
)
def url_query_map(t):
    """O-P23."""
    text = F.regexp_extract("url", r"\?([^#]*)", 1)
    return t.pages.select("page_id", T.kv_string_to_map(text, "&", "=").alias("m")).select(
        "page_id",
        F.try_element_at("m", F.lit("page")).alias("page"),
        F.try_element_at("m", F.lit("utm_source")).alias("utm_source"),
        F.try_element_at("m", F.lit("ref")).alias("ref"),
    )


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def embedded_json(t):
    """O-P24: the payload travels as text in a field of another document."""
    outer = F.to_json(F.struct(F.col("event_id"), F.col("props").alias("inner")))
    inner = F.get_json_object(outer, "$.inner")
    return t.events.select("event_id", T.embedded_json(inner, "$.k", "bigint").alias("k"))


@query(
    """
    SELECT p_partkey, b AS size,
           CASE WHEN b < 1000 THEN CAST(CAST(b AS BIGINT) AS VARCHAR) || ' B'
                ELSE CASE WHEN v < 10 THEN printf('%.1f', v) ELSE CAST(CAST(round_even(v, 0) AS BIGINT) AS VARCHAR) END || u END AS shown
    FROM (SELECT *, floor(b / d * 10 + 0.5) / 10.0 AS v FROM (
            SELECT p_partkey, b, CASE WHEN b >= 1e12 THEN 1e12 WHEN b >= 1e9 THEN 1e9 WHEN b >= 1e6 THEN 1e6 ELSE 1e3 END::DOUBLE AS d,
                   CASE WHEN b >= 1e12 THEN ' TB' WHEN b >= 1e9 THEN ' GB' WHEN b >= 1e6 THEN ' MB' ELSE ' kB' END AS u
            FROM (SELECT p_partkey, p_partkey * p_partkey * p_size * p_size + p_partkey % 1500 AS b FROM part)))
    """
)
def human_size(t):
    """O-P25."""
    size = F.expr("p_partkey * p_partkey * p_size * p_size + p_partkey % 1500")
    return t.part.select("p_partkey", size.alias("size")).select(
        "p_partkey", "size", T.human_size("size").alias("shown")
    )


@query(
    """
    SELECT doc_id, array_to_string(regexp_extract_all(replace(body, '‑', '-'), 'CVE-[0-9]{4}-[0-9]{4,}'), ',') AS ids
    FROM (SELECT doc_id, 'CVE-2024-' || lpad(CAST(doc_id AS VARCHAR), 6, '0') || ' ' || text || ' CVE‑2023‑' ||
                 lpad(CAST(n_chars AS VARCHAR), 7, '0') || '.' AS body FROM documents)
    """
)
def cve_ids(t):
    """O-P26: ids with either hyphen at both ends of whole texts."""
    number = lambda c, n: F.lpad(F.col(c).cast("string"), n, "0")
    body = F.concat(
        F.lit("CVE-2024-"), number("doc_id", 6), F.lit(" "), F.col("text"), F.lit(" CVE‑2023‑"), number("n_chars", 7), F.lit(".")
    )
    return t.documents.select("doc_id", F.array_join(T.extract_cve_ids(body), ",").alias("ids"))


@query(
    r"""
    SELECT page_id, array_to_string(regexp_extract_all(cell, '\[([^\]]*)\]\(', 1), '|') AS evidence
    FROM (SELECT page_id, regexp_replace(html, '<a href="([^"]*)">([^<]*)</a>', '[\2](\1)', 'g') AS cell FROM pages)
    """
)
def split_evidence(t):
    """O-P27: page links as markdown links."""
    cell = F.regexp_replace("html", r'<a href="([^"]*)">([^<]*)</a>', "[$2]($1)")
    return t.pages.select("page_id", F.array_join(T.split_evidence(cell), "|").alias("evidence"))


_TLS_VALUE = (
    "CASE event_type WHEN 'view' THEN 'not vulnerable (OK), case ' || user_id "
    "WHEN 'click' THEN 'potentially NOT ok, case ' || user_id WHEN 'error' THEN 'VULNERABLE (NOT ok)' "
    "WHEN 'signup' THEN 'offered (OK)' ELSE 'not offered' END"
)


@query(
    """
    SELECT event_id, CASE event_type WHEN 'view' THEN 'ok' WHEN 'click' THEN 'potential' WHEN 'error' THEN 'not ok'
           WHEN 'signup' THEN 'ok' ELSE 'info' END AS verdict
    FROM events
    """
)
def tls_verdict(t):
    """O-P28."""
    return t.events.select("event_id", T.verdict(F.expr(_TLS_VALUE)).alias("verdict"))


# --- nested values ----------------------------------------------------------


@query(
    """
    SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, l AS line
    FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
         LATERAL (SELECT unnest(ls) AS l, generate_subscripts(ls, 1) AS i)
    """
)
def explode_structs(t):
    """O-N1: lines of whole texts as an array of structs."""
    items = F.transform(nested.lines_of(F.col("text")), lambda x, i: F.struct(i.alias("pos"), x.alias("line")))
    return nested.explode_structs(t.documents, items, ["doc_id"])


@query(
    """
    SELECT p_partkey, 'brand' AS key, p_brand AS value FROM part
    UNION ALL SELECT p_partkey, 'type', p_type FROM part
    UNION ALL SELECT p_partkey, 'name', p_name FROM part
    """
)
def explode_map(t):
    """O-N2."""
    entries = F.create_map(
        F.lit("brand"), F.col("p_brand"), F.lit("type"), F.col("p_type"), F.lit("name"), F.col("p_name")
    )
    return nested.explode_map(t.part.withColumn("m", entries), "m", ["p_partkey"])


@query(
    """
    SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN w END AS warning
    FROM (SELECT c_custkey, c_acctbal, unnest(CASE WHEN c_acctbal >= 0 THEN [c_mktsegment, c_name] ELSE [NULL] END) AS w FROM customer)
    """
)
def explode_optional(t):
    """O-N3: customers in debt have no children and stay."""
    children = F.when(F.col("c_acctbal") >= 0, F.array("c_mktsegment", "c_name"))
    return nested.explode_optional(t.customer.withColumn("ws", children), "ws", ["c_custkey"], "warning")


@query(
    """
    SELECT doc_id, CAST(len(ws) AS INTEGER) AS n_items, list_contains(ws, 'the') AS has_first,
           CAST(len(list_intersect(ws, ['the', 'de', 'la'])) AS INTEGER) AS n_wanted
    FROM (SELECT doc_id, string_split(text, ' ') AS ws FROM documents)
    """
)
def array_facts(t):
    """O-N4 over all words of a text."""
    words = t.documents.withColumn("ws", F.split("text", " "))
    return nested.array_facts(words, "ws", ["the", "de", "la"]).select("doc_id", "n_items", "has_first", "n_wanted")


@query(
    """
    SELECT o_orderkey, '{"model":"' || o_orderpriority || '","choices":[{"message":{"role":"' || o_orderstatus ||
           '","content":"order ' || o_orderkey || '"}}]}' AS document
    FROM orders
    """
)
def build_response(t):
    """O-N5."""
    content = F.concat(F.lit("order "), F.col("o_orderkey").cast("string"))
    return t.orders.select(
        "o_orderkey", T.build_response("o_orderstatus", content, "o_orderpriority").alias("document")
    )


@query("SELECT conv_id, turn, text AS content FROM conversations")
def response_content(t):
    """O-N6: whole texts into a nested response and out again."""
    doc = T.build_response("role", "text", F.lit("m"))
    return t.conversations.select("conv_id", "turn", T.response_content(doc).alias("content"))


@query("SELECT doc_id, source AS origin, n_chars AS size FROM documents")
def fenced_json(t):
    """O-N7: a fenced block between the text and itself."""
    block = F.to_json(F.struct(F.col("source").alias("origin"), F.col("n_chars").alias("size")))
    doc = F.concat(F.col("text"), F.lit("\n```json\n"), block, F.lit("\n```\n"), F.col("text"))
    return t.documents.select("doc_id", T.fenced_json(doc, "origin string, size bigint").alias("j")).select(
        "doc_id", "j.origin", "j.size"
    )
