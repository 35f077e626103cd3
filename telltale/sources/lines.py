"""Line-oriented text formats.

``read_lines`` numbers lines without reading a file as one record, so a single
huge file is still split over many tasks. Every parser takes rows of
(path, line_no, line), from that reader or from anywhere else; only formats
with a carried heading need the line order, and they use blocked scans.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from telltale.functions import kv_string_to_map, shell_words, split_evidence
from telltale.operators.ordered import BLOCK, carry_forward, counts_since, line_block
from telltale.operators.windows import flag_ambiguous, glue_lines
from telltale.session import cut

LINES = "path string, line_no bigint, line string"
DOCUMENTS = "path string, content string"


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def read_lines(spark: SparkSession, path: str, numbered: bool = True) -> DataFrame:
    """Rows (path, line_no, line), numbered from 1 in file order.

    ``numbered=False`` leaves the number NULL and needs no second pass; it is
    enough for formats in which every line stands alone.

    Rows of one split come in file order with consecutive positions, so a number
    is the row's position less that of the split's first row plus the length of
    the splits before it: one small row per split, and no window over lines. The
    lines are written once, which fixes the split bounds.
    """
    raw = (
        spark.read.option("recursiveFileLookup", "true")
        .option("lineSep", "\n")
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias(BLOCK),
            F.monotonically_increasing_id().alias("_pos"),
            F.regexp_replace("value", "\r$", "").alias("line"),
        )
    )
    if not numbered:
        return raw.select("path", F.lit(None).cast("bigint").alias("line_no"), "line")
    fixed = cut(raw)
    splits = fixed.groupBy("path", BLOCK).agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_lines"))
    earlier = W.partitionBy("path").orderBy(BLOCK).rowsBetween(W.unboundedPreceding, -1)
    starts = splits.select("path", BLOCK, (F.coalesce(F.sum("_lines").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    placed = fixed.join(starts, ["path", BLOCK])
    return placed.select("path", (F.col("_pos") + F.col("_shift") + 1).alias("line_no"), "line")


def read_documents(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """One row (path, content) per file; a missing path reads as no rows.

    For documents that are one record each, such as a JSON report. Line formats
    go through ``read_lines``.
    """
    try:
        raw = (
            spark.read.option("recursiveFileLookup", "true")
            .option("pathGlobFilter", glob)
            .text(path, wholetext=True)
        )
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty(spark, DOCUMENTS)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def read_log_sample(spark: SparkSession, path: str, n: int = 20) -> DataFrame:
    """Lines of the first ``n`` files by path; one placeholder row if there is no folder.

    File names are listed without opening the files, then only the chosen ones
    are read, as splittable lines. Unreadable files are skipped.
    """
    try:
        names = (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", "true")
            .load(path)
            .select("path")
            .orderBy("path")
            .limit(n)
        )
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([(None, "(no logs provided)")], "path string, line string")
    chosen = [row["path"] for row in names.collect()]
    if not chosen:
        return empty(spark, "path string, line string")
    return (
        spark.read.option("ignoreCorruptFiles", "true")
        .option("ignoreMissingFiles", "true")
        .text(chosen)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))
    )


def first_documents(df: DataFrame, order: str, n: int = 20) -> DataFrame:
    """The sampling step for logs that already are rows."""
    return df.orderBy(order).limit(n)


def _group(text: str, pattern: str, index: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, index), F.lit(""))


SEP = "\u0001"


def _groups(text: str, pattern: str, n: int) -> Column:
    """Groups 1 to ``n`` of an anchored pattern that the text is known to fit, as an array.

    One replacement writes all groups between separators, where separate
    extractions would match once per group. Text that holds the separator
    itself takes the latter way.
    """
    at_once = F.split(F.regexp_replace(text, pattern, SEP.join(f"${i}" for i in range(1, n + 1))), SEP)
    one_by_one = F.array(*(F.regexp_extract(text, pattern, i) for i in range(1, n + 1)))
    return F.when(F.contains(F.col(text), F.lit(SEP)), one_by_one).otherwise(at_once)


def _part(i: int) -> Column:
    return F.col("_g")[i - 1]


def _optional(i: int) -> Column:
    return F.nullif(_part(i), F.lit(""))


# --- syscall traces ---------------------------------------------------------

TRACE = r"^(?:\[pid +\d+\] |\d+ +)?(?:\d\d:\d\d:\d\d(?:\.\d+)? |\d+\.\d+ )?(\w+)\((.*)\) += (\S+)(?: ([A-Z0-9]+) \([^)]*\))?.*$"


def parse_trace(lines: DataFrame) -> DataFrame:
    """(path, line_no, syscall, args, ret, errno) of whole calls, with or without a process and a clock; for others see ``trace_rejects``."""
    calls = lines.filter(F.col("line").rlike(TRACE)).withColumn("_g", _groups("line", TRACE, 4))
    return calls.select(
        "path",
        "line_no",
        _part(1).alias("syscall"),
        _part(2).alias("args"),
        _part(3).alias("ret"),
        _optional(4).alias("errno"),
    )


def trace_reason() -> Column:
    """Why a line is no whole call."""
    return (
        F.when(F.col("line").endswith("<unfinished ...>"), F.lit("unfinished"))
        .when(F.col("line").rlike(r"<\.\.\. \w+ resumed>"), F.lit("resumed"))
        .when(F.col("line").rlike(r"(\+\+\+|---) .* \1$"), F.lit("trailer or signal"))
        .otherwise(F.lit("no call"))
    )


def trace_rejects(lines: DataFrame) -> DataFrame:
    """(path, line_no, reason, line) of lines that are no whole calls; the halves of interrupted calls are not joined."""
    fits = F.coalesce(F.col("line").rlike(TRACE), F.lit(False))
    return lines.filter(~fits).select("path", "line_no", trace_reason().alias("reason"), "line")


# --- capability reports in markdown -----------------------------------------

HEADING = r"^## (\S+) ∴ (.+) \[\S+ ([A-Z]+)\]\s*$"
TABLE_HEAD = r"^\| *RISK *\| *KEY *\|"
TABLE_ROW = r"^\| ([A-Z]+) \| \[([^\]]*)\]\(([^)]*)\) \| (.*?) \| (.*?) ?\|\s*$"


def _under_heading(lines: DataFrame, wanted: str) -> DataFrame:
    """Headings and lines fitting ``wanted`` only, each with its heading's line and text.

    The first characters rule most lines out before a pattern is tried. What is left is written, so that the source is
    read and matched once and the scan over blocks goes through the written lines.
    """
    is_heading = F.col("line").startswith("## ") & F.col("line").rlike(HEADING)
    is_wanted = F.col("line").startswith("|") & F.col("line").rlike(wanted)
    kept = cut(lines.filter(is_heading | is_wanted).select("path", "line_no", "line"))
    kept = kept.select(
        "*",
        F.col("line").startswith("|").alias("_wanted"),
        F.when(
            F.col("line").startswith("#"), F.struct(F.col("line_no").alias("line_no"), F.col("line").alias("text"))
        ).alias("_mark"),
    )
    return carry_forward(kept, ["path"], ["line_no"], "_mark", "_mark", line_block("line_no"))


def _heading_columns() -> list[Column]:
    text = "_mark.text"
    return [
        F.col("_mark.line_no").alias("heading_line"),
        _group(text, HEADING, 1).alias("image"),
        _group(text, HEADING, 2).alias("file"),
        _group(text, HEADING, 3).alias("file_level"),
    ]


def parse_capability_md(lines: DataFrame) -> DataFrame:
    """One row per table row, with the image, file and level of the heading above it."""
    rows = _under_heading(lines, TABLE_ROW).filter("_wanted").withColumn("_g", _groups("line", TABLE_ROW, 5))
    return rows.select(
        F.col("path").alias("report"),
        "line_no",
        *_heading_columns(),
        _part(1).alias("risk"),
        _part(2).alias("key"),
        _part(3).alias("rule_url"),
        _part(4).alias("description"),
        split_evidence(_part(5)).alias("evidence"),
    )


def capability_headings(lines: DataFrame) -> DataFrame:
    """One row per heading with its number of tables and an ``ambiguous`` flag."""
    marked = _under_heading(lines, TABLE_HEAD).filter(F.col("_mark").isNotNull())
    rows = marked.select(F.col("path").alias("report"), "_wanted", *_heading_columns())
    return flag_ambiguous(rows, ["report", "heading_line", "image", "file", "file_level"], F.col("_wanted"))


# --- TLS reports ------------------------------------------------------------

SECTION = r"^ ((?:Testing|Running client simulations|Rating)\b.*)$"
# The key ends at the first wide gap; a line without one has a key of one word.
# A word in brackets behind the gap still belongs to the key.
SETTING = r"^ (?:(\S.*?(?: +\([a-z]+\)(?= {2,}))?) {2,}|(\S+) )(\S.*)$"
CONTINUED = r"^ {10,}\S"
PROTOCOL = r"^(SSLv[23]|TLSv1(?:\.[0-3])?)\b"
# The columns on the right have no blanks, so the exchange is what lies before them, with or without a number.
SUITE = r"^ (x[0-9a-f]+) +(\S+) +(\S.*?) +(\S+) +([0-9]+) +(\S+)\s*$"
CLIENT_HEAD = r"^ Browser +Protocol "
CLIENT = r"^ (\S.*?) {2,}(?:(TLSv1(?:\.[0-3])?|SSLv[23]) +(\S+) {2,}(\S.*)|No connection\s*)$"


def parse_tls_settings(lines: DataFrame) -> DataFrame:
    """(scan, section, line_no, position, key, value); continuation lines are joined to their key.

    Lines before the first section, such as the banner, are no settings. ``position`` as in ``glue_lines``.
    """
    is_section = F.col("line").rlike(SECTION)
    is_other = reduce(lambda a, b: a | b, (F.col("line").rlike(p) for p in (SUITE, CLIENT, CLIENT_HEAD, CONTINUED)))
    is_start = F.col("line").rlike(SETTING) & ~is_section & ~is_other
    is_more = F.col("line").rlike(CONTINUED)
    # Section and entry, with its key, are carried in one scan; a new section ends the entry above it.
    own_key = F.concat(F.regexp_replace(F.regexp_extract("line", SETTING, 1), " {2,}", " "), F.regexp_extract("line", SETTING, 2))
    start = F.struct(F.when(is_start, F.col("line_no")).alias("line_no"), F.when(is_start, own_key).alias("key"))
    # written, so that the patterns are tried once on every line
    kept = cut(
        lines.filter(is_section | is_start | is_more).select(
            "path",
            "line_no",
            "line",
            F.when(is_section, F.trim(F.regexp_extract("line", SECTION, 1))).alias("_section"),
            F.when(is_section | is_start, start).alias("_start"),
        )
    )
    placed = carry_forward(
        kept, ["path"], ["line_no"], ["_section", "_start"], ["section", "entry"], line_block("line_no")
    )
    body = placed.filter(F.col("_section").isNull() & F.col("section").isNotNull() & F.col("entry.line_no").isNotNull())
    merged = glue_lines(
        body.select("*", F.col("entry.line_no").alias("start_line"), F.col("entry.key").alias("entry_key")),
        ["path", "section", "start_line", "entry_key"],
        "line_no",
        "line",
    )
    # The value begins on the first line; what was glued behind it belongs to it. All rows have the key.
    head = F.col("position") == 0
    more = F.expr("substring(text, length(trim(first_line)) + 1)")
    first = F.regexp_extract("first_line", SETTING, 3)
    return merged.select(
        F.col("path").alias("scan"),
        "section",
        F.col("start_line").alias("line_no"),
        "position",
        F.col("entry_key").alias("key"),
        F.when(head, F.concat(F.rtrim(first), more)).otherwise(F.col("text")).alias("value"),
    )


def parse_tls_suites(lines: DataFrame) -> DataFrame:
    """(scan, protocol, hexcode, suite, key_exchange, encryption, bits, iana)."""
    is_protocol, is_suite = F.col("line").rlike(PROTOCOL), F.col("line").rlike(SUITE)
    protocol = F.when(is_protocol, F.regexp_extract("line", PROTOCOL, 1)).alias("_protocol")
    kept = cut(lines.filter(is_protocol | is_suite).select("path", "line_no", "line", protocol))
    placed = carry_forward(kept, ["path"], ["line_no"], "_protocol", "protocol", line_block("line_no"))
    suites = placed.filter(F.col("_protocol").isNull()).withColumn("_g", _groups("line", SUITE, 6))
    return suites.select(
        F.col("path").alias("scan"),
        "protocol",
        _part(1).alias("hexcode"),
        _part(2).alias("suite"),
        _part(3).alias("key_exchange"),
        _part(4).alias("encryption"),
        _part(5).cast("int").alias("bits"),
        _part(6).alias("iana"),
    )


def parse_tls_clients(lines: DataFrame) -> DataFrame:
    """(scan, client, protocol, suite, forward_secrecy); NULLs where no connection came about."""
    clients = lines.filter(F.col("line").rlike(CLIENT)).withColumn("_g", _groups("line", CLIENT, 4))
    return clients.select(
        F.col("path").alias("scan"),
        _part(1).alias("client"),
        _optional(2).alias("protocol"),
        _optional(3).alias("suite"),
        F.rtrim(_optional(4)).alias("forward_secrecy"),
    )


# --- lists, tagged lines, diffs ---------------------------------------------


HOST_NAME = r"^([a-z0-9_]([a-z0-9_-]*[a-z0-9_])?\.)+[a-z0-9-]+$"


def parse_domain_list(lines: DataFrame) -> DataFrame:
    """(path, line_no, domain, is_host); blank lines drop out, entries that are no names are flagged."""
    domain = F.lower(F.trim("line"))
    return lines.filter(F.trim("line") != "").select(
        "path",
        "line_no",
        domain.alias("domain"),
        domain.rlike(HOST_NAME).alias("is_host"),
    )


def parse_regex_list(lines: DataFrame) -> DataFrame:
    return lines.filter(F.trim("line") != "").select("path", "line_no", F.trim("line").alias("pattern"))


IMAGE_REF = (
    r"^[a-zA-Z0-9]+([._-]+[a-zA-Z0-9]+)*(:\d+)?(/[a-zA-Z0-9]+([._-]+[a-zA-Z0-9]+)*)*(:[A-Za-z0-9_][A-Za-z0-9_.-]{0,127})?(@sha256:[0-9a-f]{64})?$"
)
#: Words that stand alone on a line of a script.
SHELL_WORDS = ["do", "done", "else", "esac", "fi", "then"]
ARRAY_START = r"^\s*((declare|local|readonly|export)\s+(-\w+\s+)*)?\w+\+?=\("


def _image_ref_words(lines: DataFrame) -> DataFrame:
    """Lines with ``_refs``, the references in them, and ``_place``: list, array or script.

    A plain file has one reference a line. In a shell script, which its first line or an array tells, only the words of
    array literals are; the line that opens an array may hold some too, the one that closes it may not.
    """
    opens, closes = F.col("line").rlike(ARRAY_START), F.regexp_replace("line", "#.*$", "").contains(")")
    mark = F.when(opens, F.when(closes, F.lit("script")).otherwise(F.lit("array")))
    mark = mark.when(F.col("line").startswith("#!") | closes, F.lit("script"))
    placed = carry_forward(lines.select("path", "line_no", "line", mark.alias("_mark")), ["path"], ["line_no"], "_mark", "_after", line_block("line_no"))
    inside = F.coalesce(F.col("_after") == "array", F.lit(False)) | opens
    content = F.regexp_replace(F.regexp_replace("line", ARRAY_START, ""), r"\).*$", "")
    all_words = shell_words(F.when(inside, content).otherwise(F.col("line")))
    words = F.filter(all_words, lambda w: w.rlike(IMAGE_REF) & ~w.isin(*SHELL_WORDS))
    alone = F.size(all_words) == 1
    place = F.when(F.col("_after").isNull(), F.lit("list")).when(inside, F.lit("array")).otherwise(F.lit("script"))
    refs = F.when(inside, words).when(F.col("_after").isNull() & alone, words).otherwise(F.array().cast("array<string>"))
    return placed.withColumns({"_place": place, "_refs": refs}).drop("_mark", "_after")


def parse_image_refs(lines: DataFrame) -> DataFrame:
    """(path, line_no, ref) from lists of one reference a line and from array literals of shell scripts."""
    return _image_ref_words(lines).select("path", "line_no", F.explode("_refs").alias("ref"))


def parse_tagged_lines(lines: DataFrame, sep: str = ":") -> DataFrame:
    """(path, line_no, key, params, value) from ``KEY[;PARAM=x…]<sep>value``."""
    at = F.instr(F.col("line"), sep)
    head = F.expr(f"substring(line, 1, instr(line, '{sep}') - 1)")
    value = F.expr(f"substring(line, instr(line, '{sep}') + {len(sep)})")
    split_head = F.split(head, ";", 2)
    return lines.filter(at > 1).select(
        "path",
        "line_no",
        F.trim(split_head[0]).alias("key"),
        kv_string_to_map(F.coalesce(F.get(split_head, F.lit(1)), F.lit("")), ";", "=").alias("params"),
        F.trim(value).alias("value"),
    )


HUNK = r"^@@ -\d+(?:,(\d+))? \+\d+(?:,(\d+))? @@"


def _diff_kinds(lines: DataFrame) -> DataFrame:
    """Lines with ``_kind``: old or new for file headers, changed, context, hunk, or NULL for what is none of them.

    A hunk's header says how many old and new lines follow. As long as some are due, a line that begins like a file header
    is a changed one. Further signed lines count as changed too, as not all writers keep the counts.
    """
    starts = F.col("line").startswith
    due = lambda i: F.coalesce(_group("line", HUNK, i).cast("bigint"), F.lit(1)).alias(f"n{i}")
    both = starts(" ") | (F.col("line") == "")
    counted = lines.withColumns(
        {
            "_hunk": F.when(starts("@@ -") & F.col("line").rlike(HUNK), F.struct(F.col("line_no").alias("at"), due(1), due(2))),
            "_old": (both | starts("-")).cast("bigint"),
            "_new": (both | starts("+")).cast("bigint"),
        }
    )
    placed = counts_since(counted, ["path"], ["line_no"], "_hunk", ["_old", "_new"], ["_old", "_new"], line_block("line_no"))
    # the counts have this line in them
    old_due, new_due = (F.coalesce(F.col(f"_{side}") <= F.col(f"_hunk.n{i}"), F.lit(False)) for i, side in ((1, "old"), (2, "new")))
    kind = (
        F.when(F.col("_hunk.at") == F.col("line_no"), F.lit("hunk"))
        .when(starts("--- ") & ~old_due, F.lit("old"))
        .when(starts("+++ ") & ~new_due, F.lit("new"))
        # the signature that ends a mailed patch
        .when((F.col("line") == "-- ") & F.col("_hunk").isNotNull() & ~old_due, F.lit(None))
        .when(starts("+") | starts("-"), F.lit("changed"))
        .when(both & (old_due | new_due), F.lit("context"))
    )
    return placed.withColumn("_kind", kind).drop("_hunk", "_old", "_new")


def parse_diff(lines: DataFrame) -> DataFrame:
    """(path, file, line_no, sign, text) of changed lines, with the file of the header above; a deleted file has its old name.

    Whether a line is a header is settled first; headers and changes are written and scanned for the names, so the lines
    themselves go through one scan.
    """
    name = lambda kind, prefix: F.when(F.col("_kind") == kind, F.regexp_replace("line", prefix, ""))
    kept = cut(_diff_kinds(lines).filter(F.col("_kind").isin("old", "new", "changed")).select("path", "line_no", "line", "_kind"))
    named = kept.withColumns({"_file": name("new", r"^\+\+\+ (b/)?"), "_was": name("old", "^--- (a/)?")})
    placed = carry_forward(named, ["path"], ["line_no"], ["_file", "_was"], ["file", "was"], line_block("line_no"))
    return placed.filter(F.col("_kind") == "changed").select(
        "path",
        F.when(F.col("file") == "/dev/null", F.col("was")).otherwise(F.col("file")).alias("file"),
        "line_no",
        F.substring("line", 1, 1).alias("sign"),
        F.expr("substring(line, 2)").alias("text"),
    )


def diff_rejects(lines: DataFrame) -> DataFrame:
    """(path, line_no, line) of lines that are no header, hunk, change or line of context."""
    return _diff_kinds(lines).filter(F.col("_kind").isNull()).select("path", "line_no", "line")


def parse_posts(documents: DataFrame) -> DataFrame:
    """(file, title, excerpt, body, complete) from front matter; a missing key is NULL."""
    front = r"(?s)\A---[ \t]*\r?\n(.*?\r?\n)---[ \t]*(?:\r?\n|\z)"
    meta = F.regexp_extract("content", front, 1)
    entry = lambda key: F.nullif(
        F.regexp_extract(meta, rf'(?m)^{key}:[ \t]*"?(.*?)"?[ \t]*\r?$', 1), F.lit("")
    )
    out = documents.select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("file"),
        entry("title").alias("title"),
        entry("excerpt").alias("excerpt"),
        F.regexp_replace("content", front, "").alias("body"),
    )
    return out.withColumn("complete", F.col("title").isNotNull() & F.col("excerpt").isNotNull())
