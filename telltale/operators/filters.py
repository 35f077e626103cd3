"""Row filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telltale.functions import glob_to_regex, layer_files, risk_score
from telltale.functions.risk import RISK_RANKS

# The crypto policy.
MIN_KEY_BITS = 2048
ALLOWED_EXPONENTS = [1, 3, 17, 65537]
ALLOWED_HASHES = ["sha256", "sha384", "sha512"]

# Names of settings whose value is a credential.
SECRET_SETTING = r'(?i)((?:password|passwd|secret|token|api[_-]?key)[ \t]*[=:][ \t]*"?)([^ \t\r\n"]+)'

# Names of files that hold credentials.
SECRET_FILE = r"(?i)(^|/)([^/]*(secret|credential|passw)[^/]*|\.env(\.[^/]*)?|\.netrc|\.npmrc|\.pypirc|\.htpasswd|id_(rsa|dsa|ecdsa|ed25519)|[^/]*\.(pem|key|p12|pfx|jks|kdbx))$"


def skip_list(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    """Drop rows whose name is listed; an empty list filters nothing."""
    if not names:
        return df
    return df.filter(F.col(column).isNull() | ~F.col(column).isin(names))


def diff_lines(df: DataFrame, sign: str, needle: str = "uses:", text: str = "text") -> DataFrame:
    """Added or removed lines that contain ``needle``; expects (sign, text) columns."""
    return df.filter((F.col("sign") == sign) & F.col(text).contains(needle))


def min_risk(df: DataFrame, level: str, score: str = "risk_score") -> DataFrame:
    return df.filter(F.col(score) >= RISK_RANKS[level.upper()])


def min_risk_level(df: DataFrame, level: str, column: str = "risk_level") -> DataFrame:
    return df.filter(risk_score(column) >= RISK_RANKS[level.upper()])


def path_matches(path: Column, globs: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (path.rlike(glob_to_regex(g)) for g in globs))


def changed_path_match(df: DataFrame, paths: str, globs: list[str]) -> DataFrame:
    """Rows of which any changed path (string or array of strings) fits a glob."""
    if df.schema[paths].dataType.typeName() == "array":
        return df.filter(F.exists(paths, lambda p: path_matches(p, globs)))
    return df.filter(path_matches(F.col(paths), globs))


def event_type_in(df: DataFrame, column: str, types: list[str], **equals) -> DataFrame:
    """Listed event types, with further columns fixed to one value each."""
    out = df.filter(F.col(column).isin(types))
    for name, value in equals.items():
        out = out.filter(F.col(name) == value)
    return out


def seccomp_decision(
    calls: DataFrame, rules: DataFrame, on: str, default: str = "SCMP_ACT_ERRNO", errno: int = 1
) -> DataFrame:
    """The action for each call: the rule's when listed, else the default with its code.

    ``rules`` is reduced to one row per name first, so a repeated rule cannot
    multiply calls.
    """
    unique = rules.groupBy(on).agg(F.min("action").alias("_action"))
    joined = calls.join(unique, on, "left")
    return joined.select(
        *calls.columns,
        F.coalesce("_action", F.lit(default)).alias("decision"),
        F.when(F.col("_action").isNull(), F.lit(errno)).alias("decision_errno"),
    )


def domain_regex_block(df: DataFrame, column: str, patterns: list[str]) -> DataFrame:
    """Rows whose name matches any of a few patterns: one alternation, so one pass and no join. For a list that is a
    table see ``domain_pattern_block``."""
    if not patterns:
        return df.limit(0)
    return df.filter(F.col(column).rlike("|".join(f"(?:{p})" for p in patterns)))


#: Characters of the piece of text by which names and patterns meet.
ANCHOR = 3
_GAP, _DOT = "\u0001", "\u0002"


def literal_runs(pattern: Column) -> Column:
    """Runs of characters that whatever matches the pattern must contain, in lower case; empty for a pattern with
    alternatives outside groups, or one that is not understood."""
    p = F.regexp_replace(pattern, r"\\\.", _DOT)
    p = F.regexp_replace(p, r"\\([-_/:])", "$1")
    p = F.regexp_replace(p, r"\\.", _GAP)  # any other escape
    p = F.regexp_replace(p, r"\[\^?\]?[^\]]*\]", _GAP)
    for _ in range(6):  # groups from the inside; their content may be optional
        p = F.regexp_replace(p, r"\([^()]*\)", _GAP)
    p = F.regexp_replace(p, r"[\s\S](\?|\*|\{[^}]*\})[?+]?", _GAP)
    p = F.regexp_replace(p, r"(.)\+[?+]?", "$1" + _GAP)
    unclear = p.rlike(r"[()\[\]{}|\\]")
    runs = F.split(F.lower(F.replace(F.regexp_replace(p, r"[.^$]", _GAP), F.lit(_DOT), F.lit("."))), _GAP)
    return F.when(unclear, F.array().cast("array<string>")).otherwise(runs)


def _pieces(text: Column) -> Column:
    """All pieces of ANCHOR characters."""
    at = F.sequence(F.lit(1), F.length(text) - (ANCHOR - 1))
    pieces = F.transform(at, lambda i: F.substring(text, i, F.lit(ANCHOR)))
    return F.when(F.length(text) >= ANCHOR, pieces).otherwise(F.array().cast("array<string>"))


def domain_pattern_block(df: DataFrame, column: str, patterns: DataFrame, pattern: str = "pattern") -> DataFrame:
    """Rows whose name matches any pattern of a table, of any length.

    Distinct names and patterns meet by a piece of text that a match must contain: of a pattern's pieces the one that
    fewest names have, so no common piece becomes a hot key. The whole pattern is tried on these candidates only.
    Patterns without such a piece, as a rule few, become one alternation that Spark evaluates as a subquery and tries on
    every distinct name. Nothing is collected and no pair is formed without a common piece.
    """
    names = df.select(F.col(column).alias("_name")).filter(F.col(column).isNotNull()).distinct()
    known = patterns.select(F.col(pattern).alias("_pattern")).filter(F.col(pattern).isNotNull()).distinct()
    keyed = known.select("_pattern", F.array_distinct(F.flatten(F.transform(literal_runs(F.col("_pattern")), _pieces))).alias("_all"))
    pieces = names.select("_name", F.explode(F.array_distinct(_pieces(F.lower("_name")))).alias("_piece"))
    common = pieces.groupBy("_piece").agg(F.count(F.lit(1)).alias("_names"))
    # a piece that no name has ends the matter: an inner join would take the pattern's next one instead
    offers = keyed.select("_pattern", F.explode("_all").alias("_piece")).join(common, "_piece", "left")
    rarest = offers.groupBy("_pattern").agg(F.min(F.struct(F.coalesce("_names", F.lit(0)).alias("n"), "_piece")).alias("_r"))
    anchored = rarest.filter("_r.n > 0").select("_pattern", F.col("_r._piece").alias("_piece"))
    hit = pieces.join(anchored, "_piece").filter("_name RLIKE _pattern").select("_name")
    rest = keyed.filter(F.size("_all") == 0).agg(F.expr("listagg('(?:' || _pattern || ')', '|')").alias("p"))
    hit = hit.union(names.filter(F.rlike("_name", F.coalesce(rest.scalar(), F.lit("(?!)")))))
    blocked = hit.distinct().withColumnRenamed("_name", column)
    return df.join(blocked, column, "left_semi").select(*df.columns)


def failed_calls(df: DataFrame, errno: str = "errno") -> DataFrame:
    return df.filter(F.col(errno).isNotNull())


def crypto_policy(df: DataFrame, bits: str, exponent: str, hash_name: str) -> DataFrame:
    """Adds ``violations`` (joined text, empty when compliant), ``compliant`` and ``weak_exponent``.

    Exponent 1 is on the allowed list but encrypts nothing, hence the extra flag.
    """
    violations = F.concat_ws(
        ",",
        F.when(F.col(bits).isNull() | (F.col(bits) < MIN_KEY_BITS), F.lit("key_size")),
        F.when(F.col(exponent).isNull() | ~F.col(exponent).isin(ALLOWED_EXPONENTS), F.lit("exponent")),
        F.when(
            F.col(hash_name).isNull() | ~F.lower(hash_name).isin(ALLOWED_HASHES), F.lit("hash")
        ),
    )
    return (
        df.withColumn("violations", violations)
        .withColumn("compliant", F.col("violations") == "")
        .withColumn("weak_exponent", F.coalesce(F.col(exponent) == 1, F.lit(False)))
    )


def cert_validity(df: DataFrame, not_after: str, as_of: str, days: int) -> DataFrame:
    """Adds ``expired``, ``days_left`` and ``expires_within`` relative to a given instant."""
    instant = F.to_timestamp_ntz(F.lit(as_of))
    return (
        df.withColumn("expired", F.col(not_after) < instant)
        .withColumn("days_left", F.datediff(F.col(not_after), instant))
        .withColumn("expires_within", ~F.col("expired") & (F.col("days_left") < days))
    )


def cert_expired(df: DataFrame, not_after: str, as_of: str) -> DataFrame:
    return df.filter(F.col(not_after) < F.to_timestamp_ntz(F.lit(as_of)))


def weak_suites(df: DataFrame, suite: str, denied: list[str]) -> DataFrame:
    """Rows whose suite or curve name contains a denied algorithm as a whole word part."""
    pattern = "(^|[^A-Za-z0-9])(" + "|".join(denied) + ")([^A-Za-z0-9]|$)"
    return df.filter(F.col(suite).rlike(pattern))


def secret_lines(df: DataFrame, line: str) -> DataFrame:
    """Lines that set a credential or copy a file of credentials into an image.

    ``redacted`` keeps the names of settings and masks their values; ``secret_files`` are the files copied. A setting
    needs a ``=`` or ``:``, which is far cheaper to look for than the pattern, and a copy begins with its verb.
    """
    text = F.col(line)
    sets = (text.contains("=") | text.contains(":")) & text.rlike(SECRET_SETTING)
    copies = text.rlike(r"(?i)^\s*(/bin/sh -c #\(nop\)\s+)?(copy|add)\s")
    secret = lambda f: (f["action"] == "added") & f["source"].rlike(SECRET_FILE)
    files = F.transform(F.filter(layer_files(line), secret), lambda f: f["source"])
    found = df.filter(sets | copies).withColumn("secret_files", F.when(copies, files))
    found = found.withColumn("secret_files", F.coalesce("secret_files", F.array().cast("array<string>")))
    return found.filter(sets | (F.size("secret_files") > 0)).withColumn("redacted", F.regexp_replace(text, SECRET_SETTING, "$1***"))


def handshake_ok(text: Column) -> Column:
    """False when the negotiated cipher is ``(NONE)`` or ``0000``."""
    return ~text.rlike(r"Cipher(?: is|[ \t]*:)[ \t]*(?:\(NONE\)|0000)")
