"""JSON document formats.

Every parser takes rows with a ``content`` column (one document each, from
``read_documents`` or any table), keeps the columns named in ``keep`` and
returns typed rows. Schemas are explicit: objects keyed by path or digest are
maps, and text that does not parse yields no rows rather than an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telltale.functions import (
    decode_json_payload,
    embedded_json,
    epoch_to_ts,
    kv_string_to_map,
    offset_to_ts,
    pairs_to_map,
)
from telltale.sources.lines import read_documents


def _doc(df: DataFrame, schema: str, keep: list[str]) -> DataFrame:
    """The parsed document as ``d``.

    Filters on a projected expression are pushed below it together with a copy
    of it, which would parse a document once per filter. They do not pass a
    generator, so the one-element explode keeps it to a single parse.
    """
    parsed = F.explode_outer(F.array(F.from_json("content", schema)))
    return df.select(*keep, parsed.alias("d")).filter(F.col("d").isNotNull())


# --- exploited-vulnerability catalog ----------------------------------------

KEV = (
    "vulnerabilities array<struct<cveID:string,vendorProject:string,"
    "product:string,shortDescription:string>>"
)


def parse_kev(df: DataFrame) -> DataFrame:
    """(cve_id, vendor, product, description) per catalog entry."""
    return (
        _doc(df, KEV, [])
        .select(F.explode("d.vulnerabilities").alias("v"))
        .select(
            F.col("v.cveID").alias("cve_id"),
            F.col("v.vendorProject").alias("vendor"),
            F.col("v.product").alias("product"),
            F.col("v.shortDescription").alias("description"),
        )
    )


def read_kev(spark: SparkSession, path: str) -> DataFrame:
    """The catalog; a missing or broken file is an empty catalog."""
    return parse_kev(read_documents(spark, path))


# --- scanner findings (SARIF 2.1.0) -----------------------------------------

SARIF = (
    "runs array<struct<tool:struct<driver:struct<name:string,rules:array<struct<id:string,name:string,"
    "helpUri:string>>>>,results:array<struct<ruleId:string,ruleIndex:int,rule:struct<id:string,index:int>,level:string,message:struct<text:string>,"
    "locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,"
    "region:struct<startLine:int>>>>>>>>"
)


def parse_findings(df: DataFrame, keep: list[str]) -> DataFrame:
    """One row per result and location (a result without location keeps one row)."""
    results = (
        _doc(df, SARIF, keep)
        .select(*keep, F.posexplode("d.runs").alias("run_index", "run"))
        .select(*keep, "run_index", F.posexplode("run.results").alias("result_index", "r"), F.col("run.tool.driver.rules.id").alias("ids"))
        .select(*keep, "run_index", "result_index", "r", "ids", F.explode_outer("r.locations").alias("l"))
    )
    # A result names its rule, or gives its place among the rules of the run.
    place = F.coalesce("r.ruleIndex", "r.rule.index")
    rule = F.coalesce("r.ruleId", "r.rule.id", F.when(place >= 0, F.get("ids", place)))
    return results.select(
        *keep,
        "run_index",
        "result_index",
        rule.alias("rule_id"),
        F.coalesce("r.level", F.lit("warning")).alias("level"),
        F.col("r.message.text").alias("message"),
        F.col("l.physicalLocation.artifactLocation.uri").alias("uri"),
        F.col("l.physicalLocation.region.startLine").alias("start_line"),
    )


def level_severity(level: Column) -> Column:
    """A level as a number to rank by: error 3, warning 2, note 1, none 0; anything else NULL."""
    ranks = F.create_map(*[F.lit(x) for pair in (("error", 3), ("warning", 2), ("note", 1), ("none", 0)) for x in pair])
    return F.try_element_at(ranks, F.lower(level))


def parse_rules(df: DataFrame, keep: list[str]) -> DataFrame:
    """(run_index, rule_id, name, help_uri) per rule of every run."""
    return (
        _doc(df, SARIF, keep)
        .select(*keep, F.posexplode("d.runs").alias("run_index", "run"))
        .select(*keep, "run_index", F.explode("run.tool.driver.rules").alias("r"))
        .select(*keep, "run_index", F.col("r.id").alias("rule_id"), "r.name", F.col("r.helpUri").alias("help_uri"))
    )


def read_findings(spark: SparkSession, path: str) -> DataFrame:
    return parse_findings(read_documents(spark, path), ["path"])


# --- capability reports -----------------------------------------------------

CAPABILITY = (
    "Files map<string,struct<Path:string,SHA256:string,Size:bigint,Syscalls:array<string>,"
    "Pledge:array<string>,Behaviors:array<struct<Description:string,MatchStrings:array<string>,"
    "RiskScore:int,RiskLevel:string,RuleURL:string,ReferenceURL:string,RuleAuthor:string,ID:string,"
    "RuleName:string>>,RiskScore:int,RiskLevel:string>>"
)


def parse_capability(df: DataFrame, keep: list[str]) -> DataFrame:
    """One row per file and behavior; a file without behaviors keeps one row."""
    files = _doc(df, CAPABILITY, keep).select(*keep, F.explode("d.Files").alias("file", "f"))
    rows = files.select(*keep, "file", "f", F.explode_outer("f.Behaviors").alias("b"))
    return rows.select(
        *keep,
        "file",
        F.col("f.SHA256").alias("sha256"),
        F.col("f.Size").alias("size"),
        F.col("f.Syscalls").alias("syscalls"),
        F.col("f.RiskScore").alias("file_risk_score"),
        F.col("f.RiskLevel").alias("file_risk_level"),
        F.col("b.ID").alias("rule_id"),
        F.col("b.RuleName").alias("rule_name"),
        F.col("b.RuleURL").alias("rule_url"),
        F.col("b.RuleAuthor").alias("rule_author"),
        F.col("b.ReferenceURL").alias("reference_url"),
        F.col("b.Description").alias("description"),
        F.col("b.MatchStrings").alias("match_strings"),
        F.col("b.RiskScore").alias("risk_score"),
        F.col("b.RiskLevel").alias("risk_level"),
    )


def read_capability_json(spark: SparkSession, path: str) -> DataFrame:
    return parse_capability(read_documents(spark, path), ["path"])


# --- seccomp profiles -------------------------------------------------------

SECCOMP = (
    "defaultAction string, defaultErrnoRet int, archMap array<struct<architecture:string,"
    "subArchitectures:array<string>>>, syscalls array<struct<names:array<string>,action:string,comment:string>>"
)


def parse_seccomp_rules(df: DataFrame, keep: list[str]) -> DataFrame:
    """(name, action, comment) per listed syscall, with the profile's default."""
    return (
        _doc(df, SECCOMP, keep)
        .select(
            *keep,
            F.col("d.defaultAction").alias("default_action"),
            F.col("d.defaultErrnoRet").alias("default_errno"),
            F.inline("d.syscalls"),
        )
        .select(*keep, "default_action", "default_errno", F.explode("names").alias("name"), "action", "comment")
    )


def parse_seccomp_archs(df: DataFrame, keep: list[str]) -> DataFrame:
    """(architecture, sub_architecture), the latter NULL when there is none."""
    return (
        _doc(df, SECCOMP, keep)
        .select(*keep, F.inline("d.archMap"))
        .select(*keep, "architecture", F.explode_outer("subArchitectures").alias("sub_architecture"))
    )


# --- image slimming reports -------------------------------------------------

SLIM = (
    "source_image struct<size:bigint,labels:map<string,string>,env_vars:array<string>>,"
    "minified_image_size bigint, image_stack array<struct<is_top_image:boolean,new_size:bigint,"
    "instructions:array<struct<type:string,time:string,size:bigint,layer_index:int,command_all:string,"
    "inst_set_time_bucket:string,inst_set_time_index:int,inst_set_time_reverse_index:int>>>>"
)


def parse_slim_images(df: DataFrame, keep: list[str]) -> DataFrame:
    """Source and minified size of each report with the environment as a map."""
    return _doc(df, SLIM, keep).select(
        *keep,
        F.col("d.source_image.size").alias("source_size"),
        F.col("d.minified_image_size").alias("minified_size"),
        F.try_divide(
            F.col("d.source_image.size").cast("double"), F.col("d.minified_image_size").cast("double")
        ).alias("minified_by"),
        F.size("d.image_stack").alias("n_images"),
    )


def parse_slim_instructions(df: DataFrame, keep: list[str]) -> DataFrame:
    """One row per build instruction with its place in the stack."""
    return (
        _doc(df, SLIM, keep)
        .select(*keep, F.posexplode("d.image_stack").alias("image_pos", "image"))
        .select(*keep, "image_pos", F.posexplode("image.instructions").alias("pos", "i"))
        .select(
            *keep,
            "image_pos",
            "pos",
            F.col("i.type").alias("type"),
            offset_to_ts("i.time").alias("time"),
            F.col("i.size").alias("size"),
            F.col("i.layer_index").alias("layer_index"),
            F.col("i.command_all").alias("command_all"),
        )
    )


# --- signing records --------------------------------------------------------

SIGNATURES = (
    "array<struct<critical:struct<identity:struct<`docker-reference`:string>,"
    "image:struct<`docker-manifest-digest`:string>,type:string>,"
    "optional:struct<Bundle:struct<Payload:struct<body:string,integratedTime:bigint,logIndex:bigint,"
    "logID:string>>,Issuer:string,Subject:string>>>"
)


def parse_signatures(df: DataFrame, keep: list[str]) -> DataFrame:
    """One row per signature entry; times are epoch seconds."""
    payload = "s.optional.Bundle.Payload"
    return (
        df.select(*keep, F.explode(F.from_json("content", SIGNATURES)).alias("s"))
        .select(
            *keep,
            F.col("s.critical.image.docker-manifest-digest").alias("digest"),
            F.col("s.critical.identity.docker-reference").alias("reference"),
            F.col("s.optional.Issuer").alias("issuer"),
            F.col("s.optional.Subject").alias("subject"),
            F.col(f"{payload}.logIndex").alias("log_index"),
            F.col(f"{payload}.integratedTime").alias("integrated_time"),
            epoch_to_ts(F.col(f"{payload}.integratedTime")).alias("integrated_at"),
            F.col(f"{payload}.body").alias("body"),
        )
    )


DSSE = "payloadType string, payload string, signatures array<struct<keyid:string,sig:string>>"


def parse_dsse(df: DataFrame, keep: list[str], payload_schema: str) -> DataFrame:
    """Attestation envelopes with their decoded payload as a struct."""
    return _doc(df, DSSE, keep).select(
        *keep,
        F.col("d.payloadType").alias("payload_type"),
        F.col("d.payload").alias("payload"),
        decode_json_payload("d.payload", payload_schema).alias("statement"),
        F.size("d.signatures").alias("n_signatures"),
    )


TLOG = (
    "verificationMaterial struct<tlogEntries:array<struct<logIndex:string,integratedTime:string,"
    "canonicalizedBody:string>>>, dsseEnvelope struct<payload:string,payloadType:string>"
)


def parse_tlog(df: DataFrame, keep: list[str]) -> DataFrame:
    """Transparency-log entries; this format writes numbers as text."""
    return (
        _doc(df, TLOG, keep)
        .select(
            *keep,
            F.col("d.dsseEnvelope.payload").alias("payload"),
            F.explode("d.verificationMaterial.tlogEntries").alias("e"),
        )
        .select(
            *keep,
            F.col("e.logIndex").try_cast("bigint").alias("log_index"),
            F.col("e.integratedTime").try_cast("bigint").alias("integrated_time"),
            F.col("e.canonicalizedBody").alias("canonicalized_body"),
            "payload",
        )
    )


_SPDX = (
    "packages array<struct<SPDXID:string,name:string,versionInfo:string,supplier:string,"
    "checksums:array<struct<algorithm:string,checksumValue:string>>>>,"
    "relationships array<struct<spdxElementId:string,relatedSpdxElement:string,relationshipType:string>>"
)
#: A bill of materials by itself, or as the predicate of a statement.
SPDX = f"{_SPDX},predicate struct<{_SPDX.replace('packages array', 'packages:array').replace('relationships array', 'relationships:array')}>"


def parse_sbom_packages(df: DataFrame, keep: list[str]) -> DataFrame:
    return (
        _doc(df, SPDX, keep)
        .select(*keep, F.explode(F.coalesce("d.packages", "d.predicate.packages")).alias("p"))
        .select(
            *keep,
            F.col("p.SPDXID").alias("spdx_id"),
            F.col("p.name").alias("name"),
            F.col("p.versionInfo").alias("version_info"),
            F.col("p.supplier").alias("supplier"),
            F.col("p.checksums").alias("checksums"),
        )
    )


def parse_sbom_relationships(df: DataFrame, keep: list[str]) -> DataFrame:
    return (
        _doc(df, SPDX, keep)
        .select(*keep, F.explode(F.coalesce("d.relationships", "d.predicate.relationships")).alias("r"))
        .select(
            *keep,
            F.col("r.spdxElementId").alias("spdx_element_id"),
            F.col("r.relatedSpdxElement").alias("related_spdx_element"),
            F.col("r.relationshipType").alias("relationship_type"),
        )
    )


# --- image configs and manifests --------------------------------------------

IMAGE_CONFIG = (
    "config struct<Cmd:array<string>,Env:array<string>,Labels:map<string,string>,User:string>,"
    "history array<struct<created:string,created_by:string,comment:string,empty_layer:boolean>>,"
    "rootfs struct<diff_ids:array<string>>"
)
MANIFEST = (
    "array<struct<Config:string,RepoTags:array<string>,Layers:array<string>,"
    "LayerSources:map<string,struct<mediaType:string,size:bigint,digest:string>>>>"
)


def parse_image_layers(df: DataFrame, keep: list[str]) -> DataFrame:
    """(pos, created, created_by, diff_id) per layer.

    History and layer ids sit in one document, so they are paired by position
    there and need no join; history entries without a layer are left out.
    """
    with_layer = F.filter("d.history", lambda h: ~F.coalesce(h["empty_layer"], F.lit(False)))
    pairs = F.arrays_zip(with_layer.alias("h"), F.col("d.rootfs.diff_ids").alias("diff_id"))
    return (
        _doc(df, IMAGE_CONFIG, keep)
        .select(*keep, F.posexplode(pairs).alias("pos", "p"))
        .select(
            *keep,
            "pos",
            offset_to_ts("p.h.created").alias("created"),
            F.col("p.h.created_by").alias("created_by"),
            F.col("p.diff_id").alias("diff_id"),
        )
    )


def parse_manifest(df: DataFrame, keep: list[str]) -> DataFrame:
    """(pos, digest, media_type, size) per layer, the source looked up by digest in the same document."""
    digest = F.regexp_replace("layer", "^blobs/sha256/", "sha256:")
    return (
        df.select(*keep, F.explode(F.from_json("content", MANIFEST)).alias("m"))
        .select(*keep, "m", F.posexplode("m.Layers").alias("pos", "layer"))
        .select(*keep, "pos", digest.alias("digest"), F.try_element_at("m.LayerSources", digest).alias("s"))
        .select(*keep, "pos", "digest", F.col("s.mediaType").alias("media_type"), F.col("s.size").alias("size"))
    )


def parse_image_history(df: DataFrame, keep: list[str]) -> DataFrame:
    """(pos, created, created_by) per history entry."""
    return (
        _doc(df, IMAGE_CONFIG, keep)
        .select(*keep, F.posexplode("d.history").alias("pos", "h"))
        .select(
            *keep,
            "pos",
            offset_to_ts("h.created").alias("created"),
            F.col("h.created_by").alias("created_by"),
        )
    )


def parse_image_diff_ids(df: DataFrame, keep: list[str]) -> DataFrame:
    return _doc(df, IMAGE_CONFIG, keep).select(*keep, F.posexplode("d.rootfs.diff_ids").alias("pos", "diff_id"))


def parse_manifest_layers(df: DataFrame, keep: list[str]) -> DataFrame:
    """(pos, digest) per layer of the manifest."""
    return (
        df.select(*keep, F.explode(F.from_json("content", MANIFEST)).alias("m"))
        .select(*keep, F.posexplode("m.Layers").alias("pos", "layer"))
        .select(*keep, "pos", F.regexp_replace("layer", "^blobs/sha256/", "sha256:").alias("digest"))
    )


def parse_manifest_sources(df: DataFrame, keep: list[str]) -> DataFrame:
    """(digest, media_type, size) per layer source."""
    return (
        df.select(*keep, F.explode(F.from_json("content", MANIFEST)).alias("m"))
        .select(*keep, F.explode("m.LayerSources").alias("digest", "s"))
        .select(*keep, "digest", F.col("s.mediaType").alias("media_type"), F.col("s.size").alias("size"))
    )


# --- container daemon info --------------------------------------------------

DAEMON = (
    "ID string, Containers int, ContainersRunning int, ContainersPaused int, ContainersStopped int,"
    "Images int, DriverStatus array<array<string>>, SecurityOptions array<string>, MemTotal bigint,"
    "NCPU int, Plugins struct<Authorization:array<string>>, Warnings array<string>"
)


def parse_daemon_info(df: DataFrame, keep: list[str]) -> DataFrame:
    """Typed columns per host; pair lists and ``k=v`` texts become maps."""
    return _doc(df, DAEMON, keep).select(
        *keep,
        F.col("d.ID").alias("id"),
        F.col("d.Containers").alias("containers"),
        F.col("d.ContainersRunning").alias("running"),
        F.col("d.ContainersPaused").alias("paused"),
        F.col("d.ContainersStopped").alias("stopped"),
        F.col("d.Images").alias("images"),
        pairs_to_map("d.DriverStatus").alias("driver_status"),
        F.transform("d.SecurityOptions", lambda s: kv_string_to_map(s)).alias("security_options"),
        F.col("d.MemTotal").alias("mem_total"),
        F.col("d.NCPU").alias("ncpu"),
    )


def daemon_facts(df: DataFrame, keep: list[str]) -> DataFrame:
    """(key, value) rows over every top-level field, nested values as JSON text."""
    return df.select(*keep, F.explode(F.from_json("content", "map<string,string>")).alias("key", "value"))


def embedded_value(column: str, path: str, as_type: str = "string") -> Column:
    return embedded_json(column, path, as_type)
