"""Column functions: built-in expressions only, so they stay in generated code."""

from telltale.functions.payload import (
    build_response,
    decode_json_payload,
    embedded_json,
    epoch_to_ts,
    fenced_json,
    json_path,
    json_project,
    offset_to_ts,
    payload_digest_matches,
    response_content,
)
from telltale.functions.rates import default_missing, fmt2, sentinel_to_zero, token_rate
from telltale.functions.refs import (
    is_pinned_ref,
    markdown_item,
    parse_action_ref,
    parse_image_ref,
    parse_pin,
    post_url,
    slash_count,
    strip_marker,
    strip_ref_prefix,
)
from telltale.functions.risk import (
    choose_scan_mode,
    classify_action_type,
    risk_level,
    risk_score,
    verdict,
)
from telltale.functions.shell import layer_files, shell_commands, shell_words
from telltale.functions.text import (
    extract_cve_ids,
    extract_ids,
    fizzbuzz,
    glob_to_regex,
    human_size,
    is_number,
    kv_string_to_map,
    pairs_to_map,
    split_evidence,
    url_host,
    url_path,
)

__all__ = [name for name in dir() if not name.startswith("_")]
