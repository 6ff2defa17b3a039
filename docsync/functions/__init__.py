from docsync.functions.scalars import (
    byte_len,
    canonical_json,
    clean_id,
    collapse_ws,
    epoch,
    fingerprint,
    from_document,
    hash_int,
    hash_text,
    id_suffix,
    iso,
    minus_seconds,
    parse_date,
    run_id,
    to_document,
    zero_pad,
)

__all__ = [
    "byte_len", "canonical_json", "clean_id", "collapse_ws", "epoch", "fingerprint",
    "from_document", "hash_int", "hash_text", "id_suffix", "iso", "minus_seconds",
    "parse_date", "run_id", "to_document", "zero_pad",
]
