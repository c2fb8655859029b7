"""Sources and sinks."""

from tessera.sources.readers import (  # noqa: F401
    PANDAS_NA_TOKENS,
    allowed_file,
    ensure_rows,
    infer_types,
    normalize_missing,
    read_csv,
    read_fixture,
    read_table,
    validate_upload,
)
