"""Column-level building blocks: type classes and scalar expressions."""

from tessera.functions.types import (  # noqa: F401
    CATEGORICAL,
    NUMERIC,
    OTHER,
    column_class,
    column_classes,
    is_loose_numeric,
    missing_mask,
    normalized,
)
from tessera.functions.scalars import (  # noqa: F401
    escape_html,
    hash_bucket,
    json_safe_row,
    pct2,
    split_percentages,
    whole_number,
)
