"""SQL oracles: target guess, problem types, target analysis, quick type, config validation."""

from __future__ import annotations

from tessera.plans.catalog_target import VALIDATION_RATIOS, VALIDATION_TYPES
from tessera.plans.fixtures import LINEITEM_GAPS_COLUMNS, TABLE_COLUMNS, TABLES
from tessera.plans.oracle import ORACLE, _clean, _gaps_cte, _missing, pct2_sql

TARGET_NAMES_SQL = "('target', 'label', 'class', 'y', 'output', 'prediction', 'outcome', 'diagnosis')"
Q = "'"


def stats_union(src: str, cols: list[tuple[str, str]]) -> str:
    parts = []
    for i, (c, k) in enumerate(cols):
        is_text = "true" if k == "str" else "false"
        loose = "true" if k in ("int", "float") else "false"
        if k == "array":
            present, uniq = f"count({c})", f"count(DISTINCT CAST({c} AS VARCHAR))"
        else:
            present, uniq = f"count_if(NOT {_missing(c, k)})", f"count(DISTINCT {_clean(c, k)})"
        parts.append(f"SELECT {i} AS idx, '{c}' AS name, {is_text} AS is_text, {loose} AS loose, "
                     f"{present} AS present, {uniq} AS uniq FROM {src}")
    return "\nUNION ALL ".join(parts)


def ptype_sql(loose: str, u: str) -> str:
    return (f"CASE WHEN {loose} AND {u} = 2 THEN 'binary' WHEN {loose} AND {u} > 2 AND {u} < 20 THEN 'multiclass' "
            f"WHEN {loose} THEN 'regression' WHEN {u} = 2 THEN 'binary' ELSE 'multiclass' END")


def _detect_sql(tbl: str) -> str:
    st = stats_union(tbl, TABLE_COLUMNS[tbl])
    return (
        f"SELECT '{tbl}' AS table_name, s.name AS target, {ptype_sql('s.loose', 's.uniq')} AS problem_type, "
        f"CAST(s.uniq AS BIGINT) AS unique_values FROM ({st}) s, (SELECT COALESCE("
        f"min(CASE WHEN lower(name) IN {TARGET_NAMES_SQL} AND present > 0 THEN idx END), "
        f"min(CASE WHEN (is_text OR uniq <= 10) AND present > 0 THEN idx END), "
        f"max(CASE WHEN present > 0 THEN idx END)) AS chosen FROM ({st})) p WHERE s.idx = p.chosen"
    )


ORACLE["detect_target"] = "\nUNION ALL ".join(_detect_sql(t) for t in TABLES)


def _problem_types_sql(name: str, src: str, cols) -> str:
    return (f"SELECT '{name}' AS table_name, CAST(idx AS INTEGER) AS column_idx, name AS column_name, "
            f"CAST(uniq AS BIGINT) AS unique_values, loose AS loose_numeric, "
            f"{ptype_sql('loose', 'uniq')} AS problem_type FROM ({stats_union(src, cols)})")


ORACLE["problem_type"] = (_gaps_cte() + _problem_types_sql("lineitem_gaps", "t", LINEITEM_GAPS_COLUMNS)
                          + "\nUNION ALL " + _problem_types_sql("orders", "orders", TABLE_COLUMNS["orders"]))

_SPARK_TYPE = ("CASE typeof({c}) WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' "
               "WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(typeof({c})) END")


def _analyze_sql() -> str:
    parts = []
    for c, k in LINEITEM_GAPS_COLUMNS:
        v = _clean(c, k)
        loose = "true" if k in ("int", "float") else "false"
        whole = f"COALESCE(bool_and(CAST({v} AS DOUBLE) = floor(CAST({v} AS DOUBLE))), true)" if k in (
            "int", "float") else "false"
        detected = (f"CASE WHEN {loose} AND count(DISTINCT {v}) <= 10 AND {whole} THEN 'classification' "
                    f"WHEN {loose} THEN 'regression' ELSE 'classification' END")
        sample = (f"(SELECT COALESCE(string_agg(CAST(v AS VARCHAR), ', ' ORDER BY l_orderkey, l_linenumber, v), '') "
                  f"FROM (SELECT l_orderkey, l_linenumber, {v} AS v FROM t WHERE {v} IS NOT NULL "
                  f"ORDER BY l_orderkey, l_linenumber, v LIMIT 10))")
        miss = f"count_if({_missing(c, k)})"
        parts.append(
            f"SELECT true AS success, CAST(NULL AS VARCHAR) AS error, '{c}' AS column_name, "
            f"CAST(count(DISTINCT {v}) AS BIGINT) AS unique_count, CAST({miss} AS BIGINT) AS missing_count, "
            f"CAST(count(*) AS BIGINT) AS total_rows, (SELECT {_SPARK_TYPE.format(c=c)} FROM t LIMIT 1) AS data_type, "
            f"{sample} AS sample_values, COALESCE({pct2_sql(miss, 'count(*)')}, 0.0) AS missing_pct, "
            f"{detected} AS detected_type, "
            f"CASE WHEN count(DISTINCT {v}) <= 10 THEN 'high' ELSE 'medium' END AS type_confidence FROM t"
        )
    return _gaps_cte() + "\nUNION ALL ".join(parts)


ORACLE["analyze_target"] = _analyze_sql()


def _quick_sql(tbl: str, key: str) -> str:
    parts = [f"SELECT {i} AS column_idx, '{c}' AS column_name, CAST({_clean(c, k)} AS VARCHAR) AS v FROM h"
             for i, (c, k) in enumerate(TABLE_COLUMNS[tbl])]
    st = "\nUNION ALL ".join(parts)
    num = "TRY_CAST(v AS DOUBLE)"
    return (
        f"SELECT '{tbl}' AS table_name, CAST(column_idx AS INTEGER) AS column_idx, column_name, "
        f"CAST(count(DISTINCT v) AS BIGINT) AS unique_values, CASE WHEN count(DISTINCT v) <= 10 AND "
        f"count_if({num} IS NOT NULL AND {num} <> floor({num})) = 0 THEN 'classification' "
        f"WHEN count_if({num} IS NULL) = 0 THEN 'regression' ELSE 'classification' END AS quick_type "
        f"FROM (WITH h AS (SELECT * FROM {tbl} ORDER BY {key} LIMIT 5) {st}) WHERE v IS NOT NULL AND v <> '' "
        f"GROUP BY column_idx, column_name"
    )


ORACLE["quick_type"] = "\nUNION ALL ".join(
    _quick_sql(t, k) for t, k in (("orders", "o_orderkey"), ("part", "p_partkey"), ("customer", "c_custkey")))

_PTYPES_OK = ("classification", "regression", "binary", "multiclass")


def _ratio_error_sql(r: str) -> str:
    try:
        ratio = float(r)
    except ValueError:
        return "'Split ratio must be a valid number'"
    return "NULL" if 0 < ratio < 1 else "'Split ratio must be between 0 and 1'"


def _validate_sql(name: str, src: str, cols) -> str:
    known_cols = {c for c, _ in cols}
    vals = []
    for c in [c for c, _ in cols] + ["missing_col"]:
        for p in VALIDATION_TYPES:
            for r in VALIDATION_RATIOS:
                vals.append(f"('{c}', '{p}', '{r}', {'true' if c in known_cols else 'false'}, "
                            f"{'true' if p in _PTYPES_OK else 'false'}, {_ratio_error_sql(r)})")
    grid = f"(VALUES {', '.join(vals)}) g(target, problem_type, split_ratio, known, type_ok, ratio_error)"
    st = stats_union(src, cols)
    types_text = "[" + ", ".join(f"{Q}{Q}{t}{Q}{Q}" for t in _PTYPES_OK) + "]"
    errs = [
        f"CASE WHEN NOT g.known THEN 'Target column {Q}{Q}' || g.target || '{Q}{Q} not found in dataset' "
        f"WHEN s.present = 0 THEN 'Target column {Q}{Q}' || g.target || '{Q}{Q} contains no valid values' END",
        f"CASE WHEN NOT g.type_ok THEN 'Invalid problem type {Q}{Q}' || g.problem_type || '{Q}{Q}. Must be one of "
        f"{types_text}' END",
        "g.ratio_error",
        "CASE WHEN n.n_rows < 10 THEN 'Dataset too small. Need at least 10 rows for training' END",
        "CASE WHEN g.known AND g.problem_type IN ('classification', 'binary', 'multiclass') AND s.uniq < 2 THEN "
        "'Classification requires at least 2 unique target values, found ' || CAST(s.uniq AS VARCHAR) END",
    ]
    arr = f"list_filter([{', '.join(errs)}], lambda x: x IS NOT NULL)"
    return (f"SELECT '{name}' AS table_name, g.target, g.problem_type, g.split_ratio, len({arr}) = 0 AS valid, "
            f"array_to_string({arr}, ' | ') AS errors FROM {grid} CROSS JOIN (SELECT count(*) AS n_rows FROM {src}) n "
            f"LEFT JOIN ({st}) s ON s.name = g.target")


ORACLE["validate_config"] = _gaps_cte() + "\nUNION ALL ".join([
    _validate_sql("region", "region", TABLE_COLUMNS["region"]),
    _validate_sql("supplier", "supplier", TABLE_COLUMNS["supplier"]),
    _validate_sql("lineitem_gaps", "t", LINEITEM_GAPS_COLUMNS),
])

from tessera.plans.catalog_target import SPLIT_RATIOS  # noqa: E402
from tessera.plans.oracle import md5_head_sql  # noqa: E402

ORACLE["split_summary"] = "\nUNION ALL ".join(
    f"SELECT CAST({r} AS DOUBLE) AS ratio, ({md5_head_sql(['l_orderkey', 'l_linenumber'])} % 10000) < "
    f"{int(round(r * 10000))} AS is_train, count(*) AS rows, CAST(trunc(CAST({r} AS DOUBLE) * 100) AS INTEGER) "
    f"AS train_pct, 100 - CAST(trunc(CAST({r} AS DOUBLE) * 100) AS INTEGER) AS test_pct FROM lineitem GROUP BY 2"
    for r in SPLIT_RATIOS
)
