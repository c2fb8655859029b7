"""Independent DuckDB SQL for each registered query (the correctness oracle).

Written from the semantics, not from the Spark plans: plain aggregates,
``UNION ALL`` per column, window ranks.  Doubles that come out of different
summation orders are rounded to 6 places on both sides.
"""

from __future__ import annotations

from tessera.plans.fixtures import LINEITEM_GAPS_COLUMNS, LINEITEM_GAPS_SQL, TABLE_COLUMNS, TABLES

ORACLE: dict[str, str] = {}

_CLASS = {"int": "numeric", "float": "numeric", "str": "categorical", "ts": "other", "array": "other"}


def pct2_sql(m: str, n: str) -> str:
    """Exact half-even round(m / n * 100, 2) in integer arithmetic (matches ``pct2``)."""
    q = f"(CAST({m} AS BIGINT) * 10000 // CAST({n} AS BIGINT))"
    r = f"(CAST({m} AS BIGINT) * 10000 % CAST({n} AS BIGINT))"
    return (f"CASE WHEN CAST({n} AS BIGINT) > 0 THEN CAST({q} + CASE WHEN 2 * {r} > CAST({n} AS BIGINT) "
            f"OR (2 * {r} = CAST({n} AS BIGINT) AND {q} % 2 = 1) THEN 1 ELSE 0 END AS DOUBLE) / CAST(100 AS DOUBLE) END")


def _missing(c: str, kind: str) -> str:
    return f"({c} IS NULL OR isnan({c}))" if kind == "float" else f"({c} IS NULL)"


def _clean(c: str, kind: str) -> str:
    return f"(CASE WHEN NOT isnan({c}) THEN {c} END)" if kind == "float" else c


def _gaps_cte() -> str:
    return f"WITH t AS ({LINEITEM_GAPS_SQL})\n"


def _column_profile_sql() -> str:
    parts = []
    for i, (c, k) in enumerate(LINEITEM_GAPS_COLUMNS):
        parts.append(
            f"SELECT {i} AS column_idx, '{c}' AS column_name, '{_CLASS[k]}' AS column_class, "
            f"count(*) AS n_rows, count_if({_missing(c, k)}) AS n_missing, "
            f"count(DISTINCT {_clean(c, k)}) AS n_distinct FROM t"
        )
    return _gaps_cte() + ", s AS (" + "\nUNION ALL ".join(parts) + ")\n" + (
        "SELECT CAST(column_idx AS INTEGER) AS column_idx, column_name, column_class, "
        "CAST(n_rows AS BIGINT) AS rows, CAST(n_missing AS BIGINT) AS missing, "
        f"{pct2_sql('n_missing', 'n_rows')} AS missing_pct, CAST(n_distinct AS BIGINT) AS distinct_count FROM s"
    )


ORACLE["column_profile"] = _column_profile_sql()

_TYPE_CLASS = (
    "CASE WHEN data_type IN ('TINYINT','SMALLINT','INTEGER','BIGINT','HUGEINT','UTINYINT','USMALLINT',"
    "'UINTEGER','UBIGINT','FLOAT','DOUBLE') OR data_type LIKE 'DECIMAL%' THEN 'numeric' "
    "WHEN data_type = 'VARCHAR' THEN 'categorical' ELSE 'other' END"
)
_TABLE_LIST = ", ".join(f"'{t}'" for t in TABLES)

ORACLE["column_types"] = (
    f"SELECT table_name, CAST(ordinal_position - 1 AS INTEGER) AS column_idx, column_name, "
    f"{_TYPE_CLASS} AS column_class FROM information_schema.columns WHERE table_name IN ({_TABLE_LIST})"
)

ORACLE["column_type_distribution"] = (
    f"SELECT table_name, CAST(count_if(cls = 'numeric') AS BIGINT) AS numeric, "
    f"CAST(count_if(cls = 'categorical') AS BIGINT) AS categorical, CAST(count(*) AS BIGINT) AS total "
    f"FROM (SELECT table_name, {_TYPE_CLASS} AS cls FROM information_schema.columns "
    f"WHERE table_name IN ({_TABLE_LIST})) GROUP BY table_name"
)

_GAPS_NUMERIC = [(c, k) for c, k in LINEITEM_GAPS_COLUMNS if k in ("int", "float")]
_GAPS_CATEG = [(c, k) for c, k in LINEITEM_GAPS_COLUMNS if k == "str"]


def _table_profile_sql() -> str:
    ncols = len(LINEITEM_GAPS_COLUMNS)
    miss = " + ".join(f"count_if({_missing(c, k)})" for c, k in LINEITEM_GAPS_COLUMNS)
    return _gaps_cte() + (
        f", a AS (SELECT count(*) AS n_rows, {miss} AS n_missing FROM t), "
        f"d AS (SELECT count(*) AS n_distinct FROM (SELECT DISTINCT * FROM t)) "
        f"SELECT CAST(n_rows AS BIGINT) AS rows, CAST({ncols} AS BIGINT) AS cols, "
        f"CAST(n_missing AS BIGINT) AS total_missing, "
        f"{pct2_sql(f'n_rows * {ncols} - n_missing', f'n_rows * {ncols}')} AS completeness_pct, "
        f"COALESCE({pct2_sql(f'n_rows * {ncols} - n_missing', f'n_rows * {ncols}')}, 100.0) AS quality_score, "
        f"CAST(n_rows - n_distinct AS BIGINT) AS duplicate_rows, "
        f"CAST({len(_GAPS_NUMERIC)} AS BIGINT) AS numeric_cols, CAST({len(_GAPS_CATEG)} AS BIGINT) AS categorical_cols "
        f"FROM a, d"
    )


ORACLE["table_profile"] = _table_profile_sql()


def _missing_by_column_sql() -> str:
    parts = [
        f"SELECT {i} AS column_idx, '{c}' AS column_name, count_if({_missing(c, k)}) AS m, count(*) AS n FROM t"
        for i, (c, k) in enumerate(LINEITEM_GAPS_COLUMNS)
    ]
    return _gaps_cte() + ", s AS (" + "\nUNION ALL ".join(parts) + ")\n" + (
        f"SELECT CAST(column_idx AS INTEGER) AS column_idx, column_name, CAST(m AS BIGINT) AS missing, "
        f"{pct2_sql('m', 'n')} AS missing_pct FROM s"
    )


ORACLE["missing_by_column"] = _missing_by_column_sql()


def _dup(name: str, src: str) -> str:
    return (f"SELECT '{name}' AS table_name, CAST((SELECT count(*) FROM {src}) AS BIGINT) AS rows, "
            f"CAST((SELECT count(*) FROM (SELECT DISTINCT * FROM {src})) AS BIGINT) AS distinct_rows, "
            f"CAST((SELECT count(*) FROM {src}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {src})) AS BIGINT) "
            f"AS duplicate_rows")


ORACLE["duplicate_rows"] = _gaps_cte() + "\nUNION ALL ".join([
    _dup("documents_text_lang", "(SELECT text, lang FROM documents)"),
    _dup("conversations_role_turn", "(SELECT role, turn FROM conversations)"),
    _dup("lineitem_gaps", "t"),
])

ORACLE["distinct_counts"] = _gaps_cte() + "\nUNION ALL ".join(
    f"SELECT CAST({i} AS INTEGER) AS column_idx, '{c}' AS column_name, "
    f"CAST(count(DISTINCT {_clean(c, k)}) AS BIGINT) AS distinct_count FROM t"
    for i, (c, k) in enumerate(LINEITEM_GAPS_COLUMNS)
)


def _top_sql(tbl: str, col: str, k: int = 10) -> str:
    return (
        f"SELECT '{tbl}' AS table_name, '{col}' AS column_name, CAST(rnk AS INTEGER) AS rank, value, "
        f"CAST(cnt AS BIGINT) AS count FROM (SELECT value, cnt, row_number() OVER (ORDER BY cnt DESC, value ASC) "
        f"AS rnk FROM (SELECT {col} AS value, count(*) AS cnt FROM {tbl} WHERE {col} IS NOT NULL GROUP BY {col})) "
        f"WHERE rnk <= {k}"
    )


def _cats(tbl: str) -> list[str]:
    return [c for c, k in TABLE_COLUMNS[tbl] if k == "str"]


ORACLE["top_categories"] = "\nUNION ALL ".join(
    _top_sql(t, c) for t in ("orders", "part", "conversations") for c in _cats(t)
)


def _describe_numeric_sql() -> str:
    parts = []
    for i, (c, k) in enumerate(LINEITEM_GAPS_COLUMNS):
        if k not in ("int", "float"):
            continue
        v = f"CAST({_clean(c, k)} AS DOUBLE)"
        parts.append(
            f"SELECT CAST({i} AS INTEGER) AS column_idx, '{c}' AS column_name, CAST(count({v}) AS BIGINT) AS count, "
            f"round(avg({v}), 6) AS mean, round(stddev_samp({v}), 6) AS std, min({v}) AS min, "
            f"round(quantile_cont({v}, 0.25), 6) AS p25, round(quantile_cont({v}, 0.5), 6) AS p50, "
            f"round(quantile_cont({v}, 0.75), 6) AS p75, max({v}) AS max FROM t"
        )
    return _gaps_cte() + "\nUNION ALL ".join(parts)


ORACLE["describe_numeric"] = _describe_numeric_sql()


def _describe_cat(src: str, cols: list[tuple[int, str]]) -> list[str]:
    out = []
    for i, c in cols:
        out.append(
            f"SELECT CAST({i} AS INTEGER) AS column_idx, '{c}' AS column_name, "
            f"CAST((SELECT count({c}) FROM {src}) AS BIGINT) AS count, "
            f"CAST((SELECT count(DISTINCT {c}) FROM {src}) AS BIGINT) AS unique, "
            f"(SELECT {c} FROM {src} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS top, "
            f"CAST((SELECT count(*) FROM {src} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) "
            f"AS BIGINT) AS freq"
        )
    return out


ORACLE["describe_categorical"] = _gaps_cte() + "\nUNION ALL ".join(
    _describe_cat("orders", [(i, c) for i, (c, k) in enumerate(TABLE_COLUMNS["orders"]) if k == "str"])
    + _describe_cat("t", [(i, c) for i, (c, k) in enumerate(LINEITEM_GAPS_COLUMNS) if k == "str"])
)


def _corr_sql() -> str:
    nums = _GAPS_NUMERIC

    def value(c: str, k: str) -> str:  # the infinite cells that the query injects take no part
        return f"CASE WHEN {'l_orderkey % 19 = 0' if c == 'l_tax' else 'FALSE'} THEN NULL ELSE CAST({_clean(c, k)} AS DOUBLE) END"

    parts = []
    for i, (a, ka) in enumerate(nums):
        for j, (b, kb) in enumerate(nums):
            va, vb = value(a, ka), value(b, kb)
            parts.append(
                f"SELECT CAST({i} AS INTEGER) AS i, '{a}' AS col_i, CAST({j} AS INTEGER) AS j, '{b}' AS col_j, "
                f"corr({va}, {vb}) AS r FROM t"
            )
    return _gaps_cte() + ", c AS (" + "\nUNION ALL ".join(parts) + ")\n" + (
        "SELECT i, col_i, j, col_j, round(CASE WHEN isnan(r) THEN NULL ELSE greatest(-1.0, least(1.0, r)) END, 6) "
        "AS corr, false AS truncated FROM c"
    )


ORACLE["correlation_matrix"] = _corr_sql()

_WIDTH = {"int": None, "float": 8, "ts": 8}
_INT_WIDTH = {"l_linenumber": 4}


def _logical_bytes_sql() -> str:
    parts = []
    for i, (c, k) in enumerate(LINEITEM_GAPS_COLUMNS):
        if k == "str":
            e = f"COALESCE(sum(strlen({c})), 0)"
        elif k == "int":
            e = f"count({c}) * {_INT_WIDTH.get(c, 8)}"
        else:
            e = f"count({c}) * 8"
        parts.append(f"SELECT CAST({i} AS INTEGER) AS column_idx, '{c}' AS column_name, CAST({e} AS BIGINT) AS bytes FROM t")
    return _gaps_cte() + "\nUNION ALL ".join(parts)


ORACLE["logical_bytes"] = _logical_bytes_sql()

ORACLE["quality_breakdown"] = (
    f"WITH p AS ({_table_profile_sql()}) "
    "SELECT CAST(0 AS INTEGER) AS idx, 'complete_cells' AS category, CAST(rows * cols - total_missing AS BIGINT) AS value FROM p "
    "UNION ALL SELECT CAST(1 AS INTEGER), 'missing_cells', CAST(total_missing AS BIGINT) FROM p "
    "UNION ALL SELECT CAST(2 AS INTEGER), 'duplicate_rows', CAST(duplicate_rows AS BIGINT) FROM p"
)

ORACLE["drop_empty_columns"] = _gaps_cte() + "SELECT " + ", ".join(
    c for c, _ in LINEITEM_GAPS_COLUMNS if c != "l_note") + " FROM t"

ORACLE["preview"] = "SELECT " + ", ".join(
    f"COALESCE(CAST({c} AS VARCHAR), '') AS {c}" for c, _ in TABLE_COLUMNS["orders"]
) + " FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 5)"


def escape_sql(c: str) -> str:
    e = f"CAST({c} AS VARCHAR)"
    for raw, ent in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        raw_sql = raw.replace("'", "''")
        e = f"replace({e}, '{raw_sql}', '{ent}')"
    return f"(CASE WHEN {c} IS NULL OR lower(CAST({c} AS VARCHAR)) = 'nan' THEN '' ELSE {e} END)"


ORACLE["escape_html"] = (
    f"SELECT page_id, {escape_sql('html')} AS html_escaped, {escape_sql('url')} AS url_escaped FROM pages"
)


def md5_head_sql(keys: list[str], seed: int = 42) -> str:
    text = " || ':' || ".join(f"CAST({k} AS VARCHAR)" for k in keys) + f" || ':{seed}'"
    return f"('0x' || substr(md5({text}), 1, 8))::UBIGINT"


def _numeric_sample_sql() -> str:
    h = md5_head_sql(["l_orderkey", "l_linenumber"])
    parts = []
    for c, k in _GAPS_NUMERIC:
        v = f"CAST({_clean(c, k)} AS DOUBLE)"
        parts.append(
            f"SELECT * FROM (SELECT '{c}' AS column_name, CAST(row_number() OVER (ORDER BY h, l_orderkey, "
            f"l_linenumber, {v}) AS INTEGER) AS rank, {v} AS value FROM k WHERE {v} IS NOT NULL "
            f"ORDER BY h, l_orderkey, l_linenumber, {v} LIMIT 100)"
        )
    return _gaps_cte() + f", k AS (SELECT *, {h} AS h FROM t)\n" + "\nUNION ALL ".join(parts)


ORACLE["numeric_sample"] = _numeric_sample_sql()

def _exact_split_sql(name: str, key: str, sub: str) -> str:
    keys = f"{key} || ':' || {sub} || ':42'" if sub != "0" else f"{key} || ':42'"
    return (f"SELECT '{name}' AS table_name, CAST({key} AS BIGINT) AS key, CAST({sub} AS BIGINT) AS sub, "
            f"row_number() OVER (ORDER BY md5({keys}), {key}) > ceil(round(count(*) OVER () * 0.2, 9)) AS is_train FROM {name}")


ORACLE["exact_split"] = _exact_split_sql("lineitem", "l_orderkey", "l_linenumber") + "\nUNION ALL " + _exact_split_sql("nation", "n_nationkey", "0")

ORACLE["train_test_split"] = (
    f"SELECT l_orderkey, l_linenumber, ({md5_head_sql(['l_orderkey', 'l_linenumber'])} % 10000) < 8000 AS is_train "
    "FROM lineitem"
)


def oracle_sql() -> dict[str, str]:
    from tessera.plans import oracle_features, oracle_models, oracle_target  # noqa: F401  (registers)

    return dict(ORACLE)

ORACLE["csv_roundtrip"] = (
    "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer"
)
ORACLE["normalize_missing"] = (
    "SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_custkey END AS o_custkey, "
    "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus, "
    "CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 17 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice, "
    "CAST(o_orderdate AS VARCHAR) AS o_orderdate, "
    "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders"
)


def _json_rows_sql() -> str:
    parts = []
    for c, k in LINEITEM_GAPS_COLUMNS:
        if k == "str":
            v = f"COALESCE('\"' || {c} || '\"', 'null')"
        elif k == "ts":
            v = f"COALESCE('\"' || strftime({c}, '%Y-%m-%dT%H:%M:%S.%g') || '\"', 'null')"
        else:
            v = f"COALESCE(CAST({_clean(c, k)} AS VARCHAR), 'null')"
        parts.append(f"'\"{c}\":' || {v}")
    body = " || ',' || ".join(parts)
    return _gaps_cte() + f"SELECT l_orderkey, l_linenumber, '{{' || {body} || '}}' AS json FROM t"


ORACLE["rows_as_json"] = _json_rows_sql()
