"""SQL oracles: imputing, scaling, capped one-hot, ordinal/target codes, feature matrices."""

from __future__ import annotations

from tessera.plans.fixtures import LINEITEM_GAPS_SQL, PART_GAPS_SQL, TABLE_COLUMNS
from tessera.plans.oracle import ORACLE, _clean, md5_head_sql

EPS = "2.220446049250313e-15"


def _v(c: str, k: str) -> str:
    return f"CAST({_clean(c, k)} AS DOUBLE)"


_GAPS = f"WITH t AS ({LINEITEM_GAPS_SQL})\n"
_PART = f"WITH t AS ({PART_GAPS_SQL})\n"

ORACLE["impute_mean"] = _GAPS + (
    "SELECT l_orderkey, l_linenumber, "
    f"round(COALESCE({_v('l_quantity', 'float')}, (SELECT avg({_v('l_quantity', 'float')}) FROM t)), 6) AS l_quantity, "
    f"round(COALESCE({_v('l_discount', 'float')}, (SELECT avg({_v('l_discount', 'float')}) FROM t)), 6) AS l_discount "
    "FROM t"
)


def _scaled(v: str, src: str) -> str:
    m = f"(SELECT avg({v}) FROM {src})"
    sd = f"(SELECT sqrt(var_pop({v}) * count({v}) / count(*)) FROM {src})"
    scale = f"(CASE WHEN {sd} >= {EPS} THEN {sd} ELSE 1.0 END)"
    return f"(COALESCE({v}, {m}) - {m}) / {scale}"


ORACLE["standard_scale"] = _GAPS + "SELECT l_orderkey, l_linenumber, " + ", ".join(
    f"round({_scaled(_v(c, 'float'), 't')}, 6) AS {c}" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
) + " FROM t"


def _mode(c: str, src: str) -> str:
    return f"(SELECT {c} FROM {src} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


ORACLE["impute_mode"] = (
    f"WITH t AS ({LINEITEM_GAPS_SQL}), p AS ({PART_GAPS_SQL})\n"
    f"SELECT 'lineitem_gaps' AS source, l_orderkey AS key, CAST(l_linenumber AS BIGINT) AS sub, "
    f"COALESCE(l_returnflag, {_mode('l_returnflag', 't')}) AS value FROM t\n"
    f"UNION ALL SELECT 'part_gaps.p_brand', p_partkey, CAST(0 AS BIGINT), COALESCE(p_brand, {_mode('p_brand', 'p')}) "
    f"FROM p\nUNION ALL SELECT 'part_gaps.p_type', p_partkey, CAST(0 AS BIGINT), "
    f"COALESCE(p_type, {_mode('p_type', 'p')}) FROM p"
)


def onehot_ctes(c: str, fit: str) -> str:
    """CTEs ``oh_<c>_kept(v, kept)`` and ``oh_<c>_feat(feature, fv, is_inf)`` for a text column."""
    p = f"oh_{c}"
    return (
        f"{p}_cnt AS (SELECT {c} AS v, count(*) AS n FROM {fit} WHERE {c} IS NOT NULL GROUP BY {c}), "
        f"{p}_mode AS (SELECT v FROM {p}_cnt ORDER BY n DESC, v LIMIT 1), "
        f"{p}_imp AS (SELECT v, n + CASE WHEN v = (SELECT v FROM {p}_mode) THEN "
        f"(SELECT count(*) FROM {fit} WHERE {c} IS NULL) ELSE 0 END AS n FROM {p}_cnt), "
        f"{p}_rk AS (SELECT v, row_number() OVER (ORDER BY n DESC, v DESC) AS rk, count(*) OVER () AS total "
        f"FROM {p}_imp), "
        f"{p}_kept AS (SELECT v, (total <= 10 OR rk <= 9) AS kept FROM {p}_rk), "
        f"{p}_feat AS (SELECT 'cat__{c}_' || v AS feature, v AS fv, false AS is_inf FROM {p}_kept "
        f"WHERE kept AND v <> (SELECT min(v) FROM {p}_kept WHERE kept) "
        f"UNION ALL SELECT 'cat__{c}_infrequent_sklearn', NULL, true "
        f"WHERE EXISTS (SELECT 1 FROM {p}_kept WHERE NOT kept))"
    )


def onehot_rows(c: str, key: str, rows: str, fit: str) -> str:
    p = f"oh_{c}"
    return (
        f"SELECT {key}, f.feature, CASE WHEN (NOT f.is_inf AND r.iv = f.fv) OR (f.is_inf AND r.iv IN "
        f"(SELECT v FROM {p}_kept WHERE NOT kept)) THEN 1.0 ELSE 0.0 END AS value "
        f"FROM (SELECT {key}, COALESCE({c}, (SELECT v FROM {p}_mode)) AS iv FROM {rows}) r CROSS JOIN {p}_feat f "
        f"WHERE (SELECT count(DISTINCT {c}) FROM {fit}) <= 50"
    )


ORACLE["one_hot"] = (
    f"WITH t AS ({PART_GAPS_SQL}), f AS (SELECT * FROM t WHERE p_retailprice IS NOT NULL), "
    + ", ".join(onehot_ctes(c, "f") for c in ("p_name", "p_brand", "p_type"))
    + "\n" + "\nUNION ALL ".join(onehot_rows(c, "p_partkey", "t", "f") for c in ("p_name", "p_brand", "p_type"))
)

ORACLE["ordinal_encode"] = (
    "SELECT 'part.p_name' AS source, p_partkey AS key, "
    "CAST(dense_rank() OVER (ORDER BY COALESCE(p_name, 'nan')) - 1 AS BIGINT) AS code FROM part\n"
    "UNION ALL SELECT 'customer.c_name', c_custkey, "
    "CAST(dense_rank() OVER (ORDER BY COALESCE(c_name, 'nan')) - 1 AS BIGINT) FROM customer"
)

ORACLE["encode_target"] = _PART + (
    "SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY COALESCE(p_type, 'nan')) - 1 AS BIGINT) AS label FROM t"
)

ORACLE["simple_features"] = _PART + (
    "SELECT CAST(COALESCE(p_partkey, (SELECT avg(p_partkey) FROM t)) AS DOUBLE) AS p_partkey, "
    "CAST(dense_rank() OVER (ORDER BY COALESCE(p_name, 'nan')) - 1 AS BIGINT) AS p_name, "
    "CAST(dense_rank() OVER (ORDER BY COALESCE(p_brand, 'nan')) - 1 AS BIGINT) AS p_brand, "
    "CAST(dense_rank() OVER (ORDER BY COALESCE(p_type, 'nan')) - 1 AS BIGINT) AS p_type, "
    "CAST(COALESCE(p_size, (SELECT avg(p_size) FROM t)) AS DOUBLE) AS p_size, "
    "round(COALESCE(p_retailprice, (SELECT avg(p_retailprice) FROM t)), 6) AS p_retailprice FROM t"
)


def feature_matrix_sql(rows: str, fit: str, key: str, cols: list[tuple[str, str]], target: str) -> str:
    """Full feature matrix in long form ``(key, feature, value)`` for numeric + text columns.

    Text columns are generated both ways with guards: codes (> 50 distinct) or one-hot (≤ 50).
    """
    xs = [(c, k) for c, k in cols if c != target]
    ctes = []
    parts = []
    for c, k in xs:
        if k in ("int", "float"):
            v = _v(c, k)
            parts.append(f"SELECT {key}, 'num__{c}' AS feature, round({_scaled_fit(v, rows, fit)}, 6) AS value "
                         f"FROM {rows}")
        elif k == "str":
            ctes.append(f"voc_{c} AS (SELECT v, CAST(dense_rank() OVER (ORDER BY v) - 1 AS DOUBLE) AS code FROM "
                        f"(SELECT DISTINCT COALESCE({c}, 'nan') AS v FROM {fit}))")
            ctes.append(f"cod_{c} AS (SELECT r.{key}, voc.code FROM {rows} r LEFT JOIN voc_{c} voc "
                        f"ON COALESCE(r.{c}, 'nan') = voc.v)")
            ctes.append(f"codfit_{c} AS (SELECT voc.code FROM {fit} r LEFT JOIN voc_{c} voc "
                        f"ON COALESCE(r.{c}, 'nan') = voc.v)")
            parts.append(
                f"SELECT {key}, 'num__{c}' AS feature, round({_scaled_fit('code', f'cod_{c}', f'codfit_{c}')}, 6) "
                f"AS value FROM cod_{c} WHERE (SELECT count(DISTINCT {c}) FROM {fit}) > 50")
            ctes.append(onehot_ctes(c, fit))
            parts.append(f"SELECT {key}, feature, round(value, 6) AS value FROM ({onehot_rows(c, key, rows, fit)})")
    return ", ".join(ctes) + "\n" + "\nUNION ALL ".join(parts)


def _scaled_fit(v: str, rows: str, fit: str) -> str:
    m = f"(SELECT avg({v}) FROM {fit})"
    sd = f"(SELECT sqrt(var_pop({v}) * count({v}) / count(*)) FROM {fit})"
    scale = f"(CASE WHEN {sd} >= {EPS} THEN {sd} ELSE 1.0 END)"
    return f"(COALESCE({v}, {m}) - {m}) / {scale}"


_CUST = TABLE_COLUMNS["customer"]
ORACLE["build_features"] = (
    "WITH r AS (SELECT * FROM customer), fit AS (SELECT * FROM customer WHERE c_acctbal IS NOT NULL "
    "AND NOT isnan(c_acctbal)), " + feature_matrix_sql("r", "fit", "c_custkey", _CUST, "c_acctbal")
)

ORACLE["apply_features"] = (
    f"WITH r AS (SELECT * FROM customer), fit AS (SELECT * FROM customer WHERE "
    f"({md5_head_sql(['c_custkey'])} % 10000) < 8000 AND c_acctbal IS NOT NULL AND NOT isnan(c_acctbal)), "
    + feature_matrix_sql("r", "fit", "c_custkey", _CUST, "c_acctbal")
)


def feature_names_sql(name: str, src: str, cols: list[tuple[str, str]], target: str) -> str:
    """Feature layout: numeric (and > 50-distinct text) columns in column order, then one-hot outputs."""
    fit = f"fit_{name}"
    ctes = [f"{fit} AS (SELECT * FROM {src} WHERE {target} IS NOT NULL"
            + (f" AND NOT isnan({target}))" if dict(cols)[target] == "float" else ")")]
    parts = []
    for i, (c, k) in enumerate(cols):
        if c == target:
            continue
        if k in ("int", "float"):
            parts.append(f"SELECT 'num__{c}' AS feature, {i} AS o1, 0 AS o2, '' AS o3 "
                         f"WHERE (SELECT count({_clean(c, k)}) FROM {fit}) > 0")
        elif k == "str":
            parts.append(f"SELECT 'num__{c}', {i}, 0, '' WHERE (SELECT count(DISTINCT {c}) FROM {fit}) > 50")
            ctes.append(onehot_ctes(c, fit).replace("oh_", f"oh_{name}_"))
            parts.append(f"SELECT feature, 1000 + {i}, CASE WHEN is_inf THEN 1 ELSE 0 END, COALESCE(fv, '') "
                         f"FROM oh_{name}_{c}_feat WHERE (SELECT count(DISTINCT {c}) FROM {fit}) BETWEEN 1 AND 50")
    body = "\nUNION ALL ".join(parts)
    return (", ".join(ctes), f"SELECT '{name}' AS table_name, CAST(row_number() OVER (ORDER BY o1, o2, o3) - 1 "
                             f"AS INTEGER) AS position, feature FROM ({body})")


def _feature_names_all() -> str:
    from tessera.plans.fixtures import LINEITEM_GAPS_COLUMNS

    specs = [
        feature_names_sql("customer", "customer", TABLE_COLUMNS["customer"], "c_acctbal"),
        feature_names_sql("part_gaps", "p", [("p_partkey", "int"), ("p_name", "str"), ("p_brand", "str"),
                                             ("p_type", "str"), ("p_size", "int"), ("p_retailprice", "float")],
                          "p_retailprice"),
        feature_names_sql("lineitem_gaps", "t", LINEITEM_GAPS_COLUMNS, "l_extendedprice"),
    ]
    ctes = ", ".join(c for c, _ in specs)
    return (f"WITH p AS ({PART_GAPS_SQL}), t AS ({LINEITEM_GAPS_SQL}), {ctes}\n"
            + "\nUNION ALL ".join(f"SELECT * FROM ({q})" for _, q in specs))


ORACLE["feature_names"] = _feature_names_all()
