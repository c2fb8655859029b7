"""SQL oracles: weighted classification metrics, regression metrics, best model, display score."""

from __future__ import annotations

from tessera.plans.catalog_models import CLASSIFICATION_RULES, REGRESSION_RULES
from tessera.plans.oracle import ORACLE, md5_head_sql

_CLASS_SRC = {
    "inverse_toxic": "SELECT CAST(quality AS VARCHAR) AS y, CAST(1 - toxic AS VARCHAR) AS p FROM labels",
    "long_document": ("SELECT CAST(l.quality AS VARCHAR) AS y, CASE WHEN d.n_chars >= 2000 THEN '1' ELSE '0' END AS p "
                      "FROM labels l JOIN documents d ON l.doc_id = d.doc_id"),
    "status_rule": "SELECT l_returnflag AS y, CASE WHEN l_linestatus = 'O' THEN 'N' ELSE 'R' END AS p FROM lineitem",
}
_REG_SRC = {
    "qty_x_retail": ("SELECT l_extendedprice AS y, l_quantity * p_retailprice AS p FROM lineitem "
                     "JOIN part ON l_partkey = p_partkey"),
    "qty_x_1500": "SELECT l_extendedprice AS y, l_quantity * 1500.0 AS p FROM lineitem",
    "quantity_only": "SELECT l_extendedprice AS y, l_quantity AS p FROM lineitem",
}


def class_metrics_sql(rule: str, idx: int) -> str:
    src = _CLASS_SRC[rule]
    return (
        f"SELECT '{rule}' AS model, {idx} AS model_idx, sum(tp) / sum(support) AS accuracy, "
        "sum(support * prec) / sum(support) AS precision, sum(support * rec) / sum(support) AS recall, "
        "sum(support * f1c) / sum(support) AS f1 FROM ("
        "SELECT *, CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0 END AS f1c FROM ("
        "SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS prec, "
        "CASE WHEN support > 0 THEN tp / support ELSE 0 END AS rec FROM ("
        "SELECT COALESCE(ts.support, 0) AS support, COALESCE(ts.tp, 0) AS tp, COALESCE(ps.predicted, 0) AS predicted "
        f"FROM (SELECT y AS c, count(*) AS support, count_if(y = p) AS tp FROM ({src}) GROUP BY y) ts "
        f"FULL OUTER JOIN (SELECT p AS c, count(*) AS predicted FROM ({src}) GROUP BY p) ps ON ts.c = ps.c)))"
    )


def reg_metrics_sql(rule: str, idx: int) -> str:
    src = _REG_SRC[rule]
    return (
        f"SELECT '{rule}' AS model, {idx} AS model_idx, avg((y - p) * (y - p)) AS mse, "
        "CASE WHEN var_pop(y) * count(y) = 0 THEN CASE WHEN sum((y - p) * (y - p)) = 0 THEN 1.0 ELSE 0.0 END "
        f"ELSE 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(y)) END AS r2 FROM ({src})"
    )


_CB = "\nUNION ALL ".join(class_metrics_sql(r, i) for i, r in enumerate(CLASSIFICATION_RULES))
_RB = "\nUNION ALL ".join(reg_metrics_sql(r, i) for i, r in enumerate(REGRESSION_RULES))

ORACLE["classification_metrics"] = (
    f"SELECT model AS rule, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, "
    f"round(recall, 6) AS recall, round(f1, 6) AS f1 FROM ({_CB})"
)
ORACLE["rule_leaderboard_export"] = (
    "SELECT model AS \"Model\", CASE WHEN row_number() OVER (ORDER BY COALESCE(accuracy, '-inf'::DOUBLE) DESC, model_idx) = 1 THEN 'Yes' ELSE 'No' END AS \"Best_Model\", "
    f"round(accuracy, 6) AS \"Accuracy\", round(precision, 6) AS \"Precision\", round(recall, 6) AS \"Recall\", round(f1, 6) AS \"F1\" FROM ({_CB})"
)
ORACLE["regression_metrics"] = f"SELECT model AS rule, printf('%.9e', mse) AS mse_sci, round(r2, 6) AS r2 FROM ({_RB})"
ORACLE["best_model"] = (
    f"SELECT * FROM (SELECT 'classification' AS family, model AS rule, CAST(model_idx AS INTEGER) AS model_idx, "
    f"round(accuracy, 6) AS score FROM ({_CB}) ORDER BY COALESCE(accuracy, '-inf'::DOUBLE) DESC, model_idx LIMIT 1)\n"
    f"UNION ALL SELECT * FROM (SELECT 'regression', model, CAST(model_idx AS INTEGER), round(r2, 6) FROM ({_RB}) "
    f"ORDER BY COALESCE(r2, '-inf'::DOUBLE) DESC, model_idx LIMIT 1)"
)
ORACLE["display_score"] = (
    f"SELECT model AS rule, round(COALESCE(NULLIF(accuracy, 0), CAST(NULL AS DOUBLE), 0.0), 6) AS display_score "
    f"FROM ({_CB})\nUNION ALL SELECT model, round(COALESCE(NULLIF(r2, 0), 0.0), 6) FROM ({_RB})"
)


# ------------------------------------------------------------------ fits with a closed form
def _split_sql(columns: list[str], keys: list[str]) -> str:
    return f"SELECT {', '.join(columns)}, ({md5_head_sql(keys)} % 10000) < 8000 AS is_train FROM lineitem"


ORACLE["train_linear_lineitem"] = (
    f"WITH t AS ({_split_sql(['l_quantity', 'l_extendedprice'], ['l_quantity', 'l_extendedprice'])}), "
    "f AS (SELECT regr_slope(l_extendedprice, l_quantity) FILTER (is_train) AS b, "
    "regr_intercept(l_extendedprice, l_quantity) FILTER (is_train) AS a, stddev_pop(l_quantity) AS s FROM t), "
    "e AS (SELECT l_extendedprice AS y, a + b * l_quantity AS p FROM t, f WHERE NOT is_train) "
    "SELECT 'LinearRegression' AS model, printf('%.6e', avg((y - p) * (y - p))) AS mse_sci, "
    "round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) AS r2, 'num__l_quantity' AS feature, "
    "round((SELECT abs(b) * s FROM f), 3) AS importance FROM e"
)

_X = "coalesce(CASE WHEN l_orderkey % 7 <> 0 THEN l_quantity END, (SELECT avg(l_quantity) FROM lineitem WHERE l_orderkey % 7 <> 0))"
_KEY = "concat_ws(':', CASE WHEN l_orderkey % 7 <> 0 THEN l_quantity END, l_linestatus, l_extendedprice, '42')"
ORACLE["score_linear_package"] = (
    "WITH t AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS y, CAST(l_linestatus = 'O' AS INTEGER) AS z, "
    f"{_X} AS x, ('0x' || substr(md5({_KEY}), 1, 8))::UBIGINT % 10000 < 8000 AS is_train FROM lineitem), "
    "s AS (SELECT var_pop(x) AS xx, var_pop(z) AS zz, covar_pop(x, z) AS xz, covar_pop(x, y) AS xy, covar_pop(z, y) AS zy, "
    "avg(x) AS mx, avg(z) AS mz, avg(y) AS my FROM t WHERE is_train), "
    "b AS (SELECT (xy * zz - zy * xz) / (xx * zz - xz * xz) AS b1, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS b2, * FROM s) "
    "SELECT l_orderkey, l_linenumber, round(my + b1 * (x - mx) + b2 * (z - mz), 1) AS prediction FROM t, b"
)

_SIZES = (
    "SELECT CASE WHEN l_quantity > 25 THEN 'big' ELSE 'small' END AS size, l_extendedprice, "
    "CASE WHEN (l_quantity > 25) <> (l_orderkey % 5 = 0) THEN 'A' ELSE 'B' END AS label FROM lineitem"
)
_SIZES = f"SELECT *, ({md5_head_sql(['size', 'l_extendedprice', 'label'])} % 10000) < 8000 AS is_train FROM ({_SIZES})"
_CLASS_SRC["majority"] = (
    f"SELECT t.label AS y, m.p FROM ({_SIZES}) t JOIN (SELECT size, arg_max(label, n) AS p FROM "
    f"(SELECT size, label, count(*) AS n FROM ({_SIZES}) WHERE is_train GROUP BY ALL) GROUP BY size) m USING (size) "
    "WHERE NOT t.is_train"
)
ORACLE["train_tree_lineitem"] = (
    "SELECT 'DecisionTree' AS model, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, "
    f"round(recall, 6) AS recall, round(f1, 6) AS f1 FROM ({class_metrics_sql('majority', 0)})"
)
