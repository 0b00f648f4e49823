"""SQL text shared by the statements: the derived input tables as common table expressions."""

from __future__ import annotations

_DD = "CAST(floor((epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 86400000000) AS INTEGER)"
_PROC = f"(({_DD} % 10 + 10) % 10 - 1)"
_REAL = f"(({_DD} % 7 + 7) % 7)"
_SCHED = "(CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1)"

ROW_KEY = """concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey,
    CAST(round(l_extendedprice * 100) AS BIGINT),
    date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)))"""

ORDER_ITEMS = f"""order_items AS (
  SELECT {ROW_KEY} AS row_key,
    l_orderkey AS order_id, l_linenumber AS order_item_id, l_linenumber AS line_number,
    l_partkey AS order_item_cardprod_id, l_partkey AS product_card_id, l_suppkey AS supplier_id,
    o_custkey AS customer_id, c_name AS customer_fname,
    o_orderdate AS order_date, o_orderdate + to_days({_PROC}) AS shipping_date,
    strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS order_date_dateorders,
    strftime(o_orderdate + to_days({_PROC}), '%Y-%m-%d %H:%M:%S') AS shipping_date_dateorders,
    {_PROC} AS processing_days, {_REAL} AS days_for_shipping_real, {_SCHED} AS days_for_shipment_scheduled,
    CASE WHEN {_REAL} > {_SCHED} THEN 1 ELSE 0 END AS late,
    l_extendedprice AS order_item_product_price, l_extendedprice / 100 AS product_price,
    l_extendedprice * l_discount AS order_item_discount,
    l_extendedprice * (0.05::DOUBLE - l_discount) AS order_profit_per_order,
    -20::DOUBLE + 1.6::DOUBLE * s_nationkey AS latitude_src,
    -30::DOUBLE + 2.5::DOUBLE * s_nationkey AS longitude_src,
    15::DOUBLE - 1.3::DOUBLE * c_nationkey AS latitude_dest,
    35::DOUBLE - 2.1::DOUBLE * c_nationkey AS longitude_dest,
    o_orderpriority AS shipping_mode, o_orderstatus AS order_status, c_mktsegment AS customer_segment,
    n_name AS customer_country, r_name AS market, p_brand AS department_name, p_type AS category_name,
    p_name AS product_name, l_returnflag AS type, l_linestatus AS delivery_status,
    l_quantity AS quantity, l_tax AS tax, l_discount AS discount_rate,
    CAST((l_quantity + l_linenumber) % 5 AS INTEGER) AS stability
  FROM lineitem
  LEFT JOIN orders ON l_orderkey = o_orderkey
  LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN part ON l_partkey = p_partkey
  LEFT JOIN supplier ON l_suppkey = s_suppkey)"""

BINARY = ORDER_ITEMS + """,
points AS (
  SELECT *, (order_item_cardprod_id * 31 + supplier_id * 17 + line_number * 7 + order_id) % 1000 + 300 * late AS pts
  FROM order_items),
pred AS (
  SELECT row_key, late AS y_true, CASE WHEN pts >= 650 THEN 1 ELSE 0 END AS y_pred,
    pts / 1300::DOUBLE AS score, 1 - pts / 1300::DOUBLE AS score0, shipping_mode, order_date
  FROM points)"""

_W = [
    f"CAST(1 + (l_partkey * {k + 3} + l_suppkey) % 97 + CASE WHEN CAST((l_quantity + l_linenumber) % 5 AS INTEGER) = {k} THEN 40 ELSE 0 END AS DOUBLE)"
    for k in range(5)
]

WEIGHTS = f"""weights AS (
  SELECT {ROW_KEY} AS row_key, CAST((l_quantity + l_linenumber) % 5 AS INTEGER) AS y_true,
    {", ".join(f"{w} AS w{k}" for k, w in enumerate(_W))}
  FROM lineitem)"""

MULTI = WEIGHTS + """,
pred AS (
  SELECT row_key, y_true,
    CASE greatest(w0, w1, w2, w3, w4) WHEN w0 THEN 0 WHEN w1 THEN 1 WHEN w2 THEN 2 WHEN w3 THEN 3 ELSE 4 END AS y_pred,
    w0 / (w0 + w1 + w2 + w3 + w4) AS p0, w1 / (w0 + w1 + w2 + w3 + w4) AS p1, w2 / (w0 + w1 + w2 + w3 + w4) AS p2,
    w3 / (w0 + w1 + w2 + w3 + w4) AS p3, w4 / (w0 + w1 + w2 + w3 + w4) AS p4
  FROM weights),
cells AS (
  SELECT row_key, 0 AS class, p0 AS score, CASE WHEN y_true = 0 THEN 1 ELSE 0 END AS positive FROM pred
  UNION ALL SELECT row_key, 1, p1, CASE WHEN y_true = 1 THEN 1 ELSE 0 END FROM pred
  UNION ALL SELECT row_key, 2, p2, CASE WHEN y_true = 2 THEN 1 ELSE 0 END FROM pred
  UNION ALL SELECT row_key, 3, p3, CASE WHEN y_true = 3 THEN 1 ELSE 0 END FROM pred
  UNION ALL SELECT row_key, 4, p4, CASE WHEN y_true = 4 THEN 1 ELSE 0 END FROM pred)"""


def counts_by_class(group: str = "", source: str = "pred") -> str:
    """CTEs ``class_counts`` (tp, fp, fn, tn per class) and ``class_metrics`` on top of ``source``.

    ``group`` lists leading grouping columns, each followed by a comma.
    """
    keys = [g.strip() for g in group.split(",") if g.strip()]
    part = f"PARTITION BY {', '.join(keys)}" if keys else ""
    return f"""
sides AS (
  SELECT {group} y_true AS class, 1 AS is_true, 0 AS is_said, CASE WHEN y_true = y_pred THEN 1 ELSE 0 END AS hit FROM {source}
  UNION ALL SELECT {group} y_pred, 0, 1, 0 FROM {source}),
totals AS (
  SELECT {group} class, CAST(sum(is_true) AS BIGINT) AS t, CAST(sum(is_said) AS BIGINT) AS s,
    CAST(sum(hit) AS BIGINT) AS tp FROM sides GROUP BY {group} class),
class_counts AS (
  SELECT {group} class, tp, s - tp AS fp, t - tp AS fn,
    CAST(sum(t) OVER ({part}) AS BIGINT) - t - s + tp AS tn FROM totals),
class_metrics AS (
  SELECT {group} class, tp, fp, fn, tn, tp + fn AS support,
    CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS "precision",
    CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS recall,
    CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0 END AS f1,
    CASE WHEN tn + fp > 0 THEN tn / (tn + fp)::DOUBLE ELSE 0 END AS specificity,
    CASE WHEN tn + fp > 0 THEN fp / (tn + fp)::DOUBLE ELSE 0 END AS fpr,
    CASE WHEN tp + fn > 0 THEN fn / (tp + fn)::DOUBLE ELSE 0 END AS fnr,
    (tp + tn) / (tp + fp + fn + tn)::DOUBLE AS class_accuracy
  FROM class_counts)"""


SUMMARY_COLUMNS = [
    "accuracy", *[f"macro_{m}" for m in ("precision", "recall", "f1", "specificity", "fpr", "fnr")],
    *[f"weighted_{m}" for m in ("precision", "recall", "f1", "specificity", "fpr", "fnr")],
    "balanced_accuracy", "mcc",
]


def summary(group: str = "") -> str:
    """CTE ``summary`` with the summary metrics of each group, unrounded."""
    keys = [g.strip() for g in group.split(",") if g.strip()]
    by = f"GROUP BY {', '.join(keys)}" if keys else ""
    rates = ["precision", "recall", "f1", "specificity", "fpr", "fnr"]
    macro = ", ".join(f'avg("{m}") AS macro_{m}' for m in rates)
    weighted = ", ".join(f'sum("{m}" * support) / sum(support) AS weighted_{m}' for m in rates)
    total, hits = "sum(support)::DOUBLE", "sum(tp)::DOUBLE"
    s2, t2 = "sum((tp + fp)::DOUBLE * (tp + fp))", "sum(support::DOUBLE * support)"
    spread = f"(({total} * {total} - {s2}) * ({total} * {total} - {t2}))"
    return f"""
summary AS (
  SELECT {group} CAST(sum(support) AS BIGINT) AS n, {hits} / {total} AS accuracy, {macro}, {weighted},
    avg(CASE WHEN support > 0 THEN recall END) AS balanced_accuracy,
    CASE WHEN {spread} > 0
      THEN ({hits} * {total} - sum((tp + fp)::DOUBLE * support)) / sqrt({spread}) ELSE 0 END AS mcc
  FROM class_metrics {by})"""


def areas(group: str, source: str) -> str:
    """CTEs ``ranked`` and ``areas``: running counts per distinct score and the areas, per group."""
    keys = [g.strip() for g in group.split(",") if g.strip()]
    part = f"PARTITION BY {', '.join(keys)}" if keys else ""
    by = f"GROUP BY {', '.join(keys)}" if keys else ""
    return f"""
per_score AS (
  SELECT {group} score, CAST(sum(positive) AS BIGINT) AS pos, CAST(sum(1 - positive) AS BIGINT) AS neg
  FROM {source} GROUP BY {group} score),
ranked AS (
  SELECT {group} score, pos, neg,
    CAST(sum(pos) OVER ({part} ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS tp,
    CAST(sum(neg) OVER ({part} ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS fp,
    CAST(sum(pos) OVER ({part}) AS BIGINT) AS np, CAST(sum(neg) OVER ({part}) AS BIGINT) AS nn,
    lead(pos) OVER ({part} ORDER BY score DESC) AS next_pos,
    lead(neg) OVER ({part} ORDER BY score DESC) AS next_neg
  FROM per_score),
areas AS (
  SELECT {group}
    coalesce(sum(neg * (tp - pos / 2.0::DOUBLE)) / nullif(max(np) * max(nn)::DOUBLE, 0), 0) AS roc_auc,
    coalesce(sum(pos * (tp / (tp + fp)::DOUBLE)) / nullif(max(np), 0), 0) AS average_precision,
    coalesce(sum(pos * (tp / (tp + fp)::DOUBLE + CASE WHEN tp + fp > pos + neg
      THEN (tp - pos) / (tp + fp - pos - neg)::DOUBLE ELSE 1 END) / 2) / nullif(max(np), 0), 0) AS pr_auc_trapezoid,
    CAST(max(np) AS BIGINT) AS positives
  FROM ranked {by})"""


def split(source: str, label: str, key: str, seed: int = 42) -> str:
    """CTE ``split_rows``: the rows of ``source`` with an exact stratified ``split`` column.

    Training shares are proportional with largest remainders, sizes are rounded up in doubles, and
    rows go to test, then validation, in the order of their hashed keys.
    """
    return f"""
class_n AS (SELECT {label} AS c, count(*) AS n FROM {source} GROUP BY 1),
step1 AS (
  SELECT c, n, t, n / t::DOUBLE * (t - ceil(0.1::DOUBLE * t)) AS x, t - ceil(0.1::DOUBLE * t) AS rest_n
  FROM (SELECT c, n, sum(n) OVER () AS t FROM class_n)),
step2 AS (
  SELECT c, n, rest_n, floor(x) + CASE WHEN row_number() OVER (ORDER BY x - floor(x) DESC, c)
    <= rest_n - sum(floor(x)) OVER () THEN 1 ELSE 0 END AS rest FROM step1),
step3 AS (
  SELECT c, n, rest, rest / rest_n * train_n AS x, train_n FROM (
    SELECT *, rest_n - ceil((0.1::DOUBLE / (1::DOUBLE - 0.1::DOUBLE)) * rest_n) AS train_n FROM step2)),
quota AS (
  SELECT c, n - rest AS n_test, rest - (floor(x) + CASE WHEN row_number() OVER (ORDER BY x - floor(x) DESC, c)
    <= train_n - sum(floor(x)) OVER () THEN 1 ELSE 0 END) AS n_val FROM step3),
split_rows AS (
  SELECT s.* EXCLUDE (rn), CASE WHEN rn <= n_test THEN 'test' WHEN rn <= n_test + n_val THEN 'val' ELSE 'train' END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY md5('{seed}|' || {key})) AS rn FROM {source}) s
  JOIN quota ON c = s.{label})"""


def f_tails(source: str) -> str:
    """CTE ``tails`` (feature, f, p) on top of ``source`` (feature, f, k classes, n rows): the tail of the F distribution.

    The incomplete beta function is taken from its continued fraction, two terms a step (Lentz); needs WITH RECURSIVE.
    """
    return f"""
tested AS (
  SELECT feature, f, (n - k) / 2::DOUBLE AS a0, (k - 1) / 2::DOUBLE AS b0, (n - k) / ((n - k) + (k - 1) * f) AS x0,
    (k - 1) * f / ((n - k) + (k - 1) * f) AS y0 FROM {source} WHERE f > 0 AND NOT isinf(f) AND NOT isnan(f)),
sided AS (
  SELECT *, x0 < (a0 + 1) / (a0 + b0 + 2) AS direct, CASE WHEN x0 < (a0 + 1) / (a0 + b0 + 2) THEN a0 ELSE b0 END AS a,
    CASE WHEN x0 < (a0 + 1) / (a0 + b0 + 2) THEN b0 ELSE a0 END AS b,
    CASE WHEN x0 < (a0 + 1) / (a0 + b0 + 2) THEN x0 ELSE y0 END AS x FROM tested),
steps AS (
  SELECT feature, a, b, x, 0::DOUBLE AS m, 1::DOUBLE AS c, 1 / (1 - (a + b) * x / (a + 1)) AS d, 1 / (1 - (a + b) * x / (a + 1)) AS h FROM sided
  UNION ALL
  SELECT feature, a, b, x, m, 1 + odd / c, 1 / (1 + odd * d), h * (1 + odd / c) / (1 + odd * d) FROM (
    SELECT feature, a, b, x, m, odd, 1 + even / c AS c, 1 / (1 + even * d) AS d, h * (1 + even / c) / (1 + even * d) AS h FROM (
      SELECT feature, a, b, x, c, d, h, m + 1 AS m,
        (m + 1) * (b - m - 1) * x / ((a + 2 * m + 1) * (a + 2 * m + 2)) AS even,
        -(a + m + 1) * (a + b + m + 1) * x / ((a + 2 * m + 2) * (a + 2 * m + 3)) AS odd
      FROM steps WHERE m < 100))),
tails AS (
  SELECT feature, f, CASE WHEN direct THEN part ELSE 1 - part END AS p FROM (
    SELECT s.feature, f, direct,
      exp(lgamma(a0 + b0) - lgamma(a0) - lgamma(b0) + a0 * ln(x0) + b0 * ln(y0)) * h / s.a AS part
    FROM sided s JOIN steps t ON t.feature = s.feature AND t.m = 100)
  UNION ALL SELECT feature, f, CASE WHEN isinf(f) THEN 0 ELSE 1 END FROM {source} WHERE isinf(f) OR f <= 0)"""


def tree(name: str, features: list[str], label: str, n_classes: int, depth: int = 5, source: str = "split_rows") -> str:
    """CTEs that grow a decision tree with exact splits on the training rows of ``source``, a level at a time.

    The last, ``{name}_pred``, has row_key, y_true, y_pred and p0, p1, … of the test rows. Needs ``{name}_long``'s
    columns as doubles; cuts are ordered by purity, column, value, and lie in the middle of two values.
    """
    classes = range(n_classes)
    order = "[" + ", ".join(f"'{c}'" for c in features) + "]"
    left, right = [f"l{c}" for c in classes], [f"(t{c} - l{c})" for c in classes]

    def purity(counts: list[str]) -> str:
        return f"(({' + '.join(f'{c}::DOUBLE * {c}' for c in counts)}) / ({' + '.join(counts)})::DOUBLE)"

    parts = [f"""
{name}_long AS MATERIALIZED (
  SELECT row_key, list_position({order}, feature) AS j, v FROM (
    UNPIVOT (SELECT row_key, {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in features)} FROM {source})
    ON COLUMNS(* EXCLUDE (row_key)) INTO NAME feature VALUE v)),
{name}_n0 AS MATERIALIZED (SELECT row_key, CAST({label} AS INTEGER) AS y, split, 0 AS node FROM {source})"""]
    for level in range(depth):
        n = f"{name}_n{level}"
        parts.append(f"""
{name}_c{level} AS (
  SELECT node, j, v, {", ".join(f"count(*) FILTER (y = {c}) AS c{c}" for c in classes)}
  FROM {n} JOIN {name}_long USING (row_key) WHERE split = 'train' AND node >= {2**level - 1}
    AND node IN (SELECT node FROM {n} WHERE split = 'train' GROUP BY 1 HAVING count(DISTINCT y) > 1) GROUP BY 1, 2, 3),
{name}_r{level} AS (
  SELECT node, j, v, lead(v) OVER (PARTITION BY node, j ORDER BY v) AS later,
    {", ".join(f"sum(c{c}) OVER (PARTITION BY node, j ORDER BY v ROWS UNBOUNDED PRECEDING) AS l{c}" for c in classes)},
    {", ".join(f"sum(c{c}) OVER (PARTITION BY node, j) AS t{c}" for c in classes)} FROM {name}_c{level}),
{name}_b{level} AS MATERIALIZED (
  SELECT node, j, CASE WHEN (v + later) / 2 >= later THEN v ELSE (v + later) / 2 END AS cut FROM (
    SELECT *, row_number() OVER (PARTITION BY node ORDER BY {purity(left)} + {purity(right)} DESC, j, v) AS place
    FROM {name}_r{level} WHERE later IS NOT NULL) WHERE place = 1),
{name}_n{level + 1} AS MATERIALIZED (
  SELECT n.row_key, y, split, CASE WHEN b.node IS NULL THEN n.node WHEN x.v <= cut THEN 2 * n.node + 1 ELSE 2 * n.node + 2 END AS node
  FROM {n} n LEFT JOIN {name}_b{level} b ON b.node = n.node LEFT JOIN {name}_long x ON x.row_key = n.row_key AND x.j = b.j)""")
    leaves = f"{name}_n{depth}"
    shares = [f"count(*) FILTER (y = {c}) / count(*)::DOUBLE AS p{c}" for c in classes]
    best = "greatest(" + ", ".join(f"p{c}" for c in classes) + ")"
    parts.append(f"""
{name}_leaves AS (SELECT node, {", ".join(shares)} FROM {leaves} WHERE split = 'train' GROUP BY 1),
{name}_pred AS (
  SELECT row_key, y AS y_true, CASE {best} {" ".join(f"WHEN p{c} THEN {c}" for c in classes)} END AS y_pred,
    {", ".join(f"p{c}" for c in classes)} FROM {leaves} JOIN {name}_leaves USING (node) WHERE split = 'test')""")
    return ",".join(parts)
