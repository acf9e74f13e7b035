"""Oracle SQL for the models of the forecast: the first boosted tree, step by step, and keyed trend fits by elimination."""
import math

from shelfwise.operators import boosting
from shelfwise.operators.forecast import GBT_FEATURES
from shelfwise.plans.oracle import R, oracle

S = boosting.exact(trees=1)
_N = len(GBT_FEATURES)  # the number of the category among the features


def _best(k: int, nodes: str, depth: int | str) -> str:
    """The best split of each of the nodes after step k."""
    l2 = f"CASE WHEN f = {_N} THEN {S.l2} ELSE 0 END"
    return f"""
h{k} AS MATERIALIZED (
  SELECT node, f, b[f + 1] AS bin, sum(r) AS g, count(*) AS n
  FROM at{k} JOIN binned USING (rid), range({_N + 1}) AS t(f) WHERE node IN ({nodes}) GROUP BY ALL),
c{k} AS (
  SELECT node, f, bin, sum(g) OVER up AS lg, sum(n) OVER up AS ln, sum(g) OVER whole AS tg, sum(n) OVER whole AS tn, {l2} AS l2
  FROM h{k} WINDOW up AS (PARTITION BY node, f ORDER BY bin), whole AS (PARTITION BY node, f)),
s{k} AS (
  SELECT *, lg * lg / (ln + l2) + (tg - lg) * (tg - lg) / (tn - ln + l2) - tg * tg / (tn + l2) AS gain
  FROM c{k} WHERE ln >= {S.min_rows} AND tn - ln >= {S.min_rows}),
new{k} AS (
  SELECT node, {depth} AS depth, gain, f, bin, lg, ln, tg, tn
  FROM s{k} JOIN (SELECT node, max(gain) AS top FROM s{k} GROUP BY node) USING (node)
  WHERE gain >= top - {boosting.TIE!r} * (top + tg * tg / tn) AND top > 1e-12 * greatest(1, abs(tg)) AND {depth} < {S.max_depth}
  QUALIFY row_number() OVER (PARTITION BY node ORDER BY f, bin) = 1)"""


def first_tree() -> str:
    edges = ",".join(f"""
counts{i} AS (SELECT {f}::DOUBLE AS v, count(*) AS c FROM rows_ GROUP BY 1),
ranks{i} AS (SELECT v, c, sum(c) OVER (ORDER BY v) - c AS before, sum(c) OVER () AS n, max(v) OVER () AS top,
                    first_value(v) OVER by_count AS m, first_value(c) OVER by_count AS mc, lead(v) OVER (ORDER BY v) AS next
             FROM counts{i} WINDOW by_count AS (ORDER BY c DESC, v)),
rest{i} AS (SELECT *, before - CASE WHEN v > m THEN mc ELSE 0 END AS b, n - mc AS r FROM ranks{i}),
edges{i} AS MATERIALIZED (
  SELECT coalesce(list(v) FILTER (v < top AND (v = m OR next = m OR r > 0 AND
         floor((b + c) * {S.bins - 2} / r::DOUBLE) > floor(b * {S.bins - 2} / r::DOUBLE))), []) AS e{i} FROM rest{i})"""
                     for i, f in enumerate(GBT_FEATURES))
    tables = ", ".join(f"edges{i}" for i in range(_N))
    bins = ", ".join(f"len(list_filter(e{i}, lambda e: e < {f}))" for i, f in enumerate(GBT_FEATURES))
    steps = [f"""
rows_ AS MATERIALIZED (SELECT row_number() OVER () AS rid, * FROM complete_features),
{edges},
numeric_ AS MATERIALIZED (SELECT rid, product_id, y - (SELECT avg(y) FROM rows_) AS r, [{bins}] AS b FROM rows_, {tables}),
product AS MATERIALIZED (
  SELECT product_id, n, CAST(sign(q) * least(floor({boosting._FINE_PER_DOUBLING} * log2(1 + 1024 * abs(q))), {boosting._FINE_SIDE})
                             AS BIGINT) + {boosting._FINE_SIDE} AS step
  FROM (SELECT product_id, count(*) AS n, sum(r) / (count(*) + {S.smooth}) AS q FROM numeric_ GROUP BY product_id)),
upto AS (SELECT step, sum(sum(n)) OVER (ORDER BY step) AS upto FROM product GROUP BY step),
cuts AS MATERIALIZED (
  SELECT list(DISTINCT c) AS cuts
  FROM (SELECT k, min(step) AS c FROM range(1, {S.bins}) AS t(k), upto
        WHERE upto >= (SELECT sum(n) FROM product) * k / {float(S.bins)} GROUP BY k)),
binned AS MATERIALIZED (
  SELECT rid, r, list_append(b, len(list_filter(cuts, lambda c: c < step))) AS b FROM numeric_ JOIN product USING (product_id), cuts),
at0 AS MATERIALIZED (SELECT rid, 0 AS node FROM binned)""", _best(0, "0", 0), "leaf0 AS MATERIALIZED (SELECT * FROM new0)"]
    for k in range(S.leaves - 1):
        a, b = 2 * k + 1, 2 * k + 2
        steps.append(f"""
pick{k} AS MATERIALIZED (
  SELECT * FROM leaf{k} WHERE gain >= (SELECT max(gain) FROM leaf{k}) * (1 - {boosting.TIE!r}) ORDER BY node LIMIT 1)""")
        if k == S.leaves - 2:
            break
        steps.append(f"""
at{k + 1} AS MATERIALIZED (
  SELECT rid, CASE WHEN a.node <> p.node OR p.node IS NULL THEN a.node WHEN b[p.f + 1] <= p.bin THEN {a} ELSE {b} END AS node
  FROM at{k} a JOIN binned USING (rid) LEFT JOIN pick{k} p ON true)""")
        steps.append(_best(k + 1, f"{a}, {b}", f"(SELECT depth + 1 FROM pick{k})"))
        steps.append(f"""
leaf{k + 1} AS MATERIALIZED (
  SELECT * FROM leaf{k} WHERE node NOT IN (SELECT node FROM pick{k}) UNION ALL SELECT * FROM new{k + 1})""")
    picks = " UNION ALL ".join(f"SELECT {k} AS k, * FROM pick{k}" for k in range(S.leaves - 1))
    l2 = f"CASE WHEN f = {_N} THEN {S.l2} ELSE 0 END"
    return f"""SELECT t.node, t.f AS feature, t.bin, t.k * 2 + 1 AS left_node, t.k * 2 + 2 AS right_node,
       {R(f'{S.rate} * t.g / (t.n + t.l2)', 6)} AS value, CAST(t.n AS BIGINT) AS n_rows
FROM (WITH {','.join(steps)},
      picks AS MATERIALIZED ({picks}),
      nodes AS (SELECT 0 AS node, (SELECT sum(r) FROM binned) AS g, (SELECT count(*) FROM binned) AS n, 0 AS l2
                UNION ALL SELECT 2 * k + 1, lg, ln, {l2} FROM picks
                UNION ALL SELECT 2 * k + 2, tg - lg, tn - ln, {l2} FROM picks)
      SELECT nodes.*, picks.k, picks.f, picks.bin FROM nodes LEFT JOIN picks USING (node)) AS t"""


def keyed_trend() -> str:
    """The normal equations of intercept, time, and one weekly wave, solved by elimination."""
    angle = f"day * {2 * math.pi * 1 / 7.0!r}"
    x = ["1.0", "day / greatest(span, 1)::DOUBLE", f"sin({angle})", f"cos({angle})"]
    n = len(x)
    first = ", ".join([f"avg(x{i} * x{j}){' + 0.01' if i == j and i else ''} AS a{i}{j}" for i in range(n) for j in range(n)]
                      + [f"avg(x{i} * y) AS a{i}{n}" for i in range(n)])
    steps = [f"""
days AS (
  SELECT product_id, y, first_ds, span, {', '.join(f'{c} AS x{i}' for i, c in enumerate(x))}
  FROM (SELECT product_id, y, min(ds) OVER p AS first_ds, max(ds) OVER p - min(ds) OVER p AS span, ds - min(ds) OVER p AS day
        FROM filled_panel WINDOW p AS (PARTITION BY product_id))),
e0 AS (SELECT product_id, any_value(first_ds) AS first_ds, any_value(span) AS span, count(*) AS n, {first}
       FROM days GROUP BY product_id)"""]
    for k in range(n):  # Gauss-Jordan; the matrix is positive definite
        cells = [f"a{i}{j} / a{k}{k} AS a{i}{j}" if i == k else f"a{i}{j} - a{i}{k} * a{k}{j} / a{k}{k} AS a{i}{j}"
                 for i in range(n) for j in range(n + 1)]
        steps.append(f"e{k + 1} AS (SELECT product_id, first_ds, span, n, {', '.join(cells)} FROM e{k})")
    solved = ", ".join(f"{R(f'a{i}{n}', 6)} AS b{i}" for i in range(n))
    return f"SELECT product_id, first_ds, span, n, {solved} FROM (WITH {','.join(steps)} SELECT * FROM e{n})"


oracle("f12_first_tree", first_tree())
oracle("f11_by_product", keyed_trend())
