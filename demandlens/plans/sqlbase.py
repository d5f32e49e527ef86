"""DuckDB-dialect SQL building blocks for the oracle queries.

The oracle texts restate each operator's semantics independently in SQL over
the raw test tables; they share only the binding of §1.3 (demand rows,
coverage rows, focal provider).
"""

DEMAND = """
demand AS (
  SELECT o.o_orderkey AS basket, l.l_linenumber AS line, n.n_name AS company,
         CAST(year(o.o_orderdate) AS INTEGER) AS year, c.c_mktsegment AS role,
         p.p_name || ' ' || lower(p.p_type) AS item, l.l_returnflag AS item_type,
         CAST(p.p_type = 'PROMO' AS INTEGER) AS upcoming_flag
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN part p ON l.l_partkey = p.p_partkey)"""

COVERAGE = """
coverage AS (
  SELECT lower(trim(p_brand)) AS provider, p_size AS semester, p_type AS course,
         p_name || ' ' || lower(p_type) AS item
  FROM part WHERE p_size <= 12)"""

FOCAL = "brand#1"

# per-item features restated from the raw rows
FEATURES = DEMAND + "," + COVERAGE + """,
bounds AS (SELECT min(year) AS lo, max(year) AS hi FROM demand),
yearly AS (SELECT item, year, count(*) AS cnt FROM demand GROUP BY item, year),
grid AS (
  SELECT i.item, y.year, coalesce(yc.cnt, 0) AS cnt
  FROM (SELECT DISTINCT item FROM demand) i
  CROSS JOIN (SELECT range AS year FROM bounds, range((SELECT lo FROM bounds), (SELECT hi FROM bounds) + 1)) y
  LEFT JOIN yearly yc ON yc.item = i.item AND yc.year = y.year),
vol AS (SELECT item, stddev_samp(cnt) AS volatility FROM grid GROUP BY item),
diffs AS (
  SELECT item, cnt - lag(cnt) OVER (PARTITION BY item ORDER BY year) AS d FROM yearly),
vel AS (SELECT item, coalesce(avg(d), 0.0) AS velocity FROM diffs GROUP BY item),
slope AS (
  SELECT item, count(*) AS n_years,
         CASE WHEN count(*) > 1 THEN regr_slope(cnt, year) ELSE 0.0 END AS trend_slope,
         median(cnt) AS med
  FROM yearly GROUP BY item),
thr AS (
  SELECT y.item, min(y.year) AS threshold_year
  FROM yearly y JOIN slope s ON s.item = y.item
  WHERE y.cnt >= s.med AND y.cnt > 0 GROUP BY y.item),
rec AS (
  SELECT d.item, count(*) AS freq,
         coalesce(CAST(sum(d.year - b.lo) AS DOUBLE) / nullif(count(*) * max(b.hi - b.lo), 0), 0.0) AS recency_weight,
         count(DISTINCT d.company) AS company_spread,
         max(d.upcoming_flag) AS upcoming_flag
  FROM demand d, bounds b GROUP BY d.item),
ncomp AS (SELECT count(DISTINCT company) AS n FROM demand),
typecnt AS (SELECT item, item_type, count(*) AS c FROM demand GROUP BY item, item_type),
traj AS (
  SELECT item, item_type AS trajectory FROM (
    SELECT item, item_type, row_number() OVER (PARTITION BY item ORDER BY c DESC, item_type) AS rn
    FROM typecnt) WHERE rn = 1),
ytype AS (
  SELECT item, year, item_type AS year_type FROM (
    SELECT item, year, item_type,
           row_number() OVER (PARTITION BY item, year ORDER BY count(*) DESC, item_type) AS rn
    FROM demand GROUP BY item, year, item_type) WHERE rn = 1),
trans AS (
  SELECT item,
         CASE WHEN count(*) >= 2 AND count(DISTINCT year_type) > 1
              THEN arg_min(year_type, year) || ' -> ' || arg_max(year_type, year) END AS transition
  FROM ytype GROUP BY item),
nprov AS (SELECT count(DISTINCT provider) AS p FROM coverage),
cov AS (
  SELECT item, count(DISTINCT provider) AS taught_count,
         max(CASE WHEN provider = '""" + FOCAL + """' THEN 1 ELSE 0 END) AS is_covered
  FROM coverage GROUP BY item),
features AS (
  SELECT r.item, r.freq, s.n_years, s.trend_slope, v.velocity, r.recency_weight, vo.volatility,
         t.threshold_year, r.company_spread, r.upcoming_flag,
         round(r.company_spread * 1.0 / (SELECT n FROM ncomp), 3) AS company_spread_norm,
         tj.trajectory, tr.transition,
         coalesce(c.taught_count, 0) AS taught_count, coalesce(c.is_covered, 0) AS is_covered,
         CASE WHEN c.taught_count IS NULL THEN 1.0
              ELSE round(((SELECT p FROM nprov) - c.taught_count) * 1.0 / (SELECT p FROM nprov), 3) END AS provider_gap,
         CASE WHEN tr.transition IS NULL THEN 0 ELSE 1 END AS in_transition
  FROM rec r JOIN slope s USING (item) JOIN vel v USING (item) JOIN vol vo USING (item)
  LEFT JOIN thr t USING (item) LEFT JOIN traj tj USING (item) LEFT JOIN trans tr USING (item)
  LEFT JOIN cov c USING (item))"""


# distinct demanded items and (basket, item) rows need neither orders nor customers
ITEMS = """
items AS (
  SELECT DISTINCT p.p_name || ' ' || lower(p.p_type) AS item
  FROM (SELECT DISTINCT l_partkey FROM lineitem) l JOIN part p ON l.l_partkey = p.p_partkey)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)
