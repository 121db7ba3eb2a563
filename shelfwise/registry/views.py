"""Common table expressions of the SQL twins; ``FIXTURES.md`` has the rules in words."""

from __future__ import annotations

BASE = """
WITH sales AS (
  SELECT CAST(l_shipdate AS DATE) AS date, l_suppkey AS store_id, l_partkey AS product_id,
         l_quantity AS units,
         CASE WHEN l_discount >= CAST(0.095 AS DOUBLE) THEN 'True'
              WHEN l_discount >= CAST(0.005 AS DOUBLE) THEN 'False' END AS onpromotion
  FROM lineitem),
dirty AS (
  SELECT CAST(l_shipdate AS DATE) AS date,
         CASE WHEN NOT (l_tax >= CAST(0.075 AS DOUBLE) AND l_discount >= CAST(0.085 AS DOUBLE))
              THEN l_suppkey END AS store_id,
         l_partkey AS product_id,
         CASE WHEN l_returnflag = 'R' AND l_tax < CAST(0.005 AS DOUBLE) THEN -l_quantity
              WHEN l_discount < CAST(0.005 AS DOUBLE) THEN CAST(0 AS DOUBLE)
              ELSE l_quantity END AS units,
         l_discount >= CAST(0.095 AS DOUBLE) AS on_promotion
  FROM lineitem),
stores AS (
  SELECT s_suppkey AS store_id, n_regionkey AS cluster
  FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey),
products AS (
  SELECT p_partkey AS product_id,
         CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'LARGE' THEN 2 WHEN 'MEDIUM' THEN 3
                     WHEN 'PROMO' THEN 4 WHEN 'SMALL' THEN 5 WHEN 'STANDARD' THEN 6 ELSE 0
         END AS product_class,
         CASE WHEN p_size <= 25 THEN 1 ELSE 0 END AS perishable
  FROM part),
order_days AS (
  SELECT CAST(o_orderdate AS DATE) AS date, CAST(round(o_totalprice * 100) AS BIGINT) AS cents
  FROM orders),
holidays AS (
  SELECT date, type, month(date) IN (6, 12) AS transferred
  FROM (SELECT DISTINCT date,
               CASE WHEN day(date) = 1 THEN 'Holiday' WHEN day(date) = 25 THEN 'Event'
                    WHEN day(date) = 15 THEN 'Work Day' END AS type
        FROM order_days)
  WHERE type IS NOT NULL),
holiday_daily AS (
  SELECT date, bool_or(type IN ('Holiday', 'Event') AND NOT transferred) AS is_holiday_event
  FROM holidays GROUP BY date),
oil_raw AS (
  SELECT date, CASE WHEN isodow(date) <= 5
                    THEN CAST(CAST(sum(cents) AS BIGINT) // (count(*) * 1000) AS DOUBLE) / 100 END AS price
  FROM order_days WHERE isodow(date) <= 6 GROUP BY date),
oil_known AS (
  SELECT date, last_value(price IGNORE NULLS) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS price
  FROM oil_raw),
oil_daily AS (
  SELECT s.date, o.price AS looked_up,
         coalesce(last_value(o.price IGNORE NULLS) OVER (ORDER BY s.date ROWS UNBOUNDED PRECEDING),
                  first_value(o.price IGNORE NULLS) OVER (ORDER BY s.date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
         ) AS oil_price
  FROM (SELECT DISTINCT date FROM sales) s LEFT JOIN oil_known o ON s.date = o.date),
transactions AS (
  SELECT CAST(l_shipdate AS DATE) AS date, l_suppkey AS store_id,
         CAST(count(DISTINCT l_orderkey) AS DOUBLE) AS store_transactions
  FROM lineitem WHERE l_tax >= CAST(0.005 AS DOUBLE) GROUP BY ALL),
fact AS (
  SELECT s.store_id, s.product_id, s.date, s.units,
         coalesce(lower(s.onpromotion) = 'true', false) AS on_promotion,
         st.cluster, p.product_class, p.perishable, t.store_transactions,
         coalesce(h.is_holiday_event, false) AS is_holiday_event,
         o.oil_price, CASE WHEN o.looked_up IS NULL THEN 1 ELSE 0 END AS oil_price_missing_flag
  FROM sales s
  LEFT JOIN stores st ON s.store_id = st.store_id
  LEFT JOIN products p ON s.product_id = p.product_id
  LEFT JOIN transactions t ON s.store_id = t.store_id AND s.date = t.date
  LEFT JOIN holiday_daily h ON s.date = h.date
  LEFT JOIN oil_daily o ON s.date = o.date),
store_days AS (SELECT DISTINCT store_id, date FROM sales),
weather AS (
  SELECT store_id, date,
         CAST((dayofyear(date) * 7 + store_id * 3) % 300 AS DOUBLE) / 10 AS weather_temp_mean,
         CAST((dayofyear(date) + store_id) % 50 AS DOUBLE) / 10 AS weather_precip_sum,
         CAST((dayofyear(date) * 3 + store_id) % 400 AS DOUBLE) / 10 AS weather_wind_max
  FROM store_days),
events_in AS (
  SELECT date, 'City Day' AS event_name, CAST(NULL AS BIGINT) AS store_id, CAST(1.5 AS DOUBLE) AS event_intensity
  FROM (SELECT DISTINCT date FROM sales) WHERE day(date) = 20 AND month(date) IN (3, 9)
  UNION ALL
  SELECT d.date, e.name, d.store_id, CAST(e.strength AS DOUBLE)
  FROM store_days d JOIN supplier ON d.store_id = s_suppkey,
       (VALUES ('Shop Day', 1.2, 0), ('Fair', 1.1, 1)) e(name, strength, odd_only)
  WHERE month(d.date) = 8 AND day(d.date) = s_nationkey + 1 AND (e.odd_only = 0 OR d.store_id % 2 = 1)),
base AS (
  SELECT cluster, date, sum(units) AS units, avg(on_promotion::INT) AS promo_rate,
         avg(is_holiday_event::INT) AS holiday_rate, round(avg(oil_price), 6) AS oil_price,
         avg(store_transactions) AS avg_store_transactions
  FROM fact WHERE cluster IS NOT NULL AND date IS NOT NULL AND units IS NOT NULL
  GROUP BY cluster, date),
frame AS (
  SELECT * FROM (
    SELECT *, isodow(date) - 1 AS day_of_week, day(date) AS day_of_month, month(date) AS month,
      weekofyear(date) AS week_of_year, (day(date) = 1)::INT AS is_month_start,
      (date = last_day(date))::INT AS is_month_end,
      lag(units, 7) OVER w AS lag_7, lag(units, 14) OVER w AS lag_14, lag(units, 28) OVER w AS lag_28,
      CASE WHEN count(units) OVER w7 >= 3 THEN avg(units) OVER w7 END AS rolling_mean_7,
      CASE WHEN count(units) OVER w28 >= 7 THEN avg(units) OVER w28 END AS rolling_mean_28,
      CASE WHEN count(units) OVER w28 >= 7 THEN stddev_samp(units) OVER w28 END AS rolling_std_28
    FROM base
    WINDOW w AS (PARTITION BY cluster ORDER BY date),
           w7 AS (PARTITION BY cluster ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING),
           w28 AS (PARTITION BY cluster ORDER BY date ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING))
  WHERE units IS NOT NULL AND promo_rate IS NOT NULL AND holiday_rate IS NOT NULL
    AND oil_price IS NOT NULL AND avg_store_transactions IS NOT NULL AND lag_7 IS NOT NULL
    AND lag_14 IS NOT NULL AND lag_28 IS NOT NULL AND rolling_mean_7 IS NOT NULL
    AND rolling_mean_28 IS NOT NULL AND rolling_std_28 IS NOT NULL),
any_day AS (
  SELECT cluster, date, sum(units) AS units, bool_or(on_promotion) AS on_promotion,
         bool_or(is_holiday_event) AS is_holiday_event
  FROM fact GROUP BY cluster, date),
promo_day AS (
  SELECT cluster, date, on_promotion, avg(units) AS units FROM fact GROUP BY cluster, date, on_promotion)
"""


def with_base(select: str) -> str:
    return BASE + select


def with_more(ctes: str, select: str) -> str:
    return BASE + "," + ctes + select
