"""The domain tables as SQL over the driver's tables, in front of every check query."""

from __future__ import annotations

_EVENT_RATING = "CASE WHEN event_type <> 'error' THEN CAST(1 + CAST(floor(value) AS BIGINT) % 5 AS INTEGER) END"
_EVENT_DATE = "CASE WHEN event_id % 7 <> 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END"
_EVENT_NOTE = "coalesce(nullif(trim(text, ' '), ''), 'note ' || event_id)"

# Sum and count to the shown average: exact quotient, one digit, halves to the even digit.
SHOWN = "CAST(round_even(CAST({0} / nullif({1}, 0) AS DECIMAL(20,10)), 1) AS DOUBLE)"

_TABLES = f"""
places AS (
  SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, n_name AS city, r_name AS district,
    CAST(c_custkey % 90 AS DOUBLE) AS latitude, CAST(c_custkey % 180 AS DOUBLE) AS longitude,
    CASE WHEN c_custkey % 5 = 0 THEN '  ' ELSE ' https://example.org/' || c_custkey END AS website,
    CASE c_custkey % 4 WHEN 0 THEN '+90 312 ' || lpad(CAST(c_custkey AS VARCHAR), 7, '0')
      WHEN 1 THEN '0312 ' || lpad(CAST(c_custkey AS VARCHAR), 7, '0')
      WHEN 2 THEN '(312) ' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') ELSE 'n/a' END AS phone,
    c_mktsegment AS category,
    CASE c_custkey % 3 WHEN 0 THEN ' Open until 22:00' WHEN 1 THEN 'CLOSED today'
      ELSE 'By appointment' END AS opening_hours,
    CASE WHEN c_custkey % 2 = 0 THEN '0x' || c_custkey END AS serpapi_data_id,
    CASE WHEN c_custkey % 3 = 0 THEN 'place' || c_custkey END AS google_place_id,
    TIMESTAMP '2024-01-01' + to_days(CAST(c_custkey % 365 AS INTEGER)) AS created_at,
    c_custkey, c_mktsegment
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
menu_items AS (
  SELECT l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey AS id,
    CAST(o_custkey AS VARCHAR) AS restaurant_id, p_name AS name,
    CAST(l_extendedprice AS DECIMAL(10,2)) AS price, p_type AS category
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
user_reviews AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_orderkey AS VARCHAR) AS user_id,
    CAST(o_custkey AS VARCHAR) AS restaurant_id, CAST(substring(o_orderpriority, 1, 1) AS INTEGER) AS rating,
    o_orderpriority AS comment, o_orderdate AS created_at, o_orderdate AS updated_at
  FROM orders WHERE o_orderstatus = 'F'),
ext_reviews AS (
  SELECT CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS restaurant_id,
    'Author ' || user_id AS author_name, {_EVENT_RATING} AS rating, text AS review_text,
    {_EVENT_DATE} AS review_date, CAST(json_extract(props, '$.k') AS INTEGER) AS likes,
    CASE WHEN event_id % 5 <> 0 THEN 'r' || event_id END AS provider_review_id,
    {_EVENT_NOTE} AS note,
    sha256(lower('Author ' || user_id) || '|' || coalesce(CAST({_EVENT_RATING} AS VARCHAR), '') || '|' ||
      lower({_EVENT_NOTE}) || '|' || coalesce(lower({_EVENT_DATE}), '')) AS review_hash,
    ts AS created_at, event_id
  FROM events LEFT JOIN documents ON doc_id = event_id),
favorites AS (
  SELECT json_extract_string(props, '$.k') AS user_id, CAST(user_id AS VARCHAR) AS restaurant_id,
    min(ts) AS created_at
  FROM events WHERE event_type = 'purchase' GROUP BY ALL),
users AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id, 'user' || o_orderkey AS username,
    'user' || o_orderkey || '@example.org' AS email, o_orderkey % 10 <> 0 AS is_active,
    o_orderkey % 25 = 1 AS is_admin
  FROM orders),
stats AS (
  SELECT restaurant_id, sum(rating) AS rating_sum, count(rating) AS rated_count, count(*) AS review_count
  FROM (SELECT restaurant_id, rating FROM ext_reviews
        UNION ALL SELECT restaurant_id, rating FROM user_reviews)
  GROUP BY restaurant_id)"""


def over_domain(*ctes: str, select: str) -> str:
    """A full statement: domain tables, further named steps, and the final select."""
    return "WITH " + ",".join([_TABLES, *ctes]) + "\n" + select
