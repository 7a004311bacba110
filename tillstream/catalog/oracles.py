"""The registered queries again as plain SQL over the given tables."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

TIME = "%Y-%m-%d %H:%M:%S.%f"
ISO = "%Y-%m-%dT%H:%M:%S"


def _at(column: str) -> str:
    return f"strftime({column}, '{TIME}') AS {column}"


# --- shared derivations ----------------------------------------------------------


def _cart(session_by: str = "day") -> str:
    session = "'s' || user_id || '-' || strftime(ts, '%Y%m%d')" if session_by == "day" else "'u' || user_id"
    return f"""
base AS (
  SELECT *,
    CASE event_type WHEN 'signup' THEN 'add_to_cart' WHEN 'click' THEN 'update_quantity'
      WHEN 'error' THEN 'remove_from_cart' WHEN 'view' THEN 'view_item' WHEN 'purchase' THEN 'purchase' END AS kind,
    CASE WHEN event_type = 'purchase' THEN NULL
      ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 + 1 END AS product,
    unnest(CASE WHEN event_id % 50 = 0 THEN [0, 1] ELSE [0] END) AS copy
  FROM events
), priced AS (
  SELECT *, CASE WHEN event_id % 97 = 0 THEN -1 ELSE product * 1000 END AS price,
    CAST(floor(value) AS BIGINT) % 6 + copy AS qty
  FROM base
), cart AS (
  SELECT 'evt_' || event_id AS event_id, event_id + copy * 1000000000000 AS ingest_ord, kind AS event_type, ts,
    strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS iso, {session} AS session_id,
    CASE WHEN user_id % 10 = 0 THEN NULL ELSE user_id END AS customer_id,
    CASE WHEN user_id % 17 = 0 THEN NULL ELSE (['website', 'mobile_app', 'mobile_web'])[user_id % 3 + 1] END AS source,
    CASE WHEN user_id % 17 = 0 THEN NULL ELSE (['desktop', 'mobile', 'tablet'])[(user_id + 1) % 3 + 1] END AS device,
    CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'https://example.com' END AS referrer,
    CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'newsletter' END AS utm_source,
    CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'email' END AS utm_medium,
    CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'spring' END AS utm_campaign,
    product AS product_id, 'Product ' || product AS product_name, price, 
    CASE WHEN event_id % 211 = 0 THEN NULL ELSE qty END AS quantity,
    price * qty + CASE WHEN event_id % 193 = 0 THEN 7 ELSE 0 END AS line_total, price * qty AS unit_total
  FROM priced
)"""


CLEAN = """
clean AS (
  SELECT event_id, ingest_ord, session_id, customer_id, event_type, ts, CAST(ts AS DATE) AS d, source, device, product_id,
    coalesce(utm_source, 'unknown') AS utm_source, coalesce(utm_medium, 'unknown') AS utm_medium,
    coalesce(utm_campaign, 'unknown') AS utm_campaign, coalesce(referrer, 'direct') AS referrer,
    CAST(coalesce(price, 0) AS DOUBLE) AS product_price_vnd, round(coalesce(price, 0) / 24000.0, 6) AS product_price_usd,
    CAST(coalesce(quantity, 0) AS DOUBLE) AS quantity, CAST(coalesce(line_total, 0) AS DOUBLE) AS line_total_vnd,
    round(coalesce(unit_total, 0) / 24000.0, 6) AS line_total_usd
  FROM cart
  WHERE customer_id IS NOT NULL AND event_type IS NOT NULL AND coalesce(price, 0) >= 0 AND coalesce(quantity, 0) >= 0
)"""
DEDUP = """
dedup AS (
  SELECT * FROM clean QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ingest_ord) = 1
)"""
SESS = """
sess AS (
  SELECT session_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS total_events,
    string_agg(event_type, ',' ORDER BY ts, ingest_ord) AS event_journey,
    first(customer_id ORDER BY ts, ingest_ord) FILTER (WHERE customer_id IS NOT NULL) AS customer_id,
    first(source ORDER BY ts, ingest_ord) FILTER (WHERE source IS NOT NULL) AS source,
    first(device ORDER BY ts, ingest_ord) FILTER (WHERE device IS NOT NULL) AS device,
    (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS session_duration_seconds,
    false AS has_purchase, bool_or(event_type = 'purchase') AS has_purchase_event
  FROM dedup GROUP BY session_id
)"""
EVENT_OUT = f"""
  event_id, ingest_ord, session_id, customer_id, event_type, strftime(ts, '{TIME}') AS timestamp,
  CAST(d AS VARCHAR) AS date, hour(ts) AS hour, utm_source, utm_medium, utm_campaign, referrer, product_id,
  product_price_vnd, product_price_usd, quantity, line_total_vnd, line_total_usd"""
RAW_OUT = "event_id, ingest_ord, session_id, customer_id, event_type, iso AS timestamp, source, device"
ENRICHED = f"""
SELECT event_id, e.session_id, CAST(d AS VARCHAR) AS date,
  row_number() OVER (PARTITION BY e.session_id ORDER BY ts, ingest_ord) AS event_sequence_num,
  strftime(session_start, '{TIME}') AS session_start, strftime(session_end, '{TIME}') AS session_end,
  session_duration_seconds, total_events, event_journey
FROM dedup e JOIN sess s ON e.session_id = s.session_id"""

ONLINE = f"""
online0 AS (
  SELECT *, CAST(floor(o_totalprice) AS BIGINT) AS subtotal, (o_custkey % 4) * 10000 AS shipping_fee FROM orders
), online AS (
  SELECT 'ORD' || o_orderkey AS order_id, o_orderkey AS ingest_ord, 'TXN' || o_orderkey AS transaction_id,
    o_custkey AS customer_id,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'shopify' WHEN '2-HIGH' THEN 'website' WHEN '3-MEDIUM' THEN 'mobile_app'
      WHEN '4-NOT SPECIFIED' THEN 'lazada' ELSE 'shopee' END AS channel,
    strftime(o_orderdate, '{ISO}') AS created_at,
    CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'processing' ELSE 'cancelled' END AS status,
    CASE o_orderstatus WHEN 'F' THEN 'paid' WHEN 'O' THEN 'pending'
      ELSE CASE WHEN o_orderkey % 7 = 0 THEN 'paid' ELSE 'cancelled' END END AS payment_status,
    (['cod', 'bank_transfer', 'momo', 'zalopay'])[o_custkey % 4 + 1] AS payment_method,
    subtotal, subtotal // 10 + CASE WHEN o_orderkey % 101 = 0 THEN 1 ELSE 0 END AS tax_amount, shipping_fee,
    subtotal + subtotal // 10 + CASE WHEN o_orderkey % 101 = 0 THEN 1 ELSE 0 END + shipping_fee
      + CASE WHEN o_orderkey % 103 = 0 THEN 5 ELSE 0 END AS total
  FROM online0
)"""
LINES = """
lines0 AS (
  SELECT 'ORD' || l_orderkey AS order_id, l_partkey AS product_id, CAST(l_linenumber AS BIGINT) AS line_number,
    l_orderkey * 100 + l_linenumber AS ingest_ord, CAST(floor(l_quantity) AS BIGINT) AS quantity,
    CAST(floor(l_extendedprice / l_quantity) AS BIGINT) AS unit_price,
    CAST(round(l_discount * 100) AS BIGINT) AS discount_percent
  FROM lineitem
), lines1 AS (
  SELECT *, (unit_price * quantity * discount_percent) // 100 AS expected_discount,
    (unit_price * quantity * discount_percent) // 100
      + CASE WHEN product_id % 13 = 0 AND line_number = 7 THEN 1 ELSE 0 END AS discount_amount
  FROM lines0
), lines AS (
  SELECT *, unit_price * quantity - discount_amount AS line_total,
    unit_price * quantity - expected_discount AS expected_line_total
  FROM lines1
)"""
CUSTOMERS = """
customers AS (
  SELECT c_custkey AS id, c_name AS full_name, c_mktsegment AS city, n_name AS country, c_acctbal AS balance
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
)"""
PRODUCTS = """
products AS (
  SELECT p_partkey AS id, p_name AS name, p_type AS category, p_brand AS brand,
    CAST(floor(p_retailprice * 100) AS BIGINT) AS price_vnd, p_retailprice AS price_usd,
    CAST(p_size AS BIGINT) AS stock_quantity
  FROM part
)"""
STAFF = """
staff AS (
  SELECT s_suppkey AS id, 'NV' || lpad(CAST(s_suppkey AS VARCHAR), 4, '0') AS code, s_name AS full_name,
    (['Store Manager', 'Sales Associate', 'Cashier', 'Stock Manager'])[s_nationkey % 4 + 1] AS position,
    CASE WHEN s_acctbal < 0 THEN 'inactive' ELSE 'active' END AS status
  FROM supplier
)"""
SHOPS = """
shops AS (
  SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, r_name AS country, n_name AS city,
    CASE r_name WHEN 'EUROPE' THEN 'EUR' WHEN 'AMERICA' THEN 'USD' ELSE 'VND' END AS currency_code
  FROM nation LEFT JOIN region ON n_regionkey = r_regionkey
)"""
FEE = "CAST(CAST(0.034 AS DECIMAL(4,3)) * CAST(o_totalprice AS DECIMAL(18,2)) + 0.30 AS DECIMAL(18,2))"
PAYPAL = f"""
paypal AS (
  SELECT CASE WHEN o_orderstatus = 'P' THEN 'GTW' ELSE 'TXN' END || o_orderkey AS transaction_id,
    o_orderkey AS ingest_ord, CAST(1000000000 + o_orderkey AS VARCHAR) AS paypal_transaction_id,
    strftime(o_orderdate, '{ISO}') AS transaction_initiation_date, CAST(o_totalprice AS DECIMAL(18,2)) AS amount,
    {FEE} AS expected_fee, {FEE} + CASE WHEN o_orderkey % 89 = 0 THEN 0.05 ELSE 0.00 END AS fee,
    CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'PENDING' ELSE 'FAILED' END AS transaction_status
  FROM orders
)"""
MERCURY = f"""
mercury0 AS (
  SELECT *, (['incomingAch', 'outgoingAch', 'incomingDomesticWire', 'outgoingDomesticWire', 'fee',
      'debitCardPurchase', 'internalTransfer'])[o_custkey % 7 + 1] AS kind,
    CAST(o_totalprice AS DECIMAL(18,2)) - {FEE} AS net
  FROM orders
), mercury AS (
  SELECT CASE WHEN o_orderpriority = '5-LOW' THEN 'BNK' ELSE 'TXN' END || o_orderkey AS transaction_id,
    o_orderkey AS ingest_ord, 'ACC' || (o_custkey % 3) AS account_id, kind,
    CASE WHEN o_custkey % 11 = 0 THEN net + 1 ELSE net END AS amount_usd,
    CASE WHEN kind IN ('incomingAch', 'incomingDomesticWire') OR o_orderkey % 97 = 0 THEN net ELSE -net END AS amount,
    strftime(o_orderdate, '{ISO}') || 'Z' AS created_at,
    CASE o_orderstatus WHEN 'F' THEN 'posted' WHEN 'O' THEN 'pending' ELSE 'failed' END AS status
  FROM mercury0
)"""
MOMO = f"""
momo0 AS (
  SELECT *, CAST(floor(o_totalprice) AS BIGINT) AS amount, 2000000000000 + o_orderkey AS trans FROM orders
), momo AS (
  SELECT 'TXN' || (o_orderkey * 3) AS transaction_id, o_orderkey AS ingest_ord, 'MERCHANT01' AS "partnerCode",
    'ORD' || o_orderkey AS "orderId", 'MOMO' || o_orderkey AS "requestId", amount, trans AS "transId",
    CAST(CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 10 ELSE 99 END AS BIGINT) AS "resultCode",
    CASE o_orderstatus WHEN 'F' THEN 'Thanh cong' WHEN 'O' THEN 'He thong dang bao tri'
      ELSE 'Loi khong xac dinh' END AS message,
    (['qr', 'webApp', 'credit', 'napas'])[o_custkey % 4 + 1] AS "payType", epoch_ms(o_orderdate) AS "responseTime",
    strftime(o_orderdate, '{ISO}') AS "responseTimeISO", 'TS' || (o_custkey % 50) AS store_id,
    sha256(trans || 'ORD' || o_orderkey || CASE WHEN o_orderkey % 83 = 0 THEN amount + 1 ELSE amount END) AS signature,
    CASE WHEN o_orderkey % 10 = 0 THEN CASE WHEN o_orderkey % 20 = 0 THEN amount // 2 ELSE amount END END AS refunded
  FROM momo0
)"""
ZALO = f"""
zalo0 AS (
  SELECT *, CAST(floor(o_totalprice) AS BIGINT) AS amount, 200000000000000 + o_orderkey AS zp,
    strftime(o_orderdate, '%y%m%d') || CASE WHEN o_orderkey % 113 = 0 THEN '-' ELSE '_' END
      || lpad(CAST(o_orderkey AS VARCHAR), greatest(6, length(CAST(o_orderkey AS VARCHAR)))::INT, '0') AS app_trans
  FROM orders
), zalo AS (
  SELECT 'TXN' || (o_orderkey * 5) AS transaction_id, o_orderkey AS ingest_ord, o_custkey AS customer_id,
    CAST(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 3 ELSE 2 END AS BIGINT) AS return_code,
    CASE o_orderstatus WHEN 'F' THEN 'Thanh cong' WHEN 'O' THEN 'Dang xu ly' ELSE 'That bai' END AS return_message,
    CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS BIGINT) AS sub_return_code,
    CASE WHEN o_orderstatus = 'F' THEN 'Merchant balance updated' ELSE '' END AS sub_return_message,
    o_orderstatus = 'O' AS is_processing, amount,
    CASE WHEN o_orderkey % 5 = 0 THEN amount // 20 ELSE 0 END AS discount_amount, zp AS zp_trans_id,
    app_trans AS app_trans_id, epoch_ms(o_orderdate) AS server_time, strftime(o_orderdate, '{ISO}') AS server_time_iso,
    o_custkey % 8 + 35 AS channel, (['VCB', 'ACB', '', 'MB', NULL])[o_custkey % 5 + 1] AS bank_code,
    sha256(zp || '|' || app_trans || '|' || CASE WHEN o_orderkey % 79 = 0 THEN amount + 1 ELSE amount END) AS mac,
    CASE WHEN o_orderkey % 10 = 1 THEN amount // 2 END AS refunded
  FROM zalo0
)"""
SHOPIFY = f"""
shopify AS (
  SELECT o_orderkey AS id, o_orderkey AS ingest_ord, 'TXN' || (o_orderkey // 2) AS transaction_id,
    'ORD-' || strftime(o_orderdate, '%Y%m%d') || '-' || lpad(CAST(o_orderkey AS VARCHAR), greatest(6, length(CAST(o_orderkey AS VARCHAR)))::INT, '0') AS order_number,
    o_custkey AS customer_id, strftime(o_orderdate, '{ISO}') AS order_date,
    CASE o_orderstatus WHEN 'F' THEN 'paid' WHEN 'O' THEN 'pending' ELSE 'refunded' END AS payment_status,
    CAST(floor(o_totalprice) AS BIGINT) AS subtotal_vnd, CAST(floor(o_totalprice) AS BIGINT) // 10 AS tax_vnd,
    (o_custkey % 3) * 30000 AS shipping_vnd,
    CAST(floor(o_totalprice) AS BIGINT) + CAST(floor(o_totalprice) AS BIGINT) // 10 + (o_custkey % 3) * 30000
      + CASE WHEN o_orderkey % 107 = 0 THEN 1 ELSE 0 END AS total_vnd,
    'online' AS channel
  FROM orders
)"""
SAPO = f"""
sapo0 AS (
  SELECT *, CAST(floor(o_totalprice) AS BIGINT) AS total_before_vat, (o_custkey % 6) * 500 AS total_discount,
    CAST(round_even((CAST(floor(o_totalprice) AS BIGINT) // 10) / 1000, 0) * 1000 AS BIGINT) AS expected_vat
  FROM orders
), sapo AS (
  SELECT o_orderkey AS id, o_orderkey AS ingest_ord, 'TXN' || o_custkey AS transaction_id,
    'HD' || strftime(o_orderdate, '%y%m%d') || lpad(CAST(o_orderkey AS VARCHAR), greatest(6, length(CAST(o_orderkey AS VARCHAR)))::INT, '0') AS code,
    o_custkey % 20 AS location_id, strftime(o_orderdate, '{ISO}') AS created_on,
    CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'cancelled' ELSE 'refunded' END AS status,
    o_custkey AS customer_id, total_before_vat, expected_vat,
    expected_vat + CASE WHEN o_orderkey % 109 = 0 THEN 1000 ELSE 0 END AS vat_amount,
    total_before_vat + expected_vat + CASE WHEN o_orderkey % 109 = 0 THEN 1000 ELSE 0 END AS total_vnd,
    'retail_offline' AS channel
  FROM sapo0
)"""
ODOO = """
odoo AS (SELECT 'TXN' || (o_orderkey * 7) AS transaction_id, o_orderkey AS ingest_ord FROM orders)"""


def _sql(name: str, *parts: str, recursive: bool = False) -> None:
    """Register ``parts[-1]`` with the other parts as common table expressions."""
    *ctes, select = parts
    ORACLES[name] = (f"WITH {'RECURSIVE ' if recursive else ''}" + ",".join(ctes) if ctes else "") + "\n" + select


def _cents(x: str) -> str:
    """A double of at least 0, rounded to cents by its exact binary digits, ties to the even cent."""
    digits = f"format('{{:.60f}}', CAST({x} AS DOUBLE))"
    cut, rest = f"left({digits}, length({digits}) - 58)", f"right({digits}, 58)"
    tie = "'5' || repeat('0', 57)"
    up = f"({rest} > {tie} OR ({rest} = {tie} AND CAST(right({cut}, 1) AS INT) % 2 = 1))"
    return f"CAST(CAST({cut} AS DECIMAL(30,2)) + CASE WHEN {up} THEN 0.01 ELSE 0.00 END AS DOUBLE)"


def _thousands(x: str) -> str:
    return f"CAST(({x}) // 1000 + CASE WHEN ({x}) % 1000 > 500 OR (({x}) % 1000 = 500 AND ({x}) // 1000 % 2 = 1) THEN 1 ELSE 0 END AS BIGINT) * 1000"


PREPARED = (_cart(), CLEAN, DEDUP)
SESSIONS = (*PREPARED, SESS)

# --- pipeline --------------------------------------------------------------------

_sql("clean_events", _cart(), CLEAN, f"SELECT {EVENT_OUT} FROM clean")
_sql("dedup_events", *PREPARED, f"SELECT {EVENT_OUT} FROM dedup")
_sql("stream_exact_events", *PREPARED, f"SELECT {EVENT_OUT} FROM dedup")
_sql("new_events", *PREPARED, f"SELECT event_id, strftime(ts, '{TIME}') AS timestamp FROM dedup WHERE d >= DATE '2024-01-15'")
_sql(
    "run_statistics",
    *PREPARED,
    """SELECT (SELECT count(*) FROM cart) AS processed_events,
  (SELECT count(*) FROM cart) - (SELECT count(*) FROM clean) AS invalid_events,
  (SELECT count(*) FROM clean) - count(*) AS duplicate_events, count(*) AS cleaned_events,
  count(DISTINCT session_id) AS unique_sessions, count(DISTINCT customer_id) AS unique_customers,
  CAST(min(d) AS VARCHAR) AS first_date, CAST(max(d) AS VARCHAR) AS last_date FROM dedup""",
)
ORACLES["pipeline_run_statistics"] = ORACLES["run_statistics"]
_sql(
    "event_sequence",
    *PREPARED,
    """SELECT event_id, session_id,
  row_number() OVER (PARTITION BY session_id ORDER BY ts, ingest_ord) AS event_sequence_num FROM dedup""",
)
SESSION_OUT = f"SELECT * REPLACE (strftime(session_start, '{TIME}') AS session_start, strftime(session_end, '{TIME}') AS session_end) FROM sess"
_sql("session_metrics", *SESSIONS, SESSION_OUT)
_sql("pipeline_session_table", *SESSIONS, SESSION_OUT)
_sql("enriched_events", *SESSIONS, ENRICHED)
_sql("pipeline_events_table", *SESSIONS, ENRICHED)
_sql(
    "pipeline_rerun_smaller",
    _cart(),
    CLEAN,
    "\nearly AS (SELECT * FROM clean WHERE ts < TIMESTAMP '2024-01-05')",
    DEDUP.replace("FROM clean", "FROM early"),
    SESS,
    ENRICHED,
)
# an id's first copy is the first of the earlier batch
APPENDED = (_cart(), CLEAN, DEDUP.replace("ORDER BY ingest_ord", "ORDER BY ts >= TIMESTAMP '2024-01-16', ingest_ord"), SESS)
_sql("pipeline_append", *APPENDED, ENRICHED)
_sql("pipeline_append_sessions", *APPENDED, SESSION_OUT)
_sql("stream_as_of_batch", *SESSIONS, ENRICHED)

# four deliveries by hour of the day; an event's second copy comes one delivery after the first
DELIVERY = "least(hour(ts) // 6 + CASE WHEN ingest_ord >= 1000000000000 THEN 1 ELSE 0 END, 3) AS delivery"
_sql(
    "stream_as_of_deliveries",
    _cart(),
    CLEAN,
    f"""
delivered AS (SELECT *, {DELIVERY} FROM clean
), dedup AS (
  SELECT * FROM delivered QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY delivery, ingest_ord) = 1
), batches AS (SELECT DISTINCT session_id, delivery FROM dedup
), known AS (
  SELECT b.session_id, b.delivery, min(e.ts) AS session_start, max(e.ts) AS session_end, count(*) AS total_events,
    (epoch_us(max(e.ts)) - epoch_us(min(e.ts))) / 1e6 AS session_duration_seconds,
    string_agg(e.event_type, ',' ORDER BY e.delivery, e.ts, e.ingest_ord) AS event_journey
  FROM batches b JOIN dedup e ON e.session_id = b.session_id AND e.delivery <= b.delivery
  GROUP BY b.session_id, b.delivery
)""",
    f"""SELECT event_id, e.session_id, CAST(d AS VARCHAR) AS date,
  row_number() OVER (PARTITION BY e.session_id, e.delivery ORDER BY ts, ingest_ord) AS event_sequence_num,
  strftime(session_start, '{TIME}') AS session_start, strftime(session_end, '{TIME}') AS session_end,
  session_duration_seconds, total_events, event_journey
FROM dedup e JOIN known k ON e.session_id = k.session_id AND e.delivery = k.delivery""",
)
_sql(
    "stream_run_counters",
    *PREPARED,
    """SELECT (SELECT count(*) FROM cart) AS processed_events,
  (SELECT count(*) FROM cart) - (SELECT count(*) FROM clean) AS invalid_events, 0 AS unreadable_events,
  (SELECT count(*) FROM clean) - (SELECT count(*) FROM dedup) AS duplicate_events,
  (SELECT count(*) FROM dedup) AS stored_events""",
)
_sql(
    "stream_late_events",
    _cart(),
    f"""
delivered AS (SELECT *, {DELIVERY} FROM cart
), newest AS (SELECT delivery, max(ts) AS newest FROM delivered GROUP BY delivery
), marks AS (
  SELECT n.delivery, max(b.newest) - INTERVAL 1 DAY AS mark FROM newest n JOIN newest b ON b.delivery < n.delivery GROUP BY n.delivery
)""",
    """SELECT event_id, ingest_ord, session_id, iso AS timestamp
FROM delivered JOIN marks USING (delivery) WHERE ts <= mark""",
)
_sql(
    "journey_parts",
    *PREPARED,
    """, hours AS (
  SELECT session_id, date_trunc('hour', ts) AS h, count(*) AS events,
    string_agg(event_type, ',' ORDER BY ts, ingest_ord) AS journey_part
  FROM dedup GROUP BY ALL
)
SELECT session_id, row_number() OVER w AS part_no,
  CAST(coalesce(sum(events) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS BIGINT) AS first_sequence_num,
  events, journey_part
FROM hours WINDOW w AS (PARTITION BY session_id ORDER BY h)""",
)
DAILY = """, types AS (
  SELECT d, string_agg(event_type || ':' || n, ',' ORDER BY event_type) AS event_type_distribution
  FROM (SELECT d, event_type, count(*) AS n FROM dedup GROUP BY ALL) GROUP BY d
), days AS (
  SELECT d, count(*) AS total_events, count(DISTINCT session_id) AS unique_sessions,
    count(DISTINCT customer_id) AS unique_customers FROM dedup GROUP BY d
)
SELECT CAST(d AS VARCHAR) AS date, total_events, unique_sessions, unique_customers"""
_sql("daily_summary", *PREPARED, DAILY + ", event_type_distribution FROM days JOIN types USING (d)")
_sql("pipeline_summary_csv", *PREPARED, DAILY + ", event_type_distribution FROM days JOIN types USING (d)")

_sql(
    "event_epochs",
    _cart(),
    "SELECT event_id, ingest_ord, epoch_us(ts) // 1000 AS timestamp_unix, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') AS iso FROM cart",
)
_sql(
    "name_parts",
    """SELECT p_partkey AS id, array_to_string(string_split(p_name, ' ')[:-2], ' ') AS first_name,
  string_split(p_name, ' ')[-1] AS last_name FROM part""",
)

# --- metrics ---------------------------------------------------------------------

_sql(
    "session_duration_stats",
    *SESSIONS,
    """SELECT round(avg(session_duration_seconds), 4) AS average_duration_seconds,
  round(median(session_duration_seconds), 4) AS median_duration_seconds,
  round(min(session_duration_seconds), 4) AS min_duration_seconds,
  round(max(session_duration_seconds), 4) AS max_duration_seconds,
  round(stddev_samp(session_duration_seconds), 4) AS std_duration_seconds, count(*) AS total_sessions,
  round(avg(session_duration_seconds) / 60, 4) AS average_duration_minutes,
  round(median(session_duration_seconds) / 60, 4) AS median_duration_minutes FROM sess""",
)
INTENT = """, intent AS (
  SELECT session_id, count(*) AS event_count,
    count(*) >= 2 AND bool_or(event_type = 'add_to_cart')
      AND last(event_type ORDER BY ts, ingest_ord) = 'add_to_cart' AS has_purchase_intent
  FROM dedup GROUP BY session_id
)
"""
_sql("purchase_intent_sessions", *PREPARED, INTENT + "SELECT * FROM intent")
_sql(
    "purchase_intent",
    *PREPARED,
    INTENT
    + """SELECT count(*) AS total_sessions, count(*) FILTER (WHERE has_purchase_intent) AS sessions_with_purchase_intent,
  round(count(*) FILTER (WHERE has_purchase_intent) * 100.0 / count(*), 4)::DOUBLE AS purchase_intent_rate FROM intent""",
)
_sql(
    "event_stats",
    *PREPARED,
    """SELECT count(*) AS total_events, count(DISTINCT session_id) AS unique_sessions,
  count(DISTINCT customer_id) AS unique_customers, count(DISTINCT product_id) AS unique_products,
  round(count(*) / count(DISTINCT session_id), 4) AS average_events_per_session FROM dedup""",
)
for _column in ("event_type", "source", "device"):
    _sql(
        f"{_column}_distribution",
        *PREPARED,
        f"""SELECT {_column}, count(*) AS events,
  round(CAST(count(*) * 100.0 AS DOUBLE) / (SELECT count(*) FROM dedup), 4) AS percentage
FROM dedup WHERE {_column} IS NOT NULL GROUP BY {_column}""",
    )
PATTERNS = """SELECT string_agg(event_type, ' -> ' ORDER BY ts, ingest_ord) AS journey_pattern FROM dedup GROUP BY session_id"""
TOP_PATTERNS = f"SELECT journey_pattern, count(*) AS sessions FROM ({PATTERNS}) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"
_sql("journey_patterns", *PREPARED, TOP_PATTERNS)
_sql(
    "journey_length",
    *PREPARED,
    """SELECT round(avg(n), 4) AS average_journey_length, max(n) AS max_journey_length, min(n) AS min_journey_length
FROM (SELECT count(*) AS n FROM dedup GROUP BY session_id)""",
)
_sql("events_by_date", *PREPARED, "SELECT CAST(d AS VARCHAR) AS date, count(*) AS events FROM dedup GROUP BY d")
_sql("events_by_hour", *PREPARED, "SELECT hour(ts) AS hour, count(*) AS events FROM dedup GROUP BY 1")
_sql("events_by_dow", *PREPARED, "SELECT dayname(ts) AS day_of_week, count(*) AS events FROM dedup GROUP BY 1")
_sql(
    "sessions_by_date",
    *PREPARED,
    "SELECT CAST(d AS VARCHAR) AS date, count(DISTINCT session_id) AS sessions FROM dedup GROUP BY d",
)
_sql(
    "conversion_by_source",
    *PREPARED,
    """SELECT source, count(DISTINCT session_id) AS unique_sessions,
  count(*) FILTER (WHERE event_type = 'add_to_cart') AS add_to_cart_events
FROM dedup WHERE source IS NOT NULL GROUP BY source""",
)
_sql(
    "longest_sessions",
    *SESSIONS,
    """SELECT session_id, total_events, session_duration_seconds FROM sess
ORDER BY session_duration_seconds DESC, session_id LIMIT 10""",
)
_sql(
    "metrics_json",
    *PREPARED,
    f"""SELECT 'events_by_hour' AS metric, '{{"hour":' || hour(ts) || ',"events":' || count(*) || '}}' AS value
FROM dedup GROUP BY hour(ts)
UNION ALL SELECT 'events_by_day_of_week', '{{"day_of_week":"' || dayname(ts) || '","events":' || count(*) || '}}'
FROM dedup GROUP BY dayname(ts)
UNION ALL SELECT 'sessions_by_date', '{{"date":"' || d || '","sessions":' || count(DISTINCT session_id) || '}}'
FROM dedup GROUP BY d
UNION ALL SELECT 'journey_patterns', '{{"journey_pattern":"' || journey_pattern || '","sessions":' || sessions || '}}'
FROM ({TOP_PATTERNS})""",
)



def _values(metric: str, item: str | None, select: str) -> str:
    """One metric's rows as (metric, item, measure, value)."""
    known = f"CAST({item} AS VARCHAR)" if item else "CAST(NULL AS VARCHAR)"
    left_out = f"* EXCLUDE ({item})" if item else "*"
    typed = f"SELECT {known} AS item, CAST(COLUMNS({left_out}) AS DOUBLE) FROM ({select})"
    return f"""SELECT '{metric}' AS metric, item, measure, round(value, 6) AS value
FROM (UNPIVOT ({typed}) ON COLUMNS(* EXCLUDE (item)) INTO NAME measure VALUE value)"""


_DURATION = "session_duration_seconds"
METRIC_VALUES = [
    (
        "session_duration_stats",
        None,
        f"""SELECT avg({_DURATION}) AS average_duration_seconds, median({_DURATION}) AS median_duration_seconds,
  min({_DURATION}) AS min_duration_seconds, max({_DURATION}) AS max_duration_seconds, stddev_samp({_DURATION}) AS std_duration_seconds,
  count(*) AS total_sessions, avg({_DURATION}) / 60 AS average_duration_minutes, median({_DURATION}) / 60 AS median_duration_minutes FROM sess""",
    ),
    (
        "purchase_intent",
        None,
        """SELECT count(*) AS total_sessions, count(*) FILTER (WHERE has_purchase_intent) AS sessions_with_purchase_intent,
  count(*) FILTER (WHERE has_purchase_intent) * 100.0::DOUBLE / count(*) AS purchase_intent_rate FROM intent""",
    ),
    (
        "event_stats",
        None,
        """SELECT count(*) AS total_events, count(DISTINCT session_id) AS unique_sessions, count(DISTINCT customer_id) AS unique_customers,
  count(DISTINCT product_id) AS unique_products, count(*)::DOUBLE / count(DISTINCT session_id) AS average_events_per_session FROM dedup""",
    ),
    *[
        (
            f"{c}_distribution",
            c,
            f"""SELECT {c}, count(*) AS events, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM dedup) AS percentage
  FROM dedup WHERE {c} IS NOT NULL GROUP BY {c}""",
        )
        for c in ("event_type", "source", "device")
    ],
    (
        "journey_length",
        None,
        """SELECT avg(n) AS average_journey_length, max(n) AS max_journey_length, min(n) AS min_journey_length
  FROM (SELECT count(*) AS n FROM dedup GROUP BY session_id)""",
    ),
    ("journey_patterns", "journey_pattern", TOP_PATTERNS),
    ("events_by_date", "date", "SELECT d AS date, count(*) AS events FROM dedup GROUP BY d"),
    ("events_by_hour", "hour", "SELECT hour(ts) AS hour, count(*) AS events FROM dedup GROUP BY 1"),
    ("events_by_day_of_week", "day_of_week", "SELECT dayname(ts) AS day_of_week, count(*) AS events FROM dedup GROUP BY 1"),
    ("sessions_by_date", "date", "SELECT d AS date, count(DISTINCT session_id) AS sessions FROM dedup GROUP BY d"),
]
for _name in ("aggregation_report", "aggregation_files"):
    _sql(_name, *SESSIONS, INTENT + "\nUNION ALL ".join(_values(*m) for m in METRIC_VALUES))

# --- cart ------------------------------------------------------------------------

_sql(
    "cart_statistics",
    _cart(),
    f"""SELECT count(*) AS total_events, count(DISTINCT customer_id) FILTER (WHERE customer_id <> 0) AS unique_customers,
  count(DISTINCT session_id) AS unique_sessions,
  count(*) FILTER (WHERE event_type = 'add_to_cart') AS add_events,
  count(*) FILTER (WHERE event_type = 'remove_from_cart') AS remove_events,
  {_cents("count(*) FILTER (WHERE event_type = 'add_to_cart') / count(*) FILTER (WHERE event_type = 'remove_from_cart')")} AS add_remove_ratio,
  round(count(*) FILTER (WHERE event_type = 'add_to_cart') / count(*) FILTER (WHERE event_type = 'remove_from_cart'), 6)
    AS add_remove_exact FROM cart""",
)
_sql(
    "cart_distribution",
    _cart(),
    """SELECT 'event_type' AS dimension, coalesce(event_type, 'unknown') AS value, count(*) AS events FROM cart GROUP BY 2
UNION ALL SELECT 'source', coalesce(source, 'unknown'), count(*) FROM cart GROUP BY 2
UNION ALL SELECT 'device', coalesce(device, 'unknown'), count(*) FROM cart GROUP BY 2""",
)
_sql(
    "top_products_added",
    _cart(),
    """SELECT product_id, first(product_name ORDER BY ingest_ord) AS name, count(*) AS add_count,
  CAST(sum(coalesce(line_total, 0)) AS BIGINT) AS total_value_vnd
FROM cart WHERE event_type = 'add_to_cart' AND product_id <> 0
GROUP BY product_id ORDER BY add_count DESC, min(ingest_ord), product_id LIMIT 10""",
)


def _replay(events: str = "cart") -> str:
    """Cart contents by walking each (session, product) history one event at a time."""
    return f"""
moves AS (
  SELECT session_id, product_id, event_type, ingest_ord, product_name, coalesce(price, 0) AS price,
    CAST(coalesce(quantity, CASE WHEN event_type = 'update_quantity' THEN 0 ELSE 1 END) AS BIGINT) AS q,
    row_number() OVER (PARTITION BY session_id, product_id ORDER BY ts, ingest_ord) AS rn
  FROM {events}
  WHERE event_type IN ('add_to_cart', 'remove_from_cart', 'update_quantity') AND product_id <> 0
), walk AS (
  SELECT session_id, product_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS qty,
    CAST(NULL AS BIGINT) AS price, CAST(NULL AS VARCHAR) AS name, CAST(NULL AS BIGINT) AS added
  FROM (SELECT DISTINCT session_id, product_id FROM moves)
  UNION ALL
  SELECT w.session_id, w.product_id, m.rn,
    CASE WHEN m.event_type = 'add_to_cart' THEN coalesce(w.qty, 0) + m.q
      WHEN w.qty IS NULL THEN NULL
      WHEN m.event_type = 'remove_from_cart' THEN CASE WHEN w.qty - m.q > 0 THEN w.qty - m.q END
      ELSE CASE WHEN m.q > 0 THEN m.q END END,
    CASE WHEN m.event_type = 'add_to_cart' AND w.qty IS NULL THEN m.price ELSE w.price END,
    CASE WHEN m.event_type = 'add_to_cart' AND w.qty IS NULL THEN m.product_name ELSE w.name END,
    CASE WHEN m.event_type = 'add_to_cart' AND w.qty IS NULL THEN m.ingest_ord ELSE w.added END
  FROM walk w JOIN moves m ON m.session_id = w.session_id AND m.product_id = w.product_id AND m.rn = w.rn + 1
), items AS (
  SELECT session_id, product_id, name AS product_name, qty AS quantity, price AS price_vnd, added AS added_ord
  FROM walk QUALIFY row_number() OVER (PARTITION BY session_id, product_id ORDER BY rn DESC) = 1
), carts AS (
  SELECT session_id, CAST(sum(price_vnd * quantity) AS BIGINT) AS cart_value_vnd, count(*) AS item_count,
    string_agg(product_name || ':' || quantity || ':' || price_vnd, ',' ORDER BY added_ord, product_id) AS cart_items
  FROM items WHERE quantity IS NOT NULL GROUP BY session_id
), activity AS (
  SELECT session_id, max(ts) AS last_activity, first(customer_id ORDER BY ingest_ord) AS customer_id,
    min(ingest_ord) AS first_ord FROM cart GROUP BY session_id
)"""


_sql("cart_items", _cart("user"), _replay(), "SELECT * FROM items WHERE quantity IS NOT NULL", recursive=True)
ABANDONED = f"""SELECT session_id, strftime(last_activity, '{TIME}') AS last_activity, customer_id, cart_value_vnd,
  item_count, {{items}}
  CAST(floor(epoch(TIMESTAMP '2024-01-31 00:00:00' - last_activity) / 3600) AS BIGINT) AS hours_since_activity
FROM activity JOIN carts USING (session_id)
WHERE last_activity < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL {{hours}} HOUR"""
_sql(
    "abandoned_carts",
    _cart("user"),
    _replay(),
    ABANDONED.format(items="cart_items,", hours=24) + " ORDER BY cart_value_vnd DESC, first_ord LIMIT 50",
    recursive=True,
)
_sql("abandoned_carts_all", _cart("user"), _replay(), ABANDONED.format(items="cart_items,", hours=1), recursive=True)

# --- reads with filters ----------------------------------------------------------

_sql(
    "find_events",
    _cart(),
    f"""SELECT {RAW_OUT} FROM cart WHERE event_type = 'add_to_cart' AND source = 'website'
  AND iso >= '2024-01-05' AND iso <= '2024-01-20' ORDER BY iso DESC, ingest_ord LIMIT 100 OFFSET 20""",
)
_sql(
    "find_events_total",
    _cart(),
    "SELECT count(*) AS total FROM cart WHERE device = 'mobile' AND iso >= '2024-01-05' AND iso <= '2024-01-20'",
)
_sql(
    "events_for_customer",
    _cart(),
    f"SELECT {RAW_OUT} FROM cart WHERE customer_id = 42 ORDER BY iso DESC, ingest_ord LIMIT 100",
)
_sql(
    "events_for_product",
    _cart(),
    f"SELECT {RAW_OUT} FROM cart WHERE product_id = 3 ORDER BY iso DESC, ingest_ord LIMIT 500",
)
_sql(
    "events_for_session",
    _cart("user"),
    f"SELECT {RAW_OUT} FROM cart WHERE session_id = 'u42' ORDER BY iso, ingest_ord LIMIT 100",
)
_sql(
    "events_for_keys",
    _cart(),
    f"SELECT {RAW_OUT} FROM cart WHERE customer_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
)
ORDER_OUT = "SELECT order_id, customer_id, channel, created_at, status, payment_status, total FROM online"
_sql(
    "find_orders",
    ONLINE,
    f"""{ORDER_OUT} WHERE channel = 'website' AND status = 'completed' AND created_at >= '1996-01-01'
  AND created_at <= '2000-06-30' AND total >= 200000 ORDER BY created_at DESC, ingest_ord LIMIT 100 OFFSET 10""",
)
_sql(
    "find_orders_by_payment",
    ONLINE,
    f"""{ORDER_OUT} WHERE payment_status = 'paid' AND total <= 90000 ORDER BY created_at DESC, ingest_ord LIMIT 200""",
)
_sql("order_by_id", ONLINE, f"{ORDER_OUT} WHERE order_id = 'ORD777' ORDER BY ingest_ord LIMIT 1")
_sql("orders_for_customer", ONLINE, f"{ORDER_OUT} WHERE customer_id = 42 ORDER BY created_at DESC, ingest_ord LIMIT 50")
_sql(
    "orders_for_channel",
    ONLINE,
    f"{ORDER_OUT} WHERE channel = 'lazada' AND status = 'processing' ORDER BY created_at DESC, ingest_ord LIMIT 50",
)
_sql("guarded_append", ONLINE, ORDER_OUT)
_sql(
    "shopify_orders_page",
    SHOPIFY,
    """SELECT id, order_number, payment_status, total_vnd FROM shopify WHERE payment_status = 'paid'
ORDER BY id LIMIT 40 OFFSET 80""",
)
_sql(
    "sapo_orders_page",
    SAPO,
    """SELECT id, code, location_id, status, total_vnd FROM sapo WHERE location_id = 7 AND status = 'completed'
ORDER BY id LIMIT 25 OFFSET 25""",
)
_sql(
    "find_payments",
    PAYPAL,
    """SELECT transaction_id, transaction_initiation_date, transaction_status FROM paypal
WHERE transaction_status = 'COMPLETED' AND transaction_initiation_date >= '1997-01-01'
  AND transaction_initiation_date <= '1999-12-31' ORDER BY ingest_ord LIMIT 100""",
)
_sql(
    "find_momo",
    MOMO,
    """SELECT "orderId", "resultCode", amount, "responseTimeISO" FROM momo
WHERE "resultCode" = 0 AND "responseTimeISO" >= '1996-01-01' AND amount >= 100000 AND amount <= 300000
ORDER BY "responseTime" DESC, ingest_ord LIMIT 50""",
)
_sql(
    "find_zalopay",
    ZALO,
    """SELECT app_trans_id, return_code, amount, channel, server_time_iso FROM zalo
WHERE return_code = 1 AND server_time_iso <= '2000-01-01' AND channel = 38
ORDER BY server_time DESC, ingest_ord LIMIT 50""",
)
BANK_OUT = "SELECT transaction_id, account_id, CAST(amount AS DOUBLE) AS amount, kind, created_at FROM mercury"
_sql(
    "account_transactions",
    MERCURY,
    f"""{BANK_OUT} WHERE account_id = 'ACC1' AND status = 'posted' AND created_at >= '1996-01-01'
ORDER BY created_at DESC, ingest_ord LIMIT 50""",
)
_sql("bank_transactions", MERCURY, f"{BANK_OUT} WHERE kind = 'incomingAch' ORDER BY created_at DESC, ingest_ord LIMIT 100")
MOMO_OUT = '"partnerCode", "orderId", amount, "transId", "payType", "resultCode", message'
_sql(
    "momo_lookup",
    LINES,
    MOMO,
    """, asked AS (
  SELECT DISTINCT order_id || '#' || product_id AS query_id,
    CASE WHEN product_id % 4 = 0 THEN NULL WHEN product_id % 9 = 0 THEN order_id || 'X' ELSE order_id END AS order_id,
    CASE WHEN product_id % 4 = 0 THEN 'MOMO' || product_id END AS request_id
  FROM lines
), hits AS (
  SELECT query_id, m.* FROM asked a JOIN momo m ON m."orderId" = a.order_id
  UNION ALL SELECT query_id, m.* FROM asked a JOIN momo m ON m."requestId" = a.request_id
), best AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY ingest_ord) = 1)
SELECT query_id, b.ingest_ord IS NOT NULL AS found, coalesce("partnerCode", 'MERCHANT01') AS "partnerCode", "orderId",
  amount, "transId", "payType", coalesce("resultCode", 99) AS "resultCode",
  coalesce(message, 'Khong tim thay giao dich') AS message
FROM asked LEFT JOIN best b USING (query_id)""",
)
_sql(
    "zalopay_lookup",
    ONLINE,
    ZALO,
    """SELECT o.order_id AS query_id, z.zp_trans_id IS NOT NULL AS found, coalesce(return_code, -54) AS return_code,
  coalesce(return_message, 'Giao dich khong ton tai') AS return_message, coalesce(sub_return_code, 0) AS sub_return_code,
  coalesce(sub_return_message, '') AS sub_return_message, amount
FROM online o LEFT JOIN zalo z ON z.zp_trans_id = 200000000000000 + o.ingest_ord * 3""",
)
_sql(
    "momo_query",
    MOMO,
    f"""SELECT {MOMO_OUT} FROM momo WHERE "orderId" = 'ORD778' OR "requestId" = 'MOMO777' ORDER BY ingest_ord LIMIT 1""",
)
_sql(
    "find_products",
    PRODUCTS,
    """SELECT * FROM products WHERE lower(category) = 'economy' AND lower(brand) = 'brand#2'
  AND price_vnd >= 90000 AND price_vnd <= 105000 ORDER BY id LIMIT 40 OFFSET 2""",
)
_sql(
    "find_staff",
    STAFF,
    """SELECT * FROM staff WHERE contains(lower(position), 'manager') AND lower(status) = 'active' ORDER BY id LIMIT 50""",
)
_sql(
    "find_customers",
    CUSTOMERS,
    """SELECT * FROM customers WHERE contains(lower(city), 'build') AND contains(lower(country), 'nation_1')
ORDER BY id LIMIT 80 OFFSET 5""",
)
_sql("find_locations", SHOPS, "SELECT id, name, city FROM shops WHERE contains(lower(city), 'nation_2') ORDER BY id LIMIT 50")
_sql(
    "find_shops",
    SHOPS,
    "SELECT * FROM shops WHERE contains(lower(country), 'a') AND upper(currency_code) = 'VND' ORDER BY id LIMIT 50",
)
_sql("customer_by_id", CUSTOMERS, "SELECT * FROM customers WHERE id = 42")
_sql("product_by_id", PRODUCTS, "SELECT * FROM products WHERE id = 42")
_sql("staff_by_id", STAFF, "SELECT * FROM staff WHERE id = 7")
_sql(
    "entity_details",
    ONLINE,
    CUSTOMERS,
    """SELECT customer_id, order_id, full_name AS customer_full_name, country AS customer_country
FROM online LEFT JOIN customers ON customer_id = id""",
)

# --- orders ----------------------------------------------------------------------

_sql(
    "customer_order_stats",
    ONLINE,
    """SELECT customer_id, count(*) AS total_orders, count(*) FILTER (WHERE status = 'completed') AS completed_orders,
  CAST(coalesce(sum(total) FILTER (WHERE status = 'completed'), 0) AS BIGINT) AS total_spent_vnd,
  CAST(coalesce(sum(total) FILTER (WHERE status = 'completed') // nullif(count(*) FILTER (WHERE status = 'completed'), 0), 0)
    AS BIGINT) AS average_order_value
FROM online GROUP BY customer_id""",
)
_sql(
    "channel_stats",
    ONLINE,
    """SELECT channel, count(*) AS orders, count(*) FILTER (WHERE status = 'completed') AS completed,
  CAST(coalesce(sum(total) FILTER (WHERE status = 'completed'), 0) AS BIGINT) AS total_revenue FROM online GROUP BY channel""",
)
_sql("order_status_counts", ONLINE, "SELECT status, count(*) AS orders FROM online GROUP BY status")
_sql("order_payment_counts", ONLINE, "SELECT payment_method, count(*) AS orders FROM online GROUP BY payment_method")
_sql(
    "order_totals",
    ONLINE,
    f"""SELECT count(*) AS total_orders, count(*) FILTER (WHERE status = 'completed') AS completed_orders,
  {_cents("count(*) FILTER (WHERE status = 'completed') * 100.0::DOUBLE / count(*)")} AS conversion_rate,
  CAST(sum(total) FILTER (WHERE status = 'completed') AS BIGINT) AS total_revenue_vnd,
  CAST(sum(total) FILTER (WHERE status = 'completed') // count(*) FILTER (WHERE status = 'completed') AS BIGINT) AS average_order_value_vnd,
  round(CAST(count(*) FILTER (WHERE status = 'completed') * 100.0 AS DOUBLE) / count(*), 4) AS conversion_exact FROM online""",
)
_sql(
    "top_products_sold",
    ONLINE,
    LINES,
    """SELECT product_id, any_value(p_name) AS name, CAST(sum(quantity) AS BIGINT) AS quantity_sold,
  CAST(sum(line_total) AS BIGINT) AS revenue_vnd
FROM lines JOIN online USING (order_id) LEFT JOIN part ON p_partkey = product_id
WHERE status = 'completed' AND product_id <> 0
GROUP BY product_id ORDER BY revenue_vnd DESC, min(lines.ingest_ord), product_id LIMIT 10""",
)
HISTORY = """, history AS (
  SELECT customer_id, transaction_id, order_date AS ordered_at, channel, total_vnd FROM shopify
  UNION ALL SELECT customer_id, transaction_id, created_on, channel, total_vnd FROM sapo
)
"""
_sql(
    "customer_history",
    SHOPIFY,
    SAPO,
    HISTORY + "SELECT * FROM history WHERE customer_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')",
)
_sql(
    "customer_channel_summary",
    SHOPIFY,
    SAPO,
    HISTORY
    + """SELECT customer_id, count(*) FILTER (WHERE channel = 'online') AS online_orders,
  count(*) FILTER (WHERE channel <> 'online') AS store_orders, CAST(sum(total_vnd) AS BIGINT) AS total_vnd,
  min(ordered_at) AS first_order_at, max(ordered_at) AS last_order_at,
  bool_or(channel = 'online') AND bool_or(channel <> 'online') AS cross_channel FROM history GROUP BY customer_id""",
)

# --- payments --------------------------------------------------------------------

_sql(
    "momo_statistics",
    MOMO,
    f"""SELECT count(*) AS total_transactions, count(*) FILTER (WHERE "resultCode" = 0) AS successful_transactions,
  {_cents('count(*) FILTER (WHERE "resultCode" = 0) * 100.0::DOUBLE / count(*)')} AS success_rate,
  CAST(sum(amount) FILTER (WHERE "resultCode" = 0) AS BIGINT) AS total_amount_vnd,
  count(*) FILTER (WHERE "resultCode" <> 0) AS failed_transactions,
  CAST(sum(amount) FILTER (WHERE "resultCode" = 0) // count(*) FILTER (WHERE "resultCode" = 0) AS BIGINT) AS average_amount_vnd,
  round(CAST(count(*) FILTER (WHERE "resultCode" = 0) * 100.0 AS DOUBLE) / count(*), 4) AS success_exact FROM momo""",
)
_sql(
    "momo_by_pay_type",
    MOMO,
    """SELECT "payType" AS pay_type, count(*) AS transactions, CAST(sum(amount) AS BIGINT) AS total_vnd
FROM momo WHERE "resultCode" = 0 GROUP BY 1""",
)
_sql(
    "zalopay_statistics",
    ZALO,
    f"""SELECT count(*) AS total_transactions, count(*) FILTER (WHERE return_code = 1) AS successful,
  {_cents('count(*) FILTER (WHERE return_code = 1) * 100.0::DOUBLE / count(*)')} AS success_rate,
  count(*) FILTER (WHERE return_code = 2) AS failed, count(*) FILTER (WHERE return_code = 3) AS processing,
  CAST(sum(amount) FILTER (WHERE return_code = 1) AS BIGINT) AS total_amount_vnd,
  CAST(sum(discount_amount) FILTER (WHERE return_code = 1) AS BIGINT) AS total_discount_vnd,
  CAST(sum(amount - discount_amount) FILTER (WHERE return_code = 1) AS BIGINT) AS net_amount_vnd,
  CAST(sum(amount) FILTER (WHERE return_code = 1) // count(*) FILTER (WHERE return_code = 1) AS BIGINT) AS average_amount_vnd,
  round(CAST(count(*) FILTER (WHERE return_code = 1) * 100.0 AS DOUBLE) / count(*), 4) AS success_exact FROM zalo""",
)
_sql(
    "zalopay_by_channel",
    ZALO,
    """SELECT CASE channel WHEN 36 THEN 'Vietcombank' WHEN 37 THEN 'ACB' WHEN 38 THEN 'ZaloPay Wallet'
  WHEN 39 THEN 'Visa/Master' WHEN 40 THEN 'ATM' WHEN 41 THEN 'Domestic Card' ELSE 'Channel ' || channel END AS channel_name,
  count(*) AS transactions, CAST(sum(amount) AS BIGINT) AS total_vnd FROM zalo WHERE return_code = 1 GROUP BY 1""",
)
_sql(
    "zalopay_by_bank",
    ZALO,
    """SELECT CASE WHEN bank_code = '' THEN 'ZaloPay' ELSE coalesce(bank_code, 'Unknown') END AS bank,
  count(*) AS transactions, CAST(sum(amount) AS BIGINT) AS total_vnd FROM zalo WHERE return_code = 1 GROUP BY 1""",
)
_sql(
    "zalopay_items",
    ZALO,
    """SELECT zp_trans_id, 'PROD' || customer_id AS itemid, CAST(NULL AS VARCHAR) AS itemname, amount AS itemprice,
  CAST(1 AS BIGINT) AS itemquantity FROM zalo""",
)
_sql(
    "payment_view",
    PAYPAL,
    """SELECT 'PAY-' || paypal_transaction_id AS id, transaction_id, 'sale' AS intent,
  CASE WHEN transaction_status = 'COMPLETED' THEN 'completed' ELSE 'pending' END AS state,
  transaction_initiation_date AS create_time, CAST(amount AS VARCHAR) AS total_amount, 'USD' AS currency,
  'paypal' AS payment_method FROM paypal""",
)
_sql(
    "momo_query_view",
    MOMO,
    """SELECT "partnerCode", "orderId", "requestId", store_id AS "extraData", amount, "transId", "payType", "resultCode",
  CAST(refunded IS NOT NULL AS BIGINT) AS "refundTrans", message, "responseTime", CAST(0 AS BIGINT) AS "promotionInfo"
FROM momo""",
)
_sql(
    "zalopay_query_view",
    ZALO,
    """SELECT return_code, return_message, sub_return_code, sub_return_message, is_processing, amount, discount_amount,
  zp_trans_id FROM zalo""",
)
_sql(
    "balance_view",
    """SELECT 'ACC' || s_suppkey AS "accountId", s_acctbal AS "currentBalance", s_acctbal - 10 AS "availableBalance",
  'USD' AS currency, '2024-01-31 00:00:00.000000' AS "asOf" FROM supplier""",
)
_sql(
    "account_activity",
    MERCURY,
    """SELECT account_id, count(*) AS transactions, CAST(sum(amount) AS DOUBLE) AS net_amount,
  CAST(sum(amount) FILTER (WHERE amount > 0) AS DOUBLE) AS credits FROM mercury GROUP BY account_id""",
)
for _name, _cte, _table, _id in (("momo", MOMO, "momo", '"orderId"'), ("zalopay", ZALO, "zalo", "app_trans_id")):
    _sql(
        f"{_name}_refunds",
        _cte,
        f"""SELECT {_id}, amount, refunded, amount - refunded AS net_amount,
  CASE WHEN amount - refunded <= 0 THEN 'full' ELSE 'partial' END AS refund_kind FROM {_table} WHERE refunded IS NOT NULL""",
    )

# --- lookup and reconciliation ---------------------------------------------------

HITS = """, hits AS (
  SELECT 'paypal' AS source, 0 AS source_no, transaction_id, ingest_ord FROM paypal
  UNION ALL SELECT 'mercury', 1, transaction_id, ingest_ord FROM mercury
  UNION ALL SELECT 'momo', 2, transaction_id, ingest_ord FROM momo
  UNION ALL SELECT 'zalopay', 3, transaction_id, ingest_ord FROM zalo
  UNION ALL SELECT 'shopify', 4, transaction_id, ingest_ord FROM shopify
  UNION ALL SELECT 'sapo', 5, transaction_id, ingest_ord FROM sapo
  UNION ALL SELECT 'odoo', 6, transaction_id, ingest_ord FROM odoo
), firsts AS (SELECT source, source_no, transaction_id, min(ingest_ord) AS row_no FROM hits GROUP BY ALL)
"""
SEVEN = (ONLINE, PAYPAL, MERCURY, MOMO, ZALO, SHOPIFY, SAPO, ODOO)
_sql(
    "transaction_lookup",
    *SEVEN,
    HITS
    + """SELECT o.transaction_id, coalesce(string_agg(source, ',' ORDER BY source_no), '') AS found_in_sources,
  count(source) AS matches FROM online o LEFT JOIN firsts f ON f.transaction_id = o.transaction_id GROUP BY o.transaction_id""",
)
_sql(
    "transaction_matches",
    *SEVEN,
    HITS + "SELECT transaction_id, source, row_no FROM firsts WHERE transaction_id IN (SELECT transaction_id FROM online)",
)
_sql("find_transaction", *SEVEN, HITS + "SELECT transaction_id, source, row_no FROM firsts WHERE transaction_id = 'TXN105'")


def _reconcile(how: str) -> str:
    return f""", placed AS (SELECT 'TXN' || o_orderkey AS transaction_id, CAST(o_totalprice AS DECIMAL(18,2)) AS order_amount FROM orders
), joined AS (
  SELECT transaction_id, order_amount, p.amount AS gateway_amount, p.fee AS gateway_fee, b.amount_usd AS bank_amount,
    p.amount - p.fee AS net_amount, b.amount_usd - (p.amount - p.fee) AS bank_delta
  FROM placed {how} JOIN paypal p USING (transaction_id) {how} JOIN mercury b USING (transaction_id)
), judged AS (
  SELECT *, CASE {"WHEN order_amount IS NULL THEN 'unknown_order'" if how == "FULL" else ""}
    WHEN gateway_amount IS NULL THEN 'missing_gateway' WHEN bank_amount IS NULL THEN 'missing_bank'
    WHEN gateway_amount <> order_amount THEN 'amount_mismatch' WHEN bank_delta <> 0 THEN 'net_mismatch'
    ELSE 'matched' END AS status FROM joined
)
"""


_sql(
    "payment_reconciliation",
    PAYPAL,
    MERCURY,
    _reconcile("LEFT")
    + """SELECT transaction_id, order_amount::DOUBLE AS order_amount, gateway_amount::DOUBLE AS gateway_amount,
  gateway_fee::DOUBLE AS gateway_fee, bank_amount::DOUBLE AS bank_amount, net_amount::DOUBLE AS net_amount,
  bank_delta::DOUBLE AS bank_delta, status FROM judged""",
)
_sql(
    "reconciliation_summary",
    PAYPAL,
    MERCURY,
    _reconcile("FULL") + "SELECT status, count(*) AS transactions FROM judged GROUP BY status",
)
_sql(
    "referential_check",
    _cart(),
    """, refs AS (
  SELECT 'order_customer' AS reference, o_custkey AS k, o_custkey IN (SELECT c_custkey FROM customer) AS known FROM orders
  UNION ALL SELECT 'line_product', l_partkey, l_partkey IN (SELECT p_partkey FROM part) FROM lineitem
  UNION ALL SELECT 'event_customer', customer_id, customer_id IN (SELECT s_suppkey FROM supplier) FROM cart WHERE customer_id IS NOT NULL
)
SELECT reference, count(DISTINCT k) FILTER (WHERE NOT known) AS orphan_keys, count(*) FILTER (WHERE NOT known) AS orphan_rows
FROM refs GROUP BY reference""",
)

# --- rules -----------------------------------------------------------------------

_sql(
    "line_pricing_check",
    LINES,
    """SELECT order_id, product_id, line_number, ingest_ord, quantity, unit_price, discount_percent, discount_amount,
  line_total, expected_discount, expected_line_total FROM lines
WHERE discount_amount <> expected_discount OR line_total <> expected_line_total""",
)
_sql(
    "order_pricing_check",
    ONLINE,
    """SELECT order_id, tax_amount, subtotal // 10 AS expected_tax, total,
  subtotal + subtotal // 10 + shipping_fee AS expected_total FROM online
WHERE tax_amount <> subtotal // 10 OR total <> subtotal + subtotal // 10 + shipping_fee""",
)
_sql(
    "order_line_totals",
    ONLINE,
    LINES,
    """SELECT o.order_id, any_value(o.subtotal) AS subtotal, count(l.order_id) AS line_count,
  CAST(coalesce(sum(line_total), 0) AS BIGINT) AS lines_total,
  CAST(any_value(o.subtotal) - coalesce(sum(line_total), 0) AS BIGINT) AS delta
FROM online o LEFT JOIN lines l ON l.order_id = o.order_id GROUP BY o.order_id""",
)
_sql("pos_pricing_check", SAPO, "SELECT id, vat_amount, expected_vat FROM sapo WHERE vat_amount <> expected_vat")
_sql(
    "shop_pricing_check",
    SHOPIFY,
    "SELECT id, tax_vnd, total_vnd FROM shopify WHERE total_vnd <> subtotal_vnd + tax_vnd + shipping_vnd",
)
_sql("fx_check", SHOPIFY, "SELECT id, subtotal_vnd FROM shopify WHERE id % 127 = 0")
_sql(
    "gateway_fee_check",
    PAYPAL,
    """SELECT transaction_id, amount::DOUBLE AS amount, fee::DOUBLE AS fee, expected_fee::DOUBLE AS expected_fee,
  (amount - fee)::DOUBLE AS net FROM paypal WHERE abs(fee - expected_fee) > 0.01""",
)
_sql(
    "payment_status_rule",
    ONLINE,
    """SELECT order_id, status, payment_status, 'cancelled' AS expected_payment_status FROM online
WHERE status = 'cancelled' AND payment_status <> 'cancelled'""",
)
_sql(
    "signed_amount_rule",
    MERCURY,
    """SELECT transaction_id, kind, amount::DOUBLE AS amount FROM mercury
WHERE (kind IN ('incomingAch', 'incomingDomesticWire') AND amount < 0)
  OR (kind NOT IN ('incomingAch', 'incomingDomesticWire') AND amount > 0)""",
)
_sql(
    "momo_signature_check",
    MOMO,
    """SELECT "orderId", amount FROM momo WHERE signature <> sha256("transId" || "orderId" || amount)""",
)
_sql(
    "zalopay_mac_check",
    ZALO,
    "SELECT app_trans_id, amount FROM zalo WHERE mac <> sha256(zp_trans_id || '|' || app_trans_id || '|' || amount)",
)
_sql(
    "id_format_check",
    ZALO,
    SHOPIFY,
    STAFF,
    """SELECT 'app_trans_id' AS kind, app_trans_id AS bad_id FROM zalo WHERE NOT regexp_matches(app_trans_id, '^[0-9]{6}_[0-9]{6}$')
UNION ALL SELECT 'order_number', order_number FROM shopify WHERE NOT regexp_matches(order_number, '^ORD-[0-9]{8}-[0-9]{6,}$')
UNION ALL SELECT 'staff_code', code FROM staff WHERE NOT regexp_matches(code, '^NV[0-9]{4,}$')""",
)
_sql("duplicate_ids", _cart(), "SELECT event_id, count(*) AS uses FROM cart GROUP BY event_id HAVING count(*) > 1")
_sql(
    "duplicate_transactions",
    SAPO,
    "SELECT transaction_id, count(*) AS uses FROM sapo GROUP BY transaction_id HAVING count(*) > 1",
)
_sql(
    "line_total_check",
    _cart(),
    """SELECT event_id, ingest_ord, price AS product_price_vnd, quantity, line_total AS line_total_vnd FROM cart
WHERE line_total <> price * quantity""",
)

# --- ids, sinks, streams ---------------------------------------------------------

_sql(
    "max_ids",
    """SELECT 'products' AS entity, max(p_partkey) AS max_id, count(*) AS row_count FROM part
UNION ALL SELECT 'customers', max(c_custkey), count(*) FROM customer
UNION ALL SELECT 'staff', max(s_suppkey), count(*) FROM supplier
UNION ALL SELECT 'orders', max(o_orderkey), count(*) FROM orders""",
)
_sql(
    "append_surrogate_ids",
    """SELECT o_orderkey AS ingest_ord, o_custkey AS customer_id,
  (SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY o_orderkey) AS id FROM orders""",
)
_sql(
    "json_lines_roundtrip",
    _cart(),
    """SELECT event_id, event_type, iso AS timestamp, session_id, customer_id, CAST(price AS VARCHAR) AS product_price_vnd,
  coalesce(CAST(quantity AS VARCHAR), 'x') AS quantity FROM cart""",
)
_sql(
    "stream_cleaned_events",
    *PREPARED,
    f"""SELECT event_id, session_id, event_type, strftime(ts, '{TIME}') AS timestamp, CAST(d AS VARCHAR) AS date,
  hour(ts) AS hour, utm_source, referrer FROM dedup""",
)
ORACLES["stream_json_files"] = ORACLES["stream_cleaned_events"]
_sql(
    "stream_session_totals",
    *SESSIONS,
    SESSION_OUT,
)
ISLANDS = """
gaps AS (
  SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY session_id ORDER BY ts) + INTERVAL 24 HOUR THEN 0 ELSE 1 END AS fresh
  FROM cart
), bursts AS (
  SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY ts) AS burst FROM gaps
), closed AS (
  SELECT session_id, min(ts) AS first_activity, max(ts) AS last_activity, count(*) AS events FROM bursts
  GROUP BY session_id, burst
  HAVING max(ts) + INTERVAL 24 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM cart)
)"""
_sql(
    "stream_activity_windows",
    _cart("user"),
    ISLANDS,
    f"SELECT session_id, {_at('first_activity')}, {_at('last_activity')}, events FROM closed",
)
#: As ``_arriving``: the file each event comes in, and the newest time of the files but it and the last.
ARRIVAL = """
numbered AS (
  SELECT *, coalesce((extract(day FROM ts) - 1) // 4 + extract(hour FROM ts) % 3, 0) AS file FROM cart
), newest AS (
  SELECT file, max(max(ts)) OVER (ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) AS known
  FROM numbered GROUP BY file
)"""


def _left(name: str, delay: str) -> None:
    """Carts at the end of each session's last closed burst, over the events not behind the delay."""
    _sql(
        name,
        _cart("user"),
        ARRIVAL,
        f"""
in_time AS (
  SELECT n.* EXCLUDE (file) FROM numbered n JOIN newest w ON n.file = w.file
  WHERE w.known IS NULL OR n.ts > w.known - INTERVAL {delay}
)""",
        ISLANDS.replace("FROM cart\n), bursts", "FROM in_time\n), bursts").replace("INTERVAL 1 HOUR", f"INTERVAL {delay}"),
        """
latest AS (SELECT session_id, max(last_activity) AS last_activity FROM closed GROUP BY session_id
), seen AS (SELECT in_time.* FROM in_time JOIN latest USING (session_id) WHERE ts <= last_activity)""",
        _replay("seen"),
        f"""SELECT session_id, strftime(l.last_activity, '{TIME}') AS last_activity, cart_value_vnd, item_count
FROM latest l JOIN carts USING (session_id)""",
        recursive=True,
    )


_left("stream_carts_left", "9 DAY")
_left("stream_carts_left_late", "1 HOUR")
_sql(
    "stream_carts_late_rows",
    _cart("user"),
    ARRIVAL,
    f"""SELECT event_id, ingest_ord, session_id, iso AS timestamp
FROM numbered n JOIN newest w ON n.file = w.file WHERE n.ts <= w.known - INTERVAL 1 HOUR""",
)

_sql(
    "stream_progress",
    _cart("user"),
    ARRIVAL,
    """SELECT count(*) AS input_rows, count(*) FILTER (WHERE n.ts <= w.known - INTERVAL 1 HOUR) AS late_rows
FROM numbered n JOIN newest w ON n.file = w.file""",
)

ORACLES["published_events"] = ORACLES["pipeline_append"]
ORACLES["published_summary"] = ORACLES["pipeline_summary_csv"]

_sql(
    "stream_set_aside",
    _cart(),
    CLEAN,
    """SELECT DISTINCT event_id, CAST(NULL AS BIGINT) AS ingest_ord FROM clean WHERE ingest_ord % 53 <> 0
UNION ALL SELECT event_id, ingest_ord FROM clean WHERE ingest_ord % 53 = 0""",
)

# --- codes, money, nested lines ----------------------------------------------------

CODED = """
coded0 AS (
  SELECT CASE WHEN o_orderkey % 53 = 0 THEN '20230231' ELSE strftime(o_orderdate, '%Y%m%d') END AS day,
    substr(CAST(1000000000 + o_orderkey AS VARCHAR), CASE WHEN o_orderkey % 59 = 0 THEN 8 ELSE 3 END) AS number FROM orders
), coded AS (
  SELECT 'TXN' || day || number AS transaction_id, 'CN' || substr(number, 6) AS location_code,
    'HD' || substr(day, 3) || number AS pos_code, 'POS-' || number AS pos_order_code FROM coded0
)"""
_FORMS = {
    "transaction_id": "^TXN[0-9]{16}$",
    "location_code": "^CN[0-9]{3,}$",
    "pos_code": "^HD[0-9]{12,}$",
    "pos_order_code": "^POS-[0-9]{8,}$",
}
_sql(
    "code_format_check",
    CODED,
    "\nUNION ALL ".join(f"SELECT '{k}' AS kind, {k} AS bad_id FROM coded WHERE NOT regexp_matches({k}, '{p}')" for k, p in _FORMS.items()),
)
_DATED = [
    ("coded", "transaction_id", _FORMS["transaction_id"], "substr(transaction_id, 4, 8)"),
    ("coded", "pos_code", _FORMS["pos_code"], "'20' || substr(pos_code, 3, 6)"),
    ("zalo", "app_trans_id", "^[0-9]{6}_[0-9]{6}$", "'20' || left(app_trans_id, 6)"),
    ("shopify", "order_number", "^ORD-[0-9]{8}-[0-9]{6,}$", "substr(order_number, 5, 8)"),
]
_sql(
    "id_date_check",
    CODED,
    ZALO,
    SHOPIFY,
    "\nUNION ALL ".join(
        f"SELECT '{k}' AS kind, {k} AS bad_id FROM {t} WHERE regexp_matches({k}, '{p}') AND try_strptime({day}, '%Y%m%d') IS NULL"
        for t, k, p, day in _DATED
    ),
)
_sql(
    "shop_usd_check",
    SHOPIFY,
    """
recorded AS (
  SELECT id, shipping_vnd, floor(subtotal_vnd / 240.0::DOUBLE) / 100 AS subtotal_usd, floor(shipping_vnd / 240.0::DOUBLE) / 100 AS shipping_usd FROM shopify
), taxed AS (SELECT *, floor(subtotal_usd * 10) / 100 AS tax_usd FROM recorded
)""",
    f""", expected AS (
  SELECT *, subtotal_usd + tax_usd + shipping_usd AS sum_usd, {_cents("subtotal_usd * 0.1::DOUBLE")} AS expected_tax_usd,
    {_cents("shipping_vnd / 24000.0::DOUBLE")} AS expected_shipping_usd, {_cents("subtotal_usd + tax_usd + shipping_usd")} AS expected_total_usd FROM taxed
)
SELECT id, shipping_vnd, subtotal_usd, tax_usd, shipping_usd, round(sum_usd, 4) AS total_usd, expected_tax_usd, expected_shipping_usd, expected_total_usd
FROM expected WHERE abs(tax_usd - expected_tax_usd) > 0.005 OR abs(shipping_usd - expected_shipping_usd) > 0.005
  OR abs(sum_usd - expected_total_usd) > 0.005""",
)
_sql(
    "money_columns",
    PRODUCTS,
    f""", usd AS (SELECT id, price_vnd, {_cents("price_vnd / 24000.0::DOUBLE")} AS usd FROM products)
SELECT id, usd, CAST(floor(usd * 24000) AS BIGINT) AS vnd, {_thousands("price_vnd")} AS thousands,
  {_cents("price_vnd / 8.0::DOUBLE")} AS eighth FROM usd""",
)
_sql(
    "code_columns",
    _cart(),
    """SELECT event_id, ingest_ord, 'CUST' || CASE WHEN length(CAST(customer_id AS VARCHAR)) >= 4 THEN CAST(customer_id AS VARCHAR)
  ELSE lpad(CAST(customer_id AS VARCHAR), 4, '0') END AS code, iso AS zulu, iso AS utc FROM cart WHERE customer_id IS NOT NULL""",
)
_sql(
    "nested_order_measures",
    LINES,
    f"""SELECT order_id, count(*) AS item_count, CAST(sum(quantity) AS BIGINT) AS total_quantity,
  CAST(sum(discount_amount) AS BIGINT) AS discount_total, {_cents("sum(quantity) * 0.125::DOUBLE")} AS total_weight_kg FROM lines GROUP BY order_id""",
)
_sql(
    "nested_subtotal_check",
    LINES,
    """SELECT order_id, CAST(sum(line_total) AS BIGINT) AS subtotal, CAST(sum(expected_line_total) AS BIGINT) AS expected_subtotal
FROM lines GROUP BY order_id HAVING sum(line_total) <> sum(expected_line_total)""",
)
_sql(
    "exploded_lines",
    LINES,
    """SELECT order_id, row_number() OVER (PARTITION BY order_id ORDER BY line_number, product_id, quantity, unit_price, discount_percent, discount_amount) - 1 AS line_pos, product_id, quantity, line_total FROM lines""",
)
_sql("pos_line_discounts", LINES, f"SELECT order_id, line_number, {_thousands('expected_discount')} AS discount FROM lines")
_sql(
    "embedded_store",
    ZALO,
    """SELECT zp_trans_id, 'TS' || (customer_id % 50) AS store_id, 'An "' || customer_id AS customer_name FROM zalo""",
)
_sql(
    "malformed_events",
    _cart(),
    "SELECT event_id, ingest_ord, iso || '?' AS timestamp FROM cart WHERE ingest_ord % 97 = 0",
)

# --- numbered files and pages ------------------------------------------------------

_sql(
    "batched_files",
    CUSTOMERS,
    """SELECT id, full_name, city, country, (id - 1) // 200 AS batch, row_number() OVER (PARTITION BY (id - 1) // 200 ORDER BY id) AS place
FROM customers""",
)
_sql("converted_batch", CUSTOMERS, "SELECT id, full_name, city, country FROM customers WHERE (id - 1) // 200 = 3")
_sql("path_fallback", CUSTOMERS, "SELECT id, full_name FROM customers WHERE (id - 1) // 200 = 1")
_sql("deep_page", ONLINE, f"{ORDER_OUT} ORDER BY created_at DESC, ingest_ord LIMIT 50 OFFSET 12450")
_sql(
    "page_after",
    ONLINE,
    f"""{ORDER_OUT} WHERE status = 'completed' AND (created_at < '1995-06-01T00:00:00' OR (created_at = '1995-06-01T00:00:00' AND ingest_ord > 0))
ORDER BY created_at DESC, ingest_ord LIMIT 50""",
)
