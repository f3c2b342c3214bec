"""DuckDB SQL that gives the same rows as the registered queries.

Only the SQL texts are here; the test driver runs them. Quintiles, ranks and gap days
are written independently of the Spark code.
"""

from __future__ import annotations


# Fixed values, written down here again: the action of each segment.
ACTIONS = {
    'Sleeping': 'Try to win them back with special offers or reminders.',
    'Loyal Customers': 'Reward them with exclusive deals and loyalty points.',
    'Champions': 'Treat them like VIPs! Offer early access and special gifts.',
    'At Risk': 'Send personalized emails and discounts to bring them back.',
    'Potential Loyalists': 'Encourage them to join a membership or loyalty program.',
    'Fading': "Send 'we miss you' emails with a special offer.",
    'Need Attention': 'Ask for their feedback and suggest popular products.',
    "Can't Lose Them": 'Offer a great deal to keep them from leaving.',
    'Promising': 'Suggest other products they might like.',
    'New Customers': 'Give them a great first experience and a welcome discount.',
}

# Fixed values, written down here again: parts of a cluster name, who they are, what to do.
PROFILES = (
    (
        ('Champions',),
        'These are your best customers: they buy often, spend the most, and have bought recently.',
        'Engage with VIP treatment, early access to new products, and loyalty rewards. Turn them into brand ambassadors.',
    ),
    (
        ('Low-Spenders',),
        'This group consists of new or infrequent customers with low spending.',
        'Help them grow! Send welcome offers, product recommendations, and deals to encourage a second purchase.',
    ),
    (
        ('At-Risk', 'Lapsed'),
        "These customers used to be valuable but haven't purchased in a long time. They might not come back.",
        "Launch a special campaign to win them back. Offer a great discount or show them what's new to get their attention.",
    ),
    (
        ('Potential',),
        'This is a group of mid-tier customers who are starting to buy more often.',
        'Encourage higher spending and frequency through bundling, cross-selling, and multi-buy offers.',
    ),
    (
        (),
        'This is a group of your typical, everyday customers.',
        'Keep them engaged with regular newsletters and promotions on popular products.',
    ),
)

def rnd(value: str, digits: int) -> str:
    """Round halves to even in floating point, as the queries do."""
    return f"round_even(({value}) * CAST(1e{digits} AS DOUBLE), 0) / CAST(1e{digits} AS DOUBLE)"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


JOINED = """lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey"""

RETAIL = f"""retail AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS invoice, CAST(l_partkey AS VARCHAR) AS stock_code,
    p_name AS description, l_quantity AS quantity, o_orderdate AS invoice_ts,
    l_extendedprice / l_quantity AS price, CAST(o_custkey AS VARCHAR) AS customer_id,
    n_name AS country, p_brand AS brand, c_mktsegment AS market_segment
  FROM {JOINED})"""

DIRTY = f"""dirty AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS invoice, CAST(l_partkey AS VARCHAR) AS stock_code,
    CASE WHEN l_partkey % 101 = 0 OR (l_orderkey + l_partkey) % 11 = 0 THEN NULL ELSE p_name END AS description,
    CASE WHEN l_returnflag = 'R' AND (l_orderkey + l_linenumber) % 5 = 0 THEN -l_quantity
      WHEN (l_partkey + l_linenumber) % 83 = 0 THEN l_quantity * 100 ELSE l_quantity END AS quantity,
    o_orderdate AS invoice_ts,
    CASE WHEN (l_orderkey + l_partkey) % 97 = 0 THEN CAST(0 AS DOUBLE)
      ELSE l_extendedprice / l_quantity END AS price,
    CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE CAST(o_custkey AS VARCHAR) END AS customer_id,
    CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE n_name END AS country
  FROM {JOINED})"""

EVENTS = """happened AS (
  SELECT CAST(event_id AS VARCHAR) AS invoice, event_type AS stock_code, event_type AS description,
    CAST(json_extract_string(props, '$.k') AS DOUBLE) AS quantity, ts AS invoice_ts, value AS price,
    CAST(user_id AS VARCHAR) AS customer_id, 'C' || CAST(user_id % 10 AS VARCHAR) AS country
  FROM events)"""

FEATURES = """quantity * price AS revenue, strftime(invoice_ts, '%Y-%m') AS year_month,
    dayname(invoice_ts) AS weekday, CAST(isodow(invoice_ts) - 1 AS INTEGER) AS weekday_no,
    CAST(hour(invoice_ts) AS INTEGER) AS hour"""

SALES = f"sales AS (SELECT *, {FEATURES} FROM retail)"
EVENT_SALES = f"sales AS (SELECT *, {FEATURES} FROM happened)"

POSITIVE = "positive AS (SELECT * FROM dirty WHERE quantity > 0 AND price > 0)"


def iqr(source: str, column: str, name: str) -> str:
    return f"""{name}_edges AS (SELECT quantile_cont({column}, 0.25) AS q1, quantile_cont({column}, 0.75) AS q3
    FROM {source}),
  {name} AS (SELECT s.* FROM {source} s, {name}_edges e
    WHERE s.{column} >= e.q1 - 1.5 * (e.q3 - e.q1) AND s.{column} <= e.q3 + 1.5 * (e.q3 - e.q1))"""


IQR = iqr("positive", "quantity", "by_quantity") + ",\n  " + iqr("by_quantity", "price", "by_price")


def imputed(source: str) -> str:
    return f"""names AS (SELECT stock_code, arg_max(description, {{'ts': invoice_ts, 'd': description}}) AS known
    FROM {source} WHERE description IS NOT NULL GROUP BY stock_code),
  imputed AS (SELECT s.* REPLACE (coalesce(customer_id, 'Unknown') AS customer_id,
      coalesce(s.description, n.known, 'Unknown') AS description)
    FROM {source} s LEFT JOIN names n ON s.stock_code = n.stock_code)"""


def time_text(source: str, more: str = "") -> str:
    return f"SELECT * REPLACE (strftime(invoice_ts, '%Y-%m-%d %H:%M:%S') AS invoice_ts){more} FROM {source}"


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


BASE = with_(RETAIL, SALES)


def revenue_by(keys: str, source: str = "sales") -> str:
    return f"SELECT {keys}, {rnd('sum(revenue)', 2)} AS revenue FROM {source} GROUP BY {keys}"


def kpis(by: str = "") -> str:
    columns = (
        ("busiest_month", "year_month"),
        ("busiest_weekday", "weekday"),
        ("busiest_hour", "hour"),
        ("top_product", "description"),
        ("top_country", "country"),
    )
    rows = []
    for kpi, column in columns:
        key = f"{column} || ':00 - ' || ({column} + 1) || ':00'" if column == "hour" else f"t.{column}"
        keys = f"{by} AS b, {column}" if by else column
        group = f"{by}, {column}" if by else column
        over = "PARTITION BY b" if by else ""
        rows.append(
            f"""SELECT {'b AS ' + by + ',' if by else ''} '{kpi}' AS kpi, CAST({key} AS VARCHAR) AS key,
      {rnd('total', 2)} AS revenue
    FROM (SELECT *, row_number() OVER ({over} ORDER BY total DESC, {column}) AS place
      FROM (SELECT {keys}, sum(revenue) AS total FROM sales GROUP BY {group})) t WHERE place = 1"""
        )
    return "\nUNION ALL\n".join(rows)


def rfm(source: str) -> str:
    return f"""rfm AS (
  SELECT customer_id,
    CAST(floor(epoch((SELECT max(invoice_ts) FROM {source}) + INTERVAL 1 DAY - max(invoice_ts)) / 86400) AS BIGINT)
      AS recency,
    count(DISTINCT invoice) AS frequency, sum(revenue) AS monetary
  FROM {source} GROUP BY customer_id)"""


# Quintiles: interpolated edges for recency and spend, first-come ranks for frequency.
SCORES = """edges AS (SELECT quantile_cont(CAST(recency AS DOUBLE), [0.2, 0.4, 0.6, 0.8]) AS re,
    quantile_cont(monetary, [0.2, 0.4, 0.6, 0.8]) AS me, count(*) AS n FROM rfm),
  ranked AS (SELECT *, row_number() OVER (ORDER BY frequency, customer_id) AS r FROM rfm),
  scored AS (SELECT customer_id, recency, frequency, monetary,
    CAST(5 - len(list_filter(re, lambda x: recency > x)) AS INTEGER) AS r_score,
    CAST(1 + len(list_filter([1, 2, 3, 4], lambda i: 5 * (r - 1) > i * (n - 1))) AS INTEGER) AS f_score,
    CAST(1 + len(list_filter(me, lambda x: monetary > x)) AS INTEGER) AS m_score
    FROM ranked, edges)"""

# The rules as pairs of score ranges, in the order of the pattern list they come from.
RULES = (
    ("Sleeping", 1, 2, 1, 2),
    ("At Risk", 1, 2, 3, 4),
    ("Can't Lose Them", 1, 2, 5, 5),
    ("Fading", 3, 3, 1, 2),
    ("Need Attention", 3, 3, 3, 3),
    ("Loyal Customers", 3, 4, 4, 5),
    ("Promising", 4, 4, 1, 1),
    ("New Customers", 5, 5, 1, 1),
    ("Potential Loyalists", 4, 5, 2, 3),
    ("Champions", 5, 5, 4, 5),
)
SEGMENTED = (
    "segmented AS (SELECT *, CASE "
    + " ".join(
        f"WHEN r_score BETWEEN {a} AND {b} AND f_score BETWEEN {c} AND {d} THEN {text(name)}"
        for name, a, b, c, d in RULES
    )
    + " END AS segment FROM scored)"
)
ACTED = (
    "acted AS (SELECT *, CASE segment "
    + " ".join(f"WHEN {text(s)} THEN {text(a)}" for s, a in ACTIONS.items())
    + " END AS action FROM segmented)"
)
CUSTOMERS = with_(RETAIL, SALES, rfm("sales"), SCORES, SEGMENTED, ACTED)


def group_summary(group: str, source: str) -> str:
    return f"""SELECT *, {rnd('customer_count / sum(customer_count) OVER () * 100', 2)} AS pct_of_customers,
    {rnd('total_revenue / sum(total_revenue) OVER () * 100', 2)} AS pct_of_revenue
  FROM (SELECT {group}, count(recency) AS customer_count, {rnd('avg(recency)', 2)} AS avg_recency,
    {rnd('avg(frequency)', 2)} AS avg_frequency, {rnd('sum(monetary)', 2)} AS total_revenue,
    {rnd('avg(monetary)', 2)} AS avg_revenue FROM {source} GROUP BY {group})"""


def group_share(group: str, source: str) -> str:
    return f"""SELECT {group}, customers, {rnd('revenue', 4)} AS revenue,
    {rnd('customers / sum(customers) OVER () * 100', 4)} AS customer_share,
    {rnd('revenue / sum(revenue) OVER () * 100', 4)} AS revenue_share
  FROM (SELECT {group}, count(recency) AS customers, sum(monetary) AS revenue FROM {source} GROUP BY {group})"""


CLUSTERED = """clustered AS (SELECT *, CAST(CAST(customer_id AS BIGINT) % 4 AS INTEGER) AS cluster FROM rfm),
  means AS (SELECT cluster, avg(recency) AS r, avg(frequency) AS f, avg(monetary) AS m
    FROM clustered GROUP BY cluster),
  first_names AS (SELECT *, CASE WHEN m = (SELECT max(m) FROM means) THEN 'High-Value Champions'
      WHEN m = (SELECT min(m) FROM means) THEN 'Low-Spenders / New'
      WHEN r = (SELECT max(r) FROM means) THEN 'At-Risk / Lapsed' END AS early FROM means),
  later AS (SELECT cluster, row_number() OVER (ORDER BY f DESC, cluster) AS place
    FROM first_names WHERE early IS NULL),
  named_clusters AS (SELECT a.cluster, coalesce(early, CASE WHEN place = 1 THEN 'Potential Loyalists'
      ELSE 'Standard Group ' || (place - 1) END) AS cluster_name
    FROM first_names a LEFT JOIN later b ON a.cluster = b.cluster),
  named AS (SELECT c.*, cluster_name FROM clustered c JOIN named_clusters n ON c.cluster = n.cluster)"""
CLUSTERS = with_(RETAIL, SALES, rfm("sales"), CLUSTERED)


def profile_text(place: int) -> str:
    cases = " ".join(
        f"WHEN contains(cluster_name, {text(part)}) THEN {text(p[place])}" for p in PROFILES[:-1] for part in p[0]
    )
    return f"CASE {cases} ELSE {text(PROFILES[-1][place])} END"


# Daily series by brand: a calendar from first to last sale, joined with the daily totals.
DAILY = """sold AS (SELECT brand AS stock_code, CAST(invoice_ts AS DATE) AS d, sum(quantity) AS q,
    avg(price) AS p FROM retail GROUP BY ALL),
  calendar AS (SELECT stock_code, CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS d
    FROM sold GROUP BY stock_code),
  gaps AS (SELECT c.stock_code, c.d, coalesce(s.q, CAST(0 AS DOUBLE)) AS quantity, s.p AS our_price
    FROM calendar c LEFT JOIN sold s ON c.stock_code = s.stock_code AND c.d = s.d),
  series AS (SELECT stock_code, d, quantity, coalesce(
      last_value(nullif(our_price, 0) IGNORE NULLS) OVER (PARTITION BY stock_code ORDER BY d
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
      first_value(nullif(our_price, 0) IGNORE NULLS) OVER (PARTITION BY stock_code ORDER BY d
        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS our_price FROM gaps)"""
SERIES = with_(RETAIL, DAILY)
DAY = "strftime(d, '%Y-%m-%d') AS day"
W = "OVER (PARTITION BY stock_code ORDER BY d)"

LAGS = ", ".join(f"lag(quantity, {i}) {W} AS lag_{i}_days" for i in (1, 7, 14, 30))


def _rolling(w: int, function: str) -> str:
    frame = f"OVER (PARTITION BY stock_code ORDER BY d ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count(quantity) {frame} = {w} THEN {function}(quantity) {frame} END"


def rolling_columns(wrap) -> str:
    return ", ".join(
        f"{wrap(_rolling(w, function))} AS rolling_{kind}_{w}_days"
        for w in (7, 14, 30)
        for kind, function in (("mean", "avg"), ("std", "stddev_samp"))
    )


CALENDAR = """CAST(isodow(d) - 1 AS INTEGER) AS day_of_week, CAST(month(d) AS INTEGER) AS month,
    CAST(weekofyear(d) AS INTEGER) AS week_of_year"""

# Bank holidays of England and Wales in the years of the test orders,
# with the day itself where a substitute was given.
HOLIDAYS = """
1995-01-01 1995-01-02 1995-04-14 1995-04-17 1995-05-08 1995-05-29 1995-08-28 1995-12-25 1995-12-26
1996-01-01 1996-04-05 1996-04-08 1996-05-06 1996-05-27 1996-08-26 1996-12-25 1996-12-26
1997-01-01 1997-03-28 1997-03-31 1997-05-05 1997-05-26 1997-08-25 1997-12-25 1997-12-26
1998-01-01 1998-04-10 1998-04-13 1998-05-04 1998-05-25 1998-08-31 1998-12-25 1998-12-26 1998-12-28
1999-01-01 1999-04-02 1999-04-05 1999-05-03 1999-05-31 1999-08-30 1999-12-25 1999-12-26 1999-12-27
1999-12-28 1999-12-31
2000-01-01 2000-01-03 2000-04-21 2000-04-24 2000-05-01 2000-05-29 2000-08-28 2000-12-25 2000-12-26
2001-01-01 2001-04-13 2001-04-16 2001-05-07 2001-05-28 2001-08-27 2001-12-25 2001-12-26
""".split()
IS_HOLIDAY = f"CAST(CASE WHEN strftime(d, '%Y-%m-%d') IN ({', '.join(map(text, HOLIDAYS))}) THEN 1 ELSE 0 END AS INTEGER)"

FEATURE_NAMES = (
    ["quantity", "our_price", "day_of_week", "month", "week_of_year"]
    + [f"lag_{i}_days" for i in (1, 7, 14, 30)]
    + [f"rolling_{k}_{w}_days" for w in (7, 14, 30) for k in ("mean", "std")]
    + ["is_holiday"]
)
FEATURE_TABLE = f"""features AS (SELECT stock_code, d, quantity, our_price, {CALENDAR},
    {', '.join(f'coalesce(lag(quantity, {i}) {W}, 0) AS lag_{i}_days' for i in (1, 7, 14, 30))},
    {rolling_columns(lambda x: f'coalesce({x}, 0)')}, {IS_HOLIDAY} AS is_holiday FROM series)"""


def scaled(column: str) -> str:
    low = f"min({column}) OVER (PARTITION BY stock_code)"
    high = f"max({column}) OVER (PARTITION BY stock_code)"
    return f"({column} - {low}) / CASE WHEN {high} = {low} THEN CAST(1 AS DOUBLE) ELSE CAST({high} - {low} AS DOUBLE) END"


COMPETITOR = """competitor AS (SELECT cd, CASE WHEN dayofyear(cd) % 2 = 0 THEN avg(o_totalprice) END AS level
    FROM (SELECT CAST(o_orderdate AS DATE) AS cd, o_totalprice FROM orders) GROUP BY cd),
  priced AS (SELECT stock_code, d, quantity,
    coalesce(CASE WHEN dayofyear(cd) % 3 <> 0 THEN level * CAST(0.001 AS DOUBLE) END, our_price) AS our_price,
    level * CAST(0.00095 AS DOUBLE) AS a, level * CAST(0.001 AS DOUBLE) AS b, level * CAST(0.00105 AS DOUBLE) AS c
    FROM series LEFT JOIN competitor ON d = cd)"""


def filled(column: str) -> str:
    whole = "OVER (PARTITION BY stock_code ORDER BY d ROWS BETWEEN"
    return f"""coalesce(last_value({column} IGNORE NULLS) {whole} UNBOUNDED PRECEDING AND CURRENT ROW),
      first_value({column} IGNORE NULLS) {whole} CURRENT ROW AND UNBOUNDED FOLLOWING))"""


GROUPS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
SEGMENT_DAYS = (
    "segment_days AS (SELECT CAST(invoice_ts AS DATE) AS sd, "
    + ", ".join(
        f"sum(CASE WHEN market_segment = '{g}' THEN quantity ELSE 0 END) AS {g.lower()}" for g in GROUPS
    )
    + " FROM retail GROUP BY ALL)"
)

# Columns of groups whose names collide, in sorted order of the names A-B, A b, a-b.
COLLIDING = {
    "segment_a_b": "A b", "segment_a_b_2": "A-B", "segment_a_b_3": "a-b",
    "segment_automobile": "AUTOMOBILE", "segment_machinery": "MACHINERY",
}
COLLIDING_DAYS = (
    "segment_days AS (SELECT CAST(invoice_ts AS DATE) AS sd, "
    + ", ".join(f"sum(CASE WHEN g = '{g}' THEN quantity ELSE 0 END) AS {c}" for c, g in COLLIDING.items())
    + """ FROM (SELECT *, CASE market_segment WHEN 'BUILDING' THEN 'a-b' WHEN 'FURNITURE' THEN 'A b'
    WHEN 'HOUSEHOLD' THEN 'A-B' ELSE market_segment END AS g FROM retail) GROUP BY ALL)"""
)

# The days of the year that are holidays in each era, by another way to Easter: the Gauss
# formula for the Sunday, and days found by weekday instead of counting back.
ERA_HOLIDAYS = """
  WITH ordered AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS o FROM orders),
  days AS (SELECT DISTINCT CAST(o + to_months(12 * y) AS DATE) AS d FROM ordered, (VALUES (-104), (-28), (-16), (100), (300)) v(y)),
  parts AS (SELECT d, year(d) AS y, month(d) AS m, day(d) AS n, isodow(d) AS w, y % 19 AS a, y % 4 AS b, y % 7 AS c,
    y // 100 AS k, (13 + 8 * k) // 25 AS p, k // 4 AS q, (15 - p + k - q) % 30 AS mm, (4 + k - q) % 7 AS nn,
    (19 * a + mm) % 30 AS dd, (2 * b + 4 * c + 6 * dd + nn) % 7 AS ee FROM days),
  easter AS (SELECT *, make_date(CAST(y AS BIGINT), 3, 22) + CAST(dd + ee - CASE WHEN (dd = 29 AND ee = 6)
    OR (dd = 28 AND ee = 6 AND (11 * mm + 11) % 30 < 19) THEN 7 ELSE 0 END AS INTEGER) AS sunday FROM parts)
  SELECT strftime(d, '%Y-%m-%d') AS day, CAST(coalesce(
    d = sunday - 2 OR (y >= 1871 AND d = sunday + 1) OR (m = 12 AND n = 25) OR (y >= 1871 AND m = 12 AND n = 26)
    OR (y BETWEEN 1871 AND 1970 AND (d = sunday + 50 OR (m = 8 AND w = 1 AND n <= 7) OR (m = 12 AND n = 27 AND w = 1)))
    OR (y >= 1971 AND w = 1 AND ((m = 5 AND n >= 25 AND NOT (y IN (2002, 2012, 2022))) OR (m = 8 AND n >= 25)))
    OR (y >= 1971 AND m = 12 AND n IN (27, 28) AND w IN (1, 2))
    OR (y >= 1974 AND m = 1 AND (n = 1 OR (w = 1 AND n IN (2, 3))))
    OR (y >= 1978 AND m = 5 AND w = 1 AND n <= 7 AND NOT (y IN (1995, 2020)))
    OR strftime(d, '%Y-%m-%d') IN ('1977-06-07', '1981-07-29', '1995-05-08', '1999-12-31', '2002-06-03', '2002-06-04',
      '2011-04-29', '2012-06-04', '2012-06-05', '2020-05-08', '2022-06-02', '2022-06-03', '2022-09-19', '2023-05-08'),
    false) AS INTEGER) AS is_holiday FROM easter"""

PREDICTIONS = f"""predictions AS (SELECT * FROM (SELECT stock_code, d, quantity AS actual,
    lag(quantity, 7) {W} AS predicted FROM series) WHERE predicted IS NOT NULL)"""
FUTURE = """recent AS (SELECT *, row_number() OVER (PARTITION BY stock_code ORDER BY d DESC) AS back FROM series),
  ahead AS (SELECT stock_code, CAST(d + 30 AS DATE) AS d, CAST(31 - back AS INTEGER) AS step,
    quantity * CAST(1.1 AS DOUBLE) - 3 AS future_forecast FROM recent WHERE back <= 30)"""
FORECAST = with_(RETAIL, DAILY, PREDICTIONS, FUTURE)
GROWTH = """growth AS (SELECT *, CASE WHEN past_avg > 0 THEN (future_avg - past_avg) / past_avg * 100 ELSE 0 END AS growth
    FROM (SELECT stock_code, avg(quantity) AS past_avg FROM recent WHERE back <= 30 GROUP BY stock_code)
    JOIN (SELECT stock_code, avg(future_forecast) AS future_avg FROM ahead GROUP BY stock_code) USING (stock_code))"""
TREND = "CASE WHEN growth > 5 THEN 'up' WHEN growth < -5 THEN 'down' ELSE 'stable' END AS trend"

CURVE = f"""last_prices AS (SELECT stock_code, arg_max(our_price, d) AS current_price
    FROM series GROUP BY stock_code),
  bounds AS (SELECT *, current_price * CAST(0.8 AS DOUBLE) AS low, current_price * CAST(1.2 AS DOUBLE) AS high
    FROM last_prices),
  grid AS (SELECT stock_code, current_price, CAST(point AS INTEGER) AS point,
    CASE WHEN point = 19 THEN high ELSE point * ((high - low) / 19) + low END AS price
    FROM bounds, range(20) r(point)),
  demand AS (SELECT *, greatest(CAST(0 AS DOUBLE), 100 - 60 * price / current_price) AS units FROM grid),
  curve AS (SELECT *, price * units AS revenue,
    row_number() OVER (PARTITION BY stock_code ORDER BY price * units DESC, price) AS place,
    row_number() OVER (PARTITION BY stock_code ORDER BY round(abs(price / current_price - 1), 9), price) AS near FROM demand)"""
PRICES = with_(RETAIL, DAILY, CURVE)
CURVE_ROW = f"""stock_code, {rnd('current_price', 4)} AS current_price, point, {rnd('price', 4)} AS price,
    {rnd('units', 4)} AS total_predicted_quantity, {rnd('revenue', 4)} AS total_predicted_revenue"""

# A day's scaled quantity from yesterday's scaled quantity and price, by least squares over
# the training days of all products.
YESTERDAY = f"""unit AS (SELECT *, (quantity - ql) / ql_span AS q, (our_price - pl) / pl_span AS p FROM (SELECT *,
    min(quantity) OVER s AS ql, CASE WHEN max(quantity) OVER s = min(quantity) OVER s THEN CAST(1 AS DOUBLE)
      ELSE max(quantity) OVER s - min(quantity) OVER s END AS ql_span,
    min(our_price) OVER s AS pl, CASE WHEN max(our_price) OVER s = min(our_price) OVER s THEN CAST(1 AS DOUBLE)
      ELSE max(our_price) OVER s - min(our_price) OVER s END AS pl_span FROM series WINDOW s AS (PARTITION BY stock_code))),
  lagged AS (SELECT *, lag(q) {W} AS x1, lag(p) {W} AS x2, row_number() {W} - 1 AS sample,
    count(*) OVER (PARTITION BY stock_code) - 1 AS n FROM unit),
  known AS (SELECT *, floor(n * CAST(0.7 AS DOUBLE)) AS train, floor(n * CAST(0.15 AS DOUBLE)) AS checked FROM lagged
    WHERE sample > 0),
  usable AS (SELECT * FROM known WHERE checked >= 1 AND train >= 1),
  tested AS (SELECT * FROM usable WHERE sample > train + checked),
  moments AS (SELECT var_pop(x1) AS s11, var_pop(x2) AS s22, covar_pop(x1, x2) AS s12, covar_pop(x1, q) AS s1, covar_pop(x2, q) AS s2,
    avg(x1) AS m1, avg(x2) AS m2, avg(q) AS m FROM usable WHERE sample <= train),
  slopes AS (SELECT *, (s22 * s1 - s12 * s2) / (s11 * s22 - s12 * s12) AS b1, (s11 * s2 - s12 * s1) / (s11 * s22 - s12 * s12) AS b2
    FROM moments),
  weights AS (SELECT b1, b2, m - b1 * m1 - b2 * m2 AS b0 FROM slopes),
  ends AS (SELECT stock_code, max(d) AS d, arg_max(q, d) AS q, arg_max(p, d) AS p, arg_max(our_price, d) AS current_price,
    any_value(ql) AS ql, any_value(ql_span) AS ql_span, any_value(pl) AS pl, any_value(pl_span) AS pl_span
    FROM usable GROUP BY stock_code),
  path AS (SELECT stock_code, 0 AS step, d, q, p, ql, ql_span FROM ends
    UNION ALL SELECT stock_code, step + 1, CAST(d + 1 AS DATE), b0 + b1 * q + b2 * p, p, ql, ql_span FROM path, weights WHERE step < 10)"""
URGENT = f"{JOINED} WHERE o_orderpriority = '1-URGENT'"
PRICE_CHANGES = f"""changes AS (SELECT CAST(l_partkey AS VARCHAR) AS stock_code, o_orderdate AS invoice_ts,
    max(l_extendedprice / l_quantity) AS list_price FROM {URGENT} GROUP BY ALL)"""
BRAND_CHANGES = f"""changes AS (SELECT p_brand AS stock_code, CAST(o_orderdate AS DATE) AS d,
    max(l_extendedprice / l_quantity * CAST(0.95 AS DOUBLE)) AS competitor_a, max(l_extendedprice / l_quantity) AS competitor_b
    FROM {URGENT} GROUP BY ALL)"""
PROMOTIONS = f"""promotions AS (SELECT DISTINCT p_brand AS stock_code, o_orderpriority AS priority, CAST(o_orderdate AS DATE) AS first_day,
    CAST(o_orderdate AS DATE) + CAST(l_quantity AS INTEGER) AS last_day FROM {JOINED})"""
# A reservoir of two units, and its readout.
UNIT_A = "0.5::DOUBLE * {q} - 0.3::DOUBLE * {p} + 0.4::DOUBLE * {a} + 0.1::DOUBLE * {b} + 0.1::DOUBLE"
UNIT_B = "0.2::DOUBLE * {q} + 0.4::DOUBLE * {p} - 0.2::DOUBLE * {a} + 0.5::DOUBLE * {b} - 0.1::DOUBLE"
READ_OUT = "(0.05::DOUBLE + 0.3::DOUBLE * a - 0.2::DOUBLE * b + 0.5::DOUBLE * q + 0.1::DOUBLE * p)"
RECOMMENDED = """asked AS (SELECT *, current_price * CAST(0.8 AS DOUBLE) AS low, current_price * CAST(1.2 AS DOUBLE) AS high FROM ends
    WHERE current_price <> 0),
  offers AS (SELECT *, CASE WHEN point = 19 THEN high ELSE point * ((high - low) / 19) + low END AS price FROM asked, range(20) r(point)),
  sold_at AS (SELECT stock_code, current_price, point, price, (price - pl) / pl_span AS sp, ql, ql_span, 0 AS step, q,
      CAST(0 AS DOUBLE) AS units FROM offers
    UNION ALL SELECT stock_code, current_price, point, price, sp, ql, ql_span, step + 1, b0 + b1 * q + b2 * sp,
      units + greatest(CAST(0 AS DOUBLE), (b0 + b1 * q + b2 * sp) * ql_span + ql) FROM sold_at, weights WHERE step < 7),
  priced AS (SELECT *, price * units AS revenue, row_number() OVER (PARTITION BY stock_code ORDER BY price * units DESC, price) AS place,
    row_number() OVER (PARTITION BY stock_code ORDER BY round(abs(price / current_price - 1), 9), price) AS near FROM sold_at WHERE step = 7)"""
# Yesterday's price, one of two, decides most of a day's quantity: the means of the training
# days by that price are what one cut can learn.
TWO_PRICES = f"""numbered AS (SELECT stock_code, d, date_diff('day', DATE '1992-01-01', d) AS t FROM series),
  made AS (SELECT stock_code, d, CASE WHEN ((t * t * 7 + t * 3) // 4) % 2 = 0 THEN 1 ELSE 2 END AS price,
    CAST(20 + 30 * (CASE WHEN (((t - 1) * (t - 1) * 7 + (t - 1) * 3) // 4) % 2 = 0 THEN 0 ELSE 1 END) + t % 5 AS DOUBLE) AS quantity
    FROM numbered),
  lagged AS (SELECT *, lag(price) {W} AS before, row_number() {W} - 1 AS sample, count(*) OVER (PARTITION BY stock_code) - 1 AS n,
    min(quantity) OVER (PARTITION BY stock_code) AS low,
    max(quantity) OVER (PARTITION BY stock_code) - min(quantity) OVER (PARTITION BY stock_code) AS span FROM made),
  known AS (SELECT *, floor(n * CAST(0.7 AS DOUBLE)) AS train, floor(n * CAST(0.15 AS DOUBLE)) AS checked FROM lagged WHERE sample > 0),
  tested AS (SELECT * FROM known WHERE sample > train + checked),
  leaves AS (SELECT before, avg((quantity - low) / span) AS level FROM known WHERE sample <= train GROUP BY before),
  ends AS (SELECT stock_code, max(d) AS d, arg_max(price, d) AS price, any_value(low) AS low, any_value(span) AS span
    FROM known GROUP BY stock_code)"""

REQUIRED = (
    "invoice", "stock_code", "description", "quantity", "invoice_ts", "price", "customer_id", "country",
)

ATTACHED = with_(
    DIRTY,
    f"sales AS (SELECT * REPLACE (coalesce(customer_id, 'Unknown') AS customer_id), {FEATURES} "
    "FROM dirty WHERE quantity > 0 AND price > 0)",
    "known AS (SELECT * FROM sales WHERE customer_id <> 'Unknown')",
    rfm("known").replace("(SELECT max(invoice_ts) FROM known)", "(SELECT max(invoice_ts) FROM sales)"),
    SCORES,
    SEGMENTED,
    "attached AS (SELECT s.*, coalesce(segment, 'Unknown Customer') AS segment "
    "FROM sales s LEFT JOIN segmented g ON s.customer_id = g.customer_id)",
)

ATTACHED_CLUSTERS = time_text(
    """(SELECT r.* EXCLUDE (brand, market_segment), coalesce(cluster_name, 'Unknown Customer') AS cluster_name
  FROM (SELECT *, COLS FROM retail) r LEFT JOIN named n ON r.customer_id = n.customer_id)""".replace("COLS", FEATURES)
)

CUSTOMER_LINES = "(SELECT * FROM dirty WHERE quantity > 0 AND price > 0)"

ORACLE: dict[str, str] = {
    "column_check": f"""SELECT c AS "column", true AS present, (SELECT count(*) FROM lineitem) AS rows
  FROM unnest([{', '.join(map(text, REQUIRED))}]) t(c)""",
    "preview": with_(RETAIL)
    + """SELECT invoice, stock_code, quantity, price FROM retail
  ORDER BY invoice, stock_code, quantity, price LIMIT 5""",
    "clean_positive": with_(DIRTY, POSITIVE) + time_text("positive"),
    "clean_iqr": with_(DIRTY, POSITIVE, IQR) + time_text("by_price"),
    "clean_impute": with_(DIRTY, imputed("dirty")) + time_text("imputed"),
    "clean_features": with_(EVENTS, EVENT_SALES) + time_text("sales"),
    "clean_full": with_(DIRTY, POSITIVE, IQR, imputed("by_price"))
    + time_text(f"(SELECT *, {FEATURES} FROM imputed)"),
    "distinct_products": with_(RETAIL) + "SELECT DISTINCT description FROM retail",
    "distinct_stock_codes": with_(RETAIL) + "SELECT DISTINCT stock_code FROM retail",
    "monthly_revenue": BASE + revenue_by("year_month"),
    "weekday_revenue": BASE + revenue_by("weekday_no, weekday"),
    "hourly_revenue": with_(EVENTS, EVENT_SALES) + revenue_by("hour"),
    "country_revenue": BASE + revenue_by("country"),
    "top_products": BASE
    + f"SELECT description, {rnd('sum(revenue)', 2)} AS revenue FROM sales GROUP BY description "
    + "ORDER BY sum(revenue) DESC, description LIMIT 10",
    "bottom_products": BASE
    + f"SELECT description, {rnd('sum(revenue)', 2)} AS revenue FROM sales WHERE description <> 'Unknown' "
    + "GROUP BY description ORDER BY sum(revenue), description LIMIT 10",
    "bottom_countries": BASE
    + f"SELECT country, {rnd('sum(revenue)', 2)} AS revenue FROM sales GROUP BY country "
    + "ORDER BY sum(revenue), country LIMIT 10",
    "new_vs_returning": with_(DIRTY)
    + f"""SELECT CASE WHEN n = 1 THEN 'New Customers' ELSE 'Returning Customers' END AS customer_category,
    {rnd('sum(quantity * price)', 2)} AS revenue
  FROM {CUSTOMER_LINES} s
  JOIN (SELECT customer_id, count(DISTINCT invoice) AS n FROM {CUSTOMER_LINES} GROUP BY customer_id) c
    ON s.customer_id = c.customer_id GROUP BY 1""",
    "avg_order_value": BASE
    + f"""SELECT year_month, {rnd('avg(total)', 3)} AS avg_order_value
  FROM (SELECT year_month, invoice, sum(revenue) AS total FROM sales GROUP BY ALL) GROUP BY year_month""",
    "market_basket": with_(RETAIL)
    + """, top AS (SELECT description FROM retail GROUP BY 1 ORDER BY count(*) DESC, description LIMIT 15),
  held AS (SELECT DISTINCT invoice, description FROM retail WHERE description IN (FROM top)),
  pairs AS (SELECT a.description AS a, b.description AS b, count(*) AS n FROM held a JOIN held b
    ON a.invoice = b.invoice WHERE a.description <> b.description GROUP BY ALL)
  SELECT x.description AS product_a, y.description AS product_b, coalesce(n, 0) AS invoices
  FROM top x CROSS JOIN top y LEFT JOIN pairs ON a = x.description AND b = y.description""",
    "sales_kpis": BASE + kpis(),
    "sales_kpis_by_hour": with_(EVENTS, EVENT_SALES) + kpis(),
    "product_kpis": BASE
    + f"""SELECT description, {rnd('sum(revenue)', 2)} AS revenue, {rnd('sum(quantity)', 2)} AS units,
    {rnd('avg(price)', 2)} AS avg_price, count(DISTINCT country) AS countries FROM sales GROUP BY description""",
    "product_trends": BASE
    + "\nUNION ALL\n".join(
        f"""SELECT description, '{name}' AS trend, {"CAST(any_value(weekday_no) + 1 AS INTEGER)" if name == "weekday" else "CAST(NULL AS INTEGER)"}
    AS weekday_place, {column} AS key, {rnd('sum(revenue)', 2)} AS revenue
  FROM sales GROUP BY description, {column}"""
        for name, column in (("month", "year_month"), ("weekday", "weekday"), ("country", "country"))
    ),
    "product_sales_kpis": BASE + kpis("description"),
    "rfm": with_(RETAIL, SALES, rfm("sales"))
    + f"SELECT customer_id, recency, frequency, {rnd('monetary', 2)} AS monetary FROM rfm",
    "rfm_subday": with_(EVENTS, EVENT_SALES, rfm("sales"))
    + f"SELECT customer_id, recency, frequency, {rnd('monetary', 2)} AS monetary FROM rfm",
    "rfm_scores": CUSTOMERS + "SELECT customer_id, r_score, f_score, m_score FROM scored",
    "rfm_segments": CUSTOMERS + "SELECT customer_id, segment, action FROM acted",
    "segment_actions": CUSTOMERS + "SELECT DISTINCT segment, action FROM acted",
    "segment_counts": CUSTOMERS + "SELECT segment, count(*) AS customers FROM acted GROUP BY segment",
    "segment_sales": CUSTOMERS
    + f"SELECT segment, {rnd('sum(monetary)', 2)} AS monetary FROM acted GROUP BY segment",
    "segment_share": CUSTOMERS + group_share("segment", "acted"),
    "segment_summary": CUSTOMERS + group_summary("segment", "acted"),
    "segment_kpis": CUSTOMERS
    + f"""SELECT kpi, segment AS "group", {rnd('c', 4)} AS customer_share, {rnd('revenue', 4)} AS revenue,
    {rnd('s', 4)} AS revenue_share FROM (SELECT *, customers / sum(customers) OVER () * 100 AS c,
      revenue / sum(revenue) OVER () * 100 AS s,
      CASE WHEN row_number() OVER (ORDER BY revenue DESC, segment) = 1 THEN 'most_valuable'
        WHEN row_number() OVER (ORDER BY revenue, segment DESC) = 1 THEN 'least_revenue' END AS kpi
    FROM (SELECT segment, count(*) AS customers, sum(monetary) AS revenue FROM acted GROUP BY segment))
  WHERE kpi IS NOT NULL""",
    "sales_with_segments": ATTACHED + time_text("attached"),
    "sales_with_segments_csv": ATTACHED + time_text("attached"),
    "segment_sales_csv": ATTACHED
    + f"SELECT {DAY}, segment, sum(quantity) AS quantity FROM "
    + "(SELECT CAST(invoice_ts AS DATE) AS d, segment, quantity FROM attached) GROUP BY d, segment",
    "sales_csv": with_(DIRTY) + time_text("dirty"),
    "competitor_csv": with_(RETAIL, DAILY, COMPETITOR)
    + f"""SELECT strftime(cd, '%Y-%m-%d') AS day,
    {rnd('CASE WHEN dayofyear(cd) % 3 <> 0 THEN level * CAST(0.001 AS DOUBLE) END', 4)} AS our_price,
    {rnd('level * CAST(0.00095 AS DOUBLE)', 4)} AS competitor_a, {rnd('level * CAST(0.001 AS DOUBLE)', 4)}
    AS competitor_b, {rnd('level * CAST(0.00105 AS DOUBLE)', 4)} AS competitor_c FROM competitor""",
    "segment_summary_csv": CUSTOMERS + group_summary("segment", "acted"),
    "cluster_summary_csv": CLUSTERS + group_summary("cluster_name", "named"),
    "sales_with_clusters": CLUSTERS + ATTACHED_CLUSTERS,
    "sales_with_clusters_csv": CLUSTERS + ATTACHED_CLUSTERS,
    "product_sales": with_(RETAIL)
    + time_text("(SELECT * EXCLUDE (brand, market_segment) FROM retail WHERE description = 'red widget')"),
    "one_series": SERIES
    + f"SELECT stock_code, {DAY}, quantity, {rnd('our_price', 4)} AS our_price FROM gaps WHERE stock_code = 'Brand#12'",
    "forecast_overall_metrics": FORECAST
    + f"""SELECT {rnd('avg(abs(actual - predicted))', 4)} AS mae,
    {rnd('sqrt(avg((actual - predicted) * (actual - predicted)))', 4)} AS rmse FROM predictions""",
    "rfm_scaled": with_(RETAIL, SALES, rfm("sales"))
    + "SELECT customer_id, "
    + ", ".join(
        f"{rnd(f'({m} - avg({m}) OVER ()) / stddev_pop({m}) OVER ()', 6)} AS {m}_scaled"
        for m in ("recency", "frequency", "monetary")
    )
    + " FROM rfm",
    "cluster_names": CLUSTERS + "SELECT cluster, cluster_name FROM named_clusters",
    "cluster_summary": CLUSTERS + group_summary("cluster_name", "named"),
    "cluster_sales": CLUSTERS
    + f"SELECT cluster_name, {rnd('sum(monetary)', 2)} AS monetary FROM named GROUP BY cluster_name",
    "cluster_share": CLUSTERS + group_share("cluster_name", "named"),
    "cluster_means": CLUSTERS
    + "SELECT cluster_name, "
    + ", ".join(f"{rnd(f'avg({m})', 4)} AS avg_{m}" for m in ("recency", "frequency", "monetary"))
    + " FROM named GROUP BY cluster_name",
    "cluster_profile": CLUSTERS
    + "SELECT cluster, cluster_name, "
    + ", ".join(f"{rnd(f'avg({m})', 2)} AS avg_{m}" for m in ("recency", "frequency", "monetary"))
    + f", count(*) AS customer_count, {profile_text(1)} AS interpretation, {profile_text(2)} AS strategy "
    + "FROM named GROUP BY cluster, cluster_name",
    "daily_series": SERIES
    + f"SELECT stock_code, {DAY}, quantity, {rnd('our_price', 4)} AS our_price FROM gaps",
    "price_fill": SERIES + f"SELECT stock_code, {DAY}, quantity, {rnd('our_price', 4)} AS our_price FROM series",
    "competitor_join": with_(RETAIL, DAILY, COMPETITOR)
    + f"""SELECT stock_code, {DAY}, quantity, {rnd('our_price', 4)} AS our_price,
    {rnd(filled('a'), 4)} AS competitor_a, {rnd(filled('b'), 4)} AS competitor_b,
    {rnd(filled('c'), 4)} AS competitor_c FROM priced""",
    "segment_join": with_(RETAIL, DAILY, SEGMENT_DAYS)
    + f"SELECT stock_code, {DAY}, quantity, "
    + ", ".join(f"coalesce({g.lower()}, CAST(0 AS DOUBLE)) AS segment_{g.lower()}" for g in GROUPS)
    + " FROM series LEFT JOIN segment_days ON d = sd",
    "calendar_features": SERIES + f"SELECT stock_code, {DAY}, quantity, {CALENDAR} FROM series",
    "segment_join_colliding": with_(RETAIL, DAILY, COLLIDING_DAYS)
    + f"SELECT stock_code, {DAY}, quantity, "
    + ", ".join(f"coalesce({c}, CAST(0 AS DOUBLE)) AS {c}" for c in COLLIDING)
    + " FROM series LEFT JOIN segment_days ON d = sd",
    "holidays_of_other_eras": ERA_HOLIDAYS,
    "lags": SERIES + f"SELECT stock_code, {DAY}, quantity, {LAGS} FROM series",
    "rolling": SERIES
    + f"SELECT stock_code, {DAY}, quantity, {rolling_columns(lambda x: rnd(x, 6))} FROM series",
    "holiday_flag": SERIES + f"SELECT stock_code, {DAY}, quantity, {IS_HOLIDAY} AS is_holiday FROM series",
    "feature_table": with_(RETAIL, DAILY, FEATURE_TABLE)
    + f"""SELECT stock_code, {DAY}, quantity, {rnd('our_price', 4)} AS our_price, day_of_week, month, week_of_year,
    {', '.join(f'lag_{i}_days' for i in (1, 7, 14, 30))},
    {', '.join(f'{rnd(c, 6)} AS {c}' for c in FEATURE_NAMES if c.startswith('rolling'))}, is_holiday FROM features""",
    "minmax": with_(RETAIL, DAILY, FEATURE_TABLE)
    + f"SELECT stock_code, {DAY}, "
    + ", ".join(f"{rnd(scaled(c), 6)} AS {c}" for c in FEATURE_NAMES)
    + " FROM features",
    "sequences": with_(
        RETAIL,
        DAILY,
        FEATURE_TABLE,
        "unit AS (SELECT stock_code, d, "
        + ", ".join(f"{scaled(c)} AS {c}" for c in FEATURE_NAMES)
        + " FROM features)",
    )
    + f"""SELECT stock_code, {DAY}, sample, CAST(90 AS INTEGER) AS days, {', '.join(
        f'{rnd(f"{kind}_{c}", 6)} AS {kind}_{c}' for kind in ("first", "last", "low", "high") for c in FEATURE_NAMES
    )}, {rnd('quantity', 6)} AS target_0, {rnd('t1', 6)} AS target_1, {rnd('t2', 6)} AS target_2
  FROM (SELECT stock_code, d, quantity, CAST(row_number() {W} - 90 AS INTEGER) AS sample, {', '.join(
        f'first_value({c}) OVER past AS first_{c}, last_value({c}) OVER past AS last_{c}, '
        f'min({c}) OVER past AS low_{c}, max({c}) OVER past AS high_{c}'
        for c in FEATURE_NAMES
    )}, lead(quantity, 1) {W} AS t1, lead(quantity, 2) {W} AS t2
    FROM unit WINDOW past AS (PARTITION BY stock_code ORDER BY d ROWS BETWEEN 90 PRECEDING AND 1 PRECEDING))
  WHERE sample > 0 AND t2 IS NOT NULL""",
    "split": SERIES
    + f"""SELECT stock_code, {DAY}, sample, CASE WHEN sample <= floor(n * CAST(0.7 AS DOUBLE)) THEN 'train'
    WHEN sample <= floor(n * CAST(0.7 AS DOUBLE)) + floor(n * CAST(0.15 AS DOUBLE)) THEN 'validation'
    ELSE 'test' END AS part
  FROM (SELECT stock_code, d, CAST(row_number() {W} - 90 AS INTEGER) AS sample,
    count(*) OVER (PARTITION BY stock_code) - 90 AS n FROM series) WHERE sample > 0""",
    "forecast_rejects": with_(RETAIL)
    + """SELECT stock_code, days, samples, CASE WHEN samples < 1 THEN 'not enough days for one window'
    WHEN floor(samples * CAST(0.15 AS DOUBLE)) < 1 THEN 'no validation samples'
    WHEN floor(samples * CAST(0.7 AS DOUBLE)) < 1 THEN 'no training samples' END AS reason
  FROM (SELECT stock_code, days, greatest(days - 90, 0) AS samples
    FROM (SELECT stock_code, CAST(date_diff('day', min(invoice_ts), max(invoice_ts)) + 1 AS INTEGER) AS days
      FROM retail GROUP BY stock_code))""",
    "forecast_metrics": FORECAST
    + f"""SELECT stock_code, {rnd('avg(abs(actual - predicted))', 4)} AS mae,
    {rnd('sqrt(avg((actual - predicted) * (actual - predicted)))', 4)} AS rmse FROM predictions GROUP BY stock_code""",
    "forecast_series": FORECAST
    + "\nUNION ALL\n".join(
        f"SELECT stock_code, {DAY}, '{kind}' AS kind, {rnd(column, 4)} AS value FROM {source}"
        for kind, column, source in (
            ("actual", "actual", "predictions"),
            ("predicted", "predicted", "predictions"),
            ("future", "future_forecast", "ahead"),
        )
    ),
    "forecast_weekday": FORECAST
    + f"""SELECT stock_code, dayname(d) AS weekday, {rnd('sum(future_forecast)', 4)} AS future_forecast
  FROM ahead GROUP BY ALL""",
    "forecast_growth": with_(RETAIL, DAILY, PREDICTIONS, FUTURE, GROWTH)
    + f"""SELECT stock_code, {rnd('past_avg', 4)} AS past_avg, {rnd('future_avg', 4)} AS future_avg,
    {rnd('growth', 4)} AS growth_pct, {TREND} FROM growth""",
    "forecast_rounded": FORECAST
    + f"SELECT stock_code, {DAY}, CAST(round_even(future_forecast, 0) AS INTEGER) AS future_forecast FROM ahead",
    "forecast_kpis": with_(
        RETAIL,
        DAILY,
        PREDICTIONS,
        FUTURE,
        GROWTH,
        "week_days AS (SELECT stock_code, dayname(d) AS weekday, sum(future_forecast) AS total FROM ahead GROUP BY ALL)",
        """extremes AS (SELECT stock_code, max(CASE WHEN hi = 1 THEN weekday END) AS best_weekday,
    max(CASE WHEN lo = 1 THEN weekday END) AS worst_weekday
    FROM (SELECT *, row_number() OVER (PARTITION BY stock_code ORDER BY total DESC, weekday) AS hi,
      row_number() OVER (PARTITION BY stock_code ORDER BY total, weekday) AS lo FROM week_days) GROUP BY stock_code)""",
        "errors AS (SELECT stock_code, avg(abs(actual - predicted)) AS mae FROM predictions GROUP BY stock_code)",
        "coming AS (SELECT stock_code, sum(future_forecast) AS units FROM ahead WHERE step <= 7 GROUP BY stock_code)",
    )
    + f"""SELECT stock_code, {rnd('mae', 4)} AS safety_stock, {rnd('units', 4)} AS next_7_days,
    best_weekday, worst_weekday, {rnd('growth', 4)} AS growth_pct, {TREND}
  FROM growth JOIN extremes USING (stock_code) JOIN errors USING (stock_code) JOIN coming USING (stock_code)""",
    "price_grid": PRICES + f"SELECT stock_code, {rnd('current_price', 6)} AS current_price, point, {rnd('price', 6)} AS price FROM curve",
    "price_curve_fixed": PRICES + f"SELECT {CURVE_ROW}, place = 1 AS is_best FROM curve",
    "best_price": PRICES + f"SELECT {CURVE_ROW} FROM curve WHERE place = 1",
    "price_uplift": PRICES
    + f"""SELECT stock_code, {rnd('current_price', 4)} AS current_price, {rnd('price', 4)} AS best_price,
    {rnd('base', 4)} AS baseline_revenue, {rnd('revenue - base', 4)} AS uplift,
    {rnd('CASE WHEN base > 0 THEN (revenue - base) / base * 100 ELSE 0 END', 4)} AS uplift_pct,
    {rnd('(price - current_price) / current_price * 100', 4)} AS price_change_pct,
    CASE WHEN price > current_price THEN 'increase' ELSE 'decrease' END AS direction,
    CASE WHEN price > current_price THEN 'not very sensitive' ELSE 'very sensitive' END AS sensitivity,
    {rnd('units', 4)} AS expected_units, {rnd('revenue', 4)} AS expected_revenue
  FROM (SELECT c.*, b.revenue AS base FROM curve c JOIN curve b ON c.stock_code = b.stock_code AND b.near = 1)
  WHERE place = 1""",
    "kmeans_planted": "SELECT CAST(c_custkey AS VARCHAR) AS customer_id, CAST(c_custkey % 4 AS INTEGER) AS cluster FROM customer",
    # With k clusters the closest 11 - k of the ten groups share one.
    "elbow_planted": f"""WITH points AS (SELECT c_custkey % 10 AS g, power(CAST(3 AS DOUBLE), c_custkey % 10) AS x FROM customer),
  shared AS (SELECT k, coalesce(var_pop(x) * count(x), 0) AS apart FROM range(1, 11) r(k) LEFT JOIN points ON g <= 10 - k GROUP BY k)
  SELECT CAST(k AS INTEGER) AS k, {rnd('3 * apart / (SELECT var_pop(x) FROM points)', 2)} AS wcss FROM shared""",
    "forecast_linear_exact": with_(RETAIL, DAILY, YESTERDAY).replace("WITH ", "WITH RECURSIVE ", 1)
    + f"""SELECT stock_code, {DAY}, 'actual' AS kind, {rnd('quantity', 3)} AS value FROM tested
  UNION ALL SELECT stock_code, {DAY}, 'predicted', {rnd('(b0 + b1 * x1 + b2 * x2) * ql_span + ql', 3)} FROM tested, weights
  UNION ALL SELECT stock_code, strftime(d, '%Y-%m-%d'), 'future', {rnd('q * ql_span + ql', 3)} FROM path WHERE step > 0""",
    "price_recommendation_exact": with_(RETAIL, DAILY, YESTERDAY, RECOMMENDED).replace("WITH ", "WITH RECURSIVE ", 1)
    + f"""SELECT stock_code, {rnd('current_price', 3)} AS current_price, {rnd('price', 3)} AS best_price,
    {rnd('base', 3)} AS baseline_revenue, {rnd('revenue - base', 3)} AS uplift,
    {rnd('CASE WHEN base > 0 THEN (revenue - base) / base * 100 ELSE 0 END', 3)} AS uplift_pct,
    {rnd('(price - current_price) / current_price * 100', 3)} AS price_change_pct,
    CASE WHEN price > current_price THEN 'increase' ELSE 'decrease' END AS direction,
    CASE WHEN price > current_price THEN 'not very sensitive' ELSE 'very sensitive' END AS sensitivity,
    {rnd('units', 3)} AS expected_units, {rnd('revenue', 3)} AS expected_revenue
  FROM (SELECT c.*, b.revenue AS base FROM priced c JOIN priced b ON c.stock_code = b.stock_code AND b.near = 1) WHERE place = 1""",
    "forecast_gbt_exact": with_(RETAIL, DAILY, TWO_PRICES)
    + f"""SELECT stock_code, {DAY}, 'actual' AS kind, {rnd('quantity', 3)} AS value FROM tested
  UNION ALL SELECT t.stock_code, {DAY}, 'predicted', {rnd('level * span + low', 3)} FROM tested t JOIN leaves l ON t.before = l.before
  UNION ALL SELECT e.stock_code, strftime(e.d + CAST(step AS INTEGER), '%Y-%m-%d'), 'future', {rnd('level * span + low', 3)}
  FROM ends e JOIN leaves l ON e.price = l.before, range(1, 11) r(step)""",
    "ridge_choice": with_(
        RETAIL,
        DAILY,
        YESTERDAY,
        "tried AS (SELECT unnest([0.0, 0.001, 0.01, 0.05, 0.2, 1.0])::DOUBLE AS strength)",
        """fits AS (SELECT strength, m1, m2, m, ((s22 + strength) * s1 - s12 * s2) / ((s11 + strength) * (s22 + strength) - s12 * s12) AS b1,
    ((s11 + strength) * s2 - s12 * s1) / ((s11 + strength) * (s22 + strength) - s12 * s12) AS b2 FROM moments, tried)""",
        """errors AS (SELECT strength, any_value(m - b1 * m1 - b2 * m2) AS b0, any_value(b1) AS b1, any_value(b2) AS b2,
    avg((q - (m - b1 * m1 - b2 * m2) - b1 * x1 - b2 * x2) ** 2) AS mse
    FROM fits, usable WHERE sample > train AND sample <= train + checked GROUP BY strength)""",
    ).replace("WITH ", "WITH RECURSIVE ", 1)
    + f"""SELECT strength, {rnd('b0', 7)} AS constant, {rnd('b1', 7)} AS by_quantity, {rnd('b2', 7)} AS by_price,
    {rnd('mse', 7)} AS validation_mse, row_number() OVER (ORDER BY mse, strength) = 1 AS chosen FROM errors""",
    "reservoir_path": with_(
        RETAIL,
        DAILY,
        YESTERDAY,
        f"""folds AS (SELECT stock_code, max(d) AS d, any_value(ql) AS ql, any_value(ql_span) AS ql_span,
    list_reduce(list_concat([{{'a': CAST(0 AS DOUBLE), 'b': CAST(0 AS DOUBLE), 'q': CAST(0 AS DOUBLE), 'p': CAST(0 AS DOUBLE)}}],
      list({{'a': CAST(0 AS DOUBLE), 'b': CAST(0 AS DOUBLE), 'q': q, 'p': p}} ORDER BY d)), lambda s, x: {{
      'a': 0.5::DOUBLE * s.a + 0.5::DOUBLE * tanh({UNIT_A.format(q='x.q', p='x.p', a='s.a', b='s.b')}),
      'b': 0.5::DOUBLE * s.b + 0.5::DOUBLE * tanh({UNIT_B.format(q='x.q', p='x.p', a='s.a', b='s.b')}), 'q': x.q, 'p': x.p}}) AS s
    FROM unit GROUP BY stock_code)""",
        f"""ahead AS (SELECT stock_code, 0 AS step, d, ql, ql_span, s.a AS a, s.b AS b, s.q AS q, s.p AS p FROM folds
    UNION ALL SELECT stock_code, step + 1, CAST(d + 1 AS DATE), ql, ql_span,
      0.5::DOUBLE * a + 0.5::DOUBLE * tanh({UNIT_A.format(q=READ_OUT, p='p', a='a', b='b')}),
      0.5::DOUBLE * b + 0.5::DOUBLE * tanh({UNIT_B.format(q=READ_OUT, p='p', a='a', b='b')}), {READ_OUT}, p FROM ahead WHERE step < 10)""",
    ).replace("WITH ", "WITH RECURSIVE ", 1)
    + f"SELECT stock_code, {DAY}, step, {rnd('q * ql_span + ql', 4)} AS future_forecast FROM ahead WHERE step > 0",
    "asof_prices": with_(RETAIL, PRICE_CHANGES)
    + f"""SELECT s.stock_code, strftime(s.invoice_ts, '%Y-%m-%d %H:%M:%S') AS invoice_ts, quantity,
    {rnd('c.list_price', 6)} AS list_price, {rnd('e.list_price', 6)} AS earlier_price FROM retail s
  ASOF LEFT JOIN changes c ON s.stock_code = c.stock_code AND s.invoice_ts >= c.invoice_ts
  ASOF LEFT JOIN changes e ON s.stock_code = e.stock_code AND s.invoice_ts > e.invoice_ts""",
    "price_changes": with_(RETAIL, DAILY, BRAND_CHANGES)
    + f"""SELECT s.stock_code, strftime(s.d, '%Y-%m-%d') AS day, quantity, {rnd('competitor_a', 6)} AS competitor_a,
    {rnd('competitor_b', 6)} AS competitor_b FROM series s ASOF LEFT JOIN changes c ON s.stock_code = c.stock_code AND s.d >= c.d""",
    "promotion_sales": with_(RETAIL, DAILY, PROMOTIONS)
    + """SELECT s.stock_code, strftime(first_day, '%Y-%m-%d') AS first_day, strftime(last_day, '%Y-%m-%d') AS last_day,
    count(*) AS days, sum(quantity) AS units FROM series s JOIN promotions p ON s.stock_code = p.stock_code
    AND d BETWEEN first_day AND last_day AND priority = '1-URGENT' GROUP BY ALL""",
    "promotion_overlaps": with_(RETAIL, DAILY, PROMOTIONS)
    + """SELECT a.stock_code, strftime(a.first_day, '%Y-%m-%d') AS first_day, strftime(a.last_day, '%Y-%m-%d') AS last_day,
    count(*) AS overlaps, sum(date_diff('day', greatest(a.first_day, b.first_day), least(a.last_day, b.last_day)) + 1)::BIGINT AS common_days
  FROM promotions a JOIN promotions b ON a.stock_code = b.stock_code AND a.first_day <= b.last_day AND b.first_day <= a.last_day
    AND a.priority = '1-URGENT' AND b.priority = '2-HIGH' GROUP BY ALL""",
    "feature_table_products": with_(RETAIL, DAILY, FEATURE_TABLE).replace("SELECT brand AS stock_code", "SELECT stock_code", 1)
    + f"""SELECT stock_code, count(*) AS days, {', '.join(f'{rnd(f"sum(CAST({c} AS DOUBLE))", 3)} AS {c}' for c in FEATURE_NAMES)}
  FROM features GROUP BY stock_code""",
    "forecast_linear_products": with_(RETAIL, DAILY, YESTERDAY).replace("SELECT brand AS stock_code", "SELECT stock_code", 1).replace("WITH ", "WITH RECURSIVE ", 1)
    + f"""SELECT e.stock_code, {rnd('mae', 4)} AS mae, {rnd('rmse', 4)} AS rmse, {rnd('(b0 + b1 * e.q + b2 * e.p) * e.ql_span + e.ql', 4)} AS future_forecast,
    CAST(NULL AS VARCHAR) AS reason FROM ends e, weights, (SELECT stock_code, avg(abs(quantity - (b0 + b1 * x1 + b2 * x2) * ql_span - ql)) AS mae,
      sqrt(avg((quantity - (b0 + b1 * x1 + b2 * x2) * ql_span - ql) ** 2)) AS rmse FROM tested, weights GROUP BY stock_code) t WHERE t.stock_code = e.stock_code
  UNION ALL SELECT stock_code, NULL, NULL, NULL, CASE WHEN n < 1 THEN 'not enough days for one window'
    WHEN floor(n * CAST(0.15 AS DOUBLE)) < 1 THEN 'no validation samples' ELSE 'no training samples' END
  FROM (SELECT stock_code, count(*) - 1 AS n FROM series GROUP BY stock_code)
  WHERE n < 1 OR floor(n * CAST(0.15 AS DOUBLE)) < 1 OR floor(n * CAST(0.7 AS DOUBLE)) < 1""",
    "summary_rollup": with_(RETAIL)
    + f"""SELECT country, strftime(invoice_ts, '%Y-%m') AS year_month, count(*) AS lines, sum(quantity) AS units,
    {rnd('sum(quantity * price)', 2)} AS revenue,
    count(DISTINCT customer_id) AS customers, count(DISTINCT invoice) AS invoices FROM retail GROUP BY ALL""",
    "incremental_loads": ATTACHED
    + f"""SELECT CASE WHEN invoice_ts >= DATE '1996-01-01' THEN 'new' ELSE 'old' END AS load, strftime(invoice_ts, '%Y-%m') AS year_month,
    segment, count(*) AS rows, {rnd('sum(quantity)', 2)} AS units FROM attached
    WHERE invoice_ts < DATE '1996-01-01' OR quantity > 25 GROUP BY ALL""",
    "stream_revenue": with_(EVENTS)
    + f"""SELECT country, CAST(isodow(invoice_ts) - 1 AS INTEGER) AS weekday_no, {rnd('sum(quantity * price)', 2)} AS revenue,
    {rnd('sum(quantity)', 2)} AS units FROM happened GROUP BY ALL""",
    "stream_rfm": with_(EVENTS, "sales AS (SELECT *, quantity * price AS revenue FROM happened)", rfm("sales"))
    + f"SELECT customer_id, recency, frequency, {rnd('monetary', 2)} AS monetary FROM rfm",
    "visits_by_gap": f"""WITH gaps AS (SELECT *, ts > lag(ts) OVER w + INTERVAL 6 HOURS AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  runs AS (SELECT *, count(*) FILTER (fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM gaps)
  SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS visit_start, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS visit_end,
    count(*) AS events, {rnd('sum(value)', 4)} AS value FROM runs GROUP BY user_id, run""",
    "event_properties": "SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "sales_faults": with_(RETAIL)
    + f"""SELECT stock_code, NULL AS reason, count(*) AS rows, {rnd('sum(quantity)', 2)} AS units FROM retail
    WHERE invoice::BIGINT % 13 <> 0 AND invoice::BIGINT % 17 <> 0 AND invoice::BIGINT % 19 <> 0 GROUP BY stock_code
  UNION ALL SELECT NULL, concat_ws(', ', CASE WHEN invoice::BIGINT % 13 = 0 THEN 'quantity is not a number' END,
    CASE WHEN invoice::BIGINT % 17 = 0 THEN 'invoice_ts is not a time' END,
    CASE WHEN invoice::BIGINT % 19 = 0 THEN 'price is not a number' END) AS reason, count(*), NULL FROM retail
    WHERE invoice::BIGINT % 13 = 0 OR invoice::BIGINT % 17 = 0 OR invoice::BIGINT % 19 = 0 GROUP BY ALL""",
}
