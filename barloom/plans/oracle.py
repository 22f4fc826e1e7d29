"""Shared SQL fragments for the checks."""

from __future__ import annotations

from barloom.sources.tables import SAMPLE_QUESTIONS

W = "PARTITION BY symbol ORDER BY date"

CTES = {
    "ticks": """ticks AS (
  SELECT l_suppkey AS symbol, CAST(o_orderdate AS DATE) AS date,
         100 * (1 - l_discount) * (1 + l_tax) + l_extendedprice / 99991 AS price, l_quantity AS qty,
         row_number() OVER (PARTITION BY l_suppkey, CAST(o_orderdate AS DATE)
           ORDER BY l_orderkey, l_linenumber, round((100 * (1 - l_discount) * (1 + l_tax) + l_extendedprice / 99991) * 1e7)) AS rn,
         count(*) OVER (PARTITION BY l_suppkey, CAST(o_orderdate AS DATE)) AS n
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey)""",
    "bars": """bars AS (
  SELECT symbol, date, max(CASE WHEN rn = 1 THEN price END) AS open, max(price) AS high, min(price) AS low,
         max(CASE WHEN rn = n THEN price END) AS close, CAST(sum(qty) AS BIGINT) AS volume
  FROM ticks GROUP BY symbol, date)""",
    "returns": f"""returns AS (
  SELECT symbol, date, ret FROM (
    SELECT symbol, date, close / lag(close) OVER ({W}) - 1 AS ret FROM bars) WHERE ret IS NOT NULL)""",
    "benchmark_returns": "benchmark_returns AS (SELECT date, avg(ret) AS ret FROM returns GROUP BY date)",
    "news": """news AS (
  SELECT event_id, user_id AS symbol, CAST(ts AS DATE) AS date, ts, event_type AS source,
         2 * CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) / 99 - 1 AS sentiment, value FROM events)""",
    "event_bars": """event_bars AS (
  SELECT user_id AS symbol, CAST(ts AS DATE) AS date, arg_min(value, (ts, event_id)) AS open, max(value) AS high,
         min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS volume
  FROM events GROUP BY 1, 2)""",
    "securities": """securities AS (
  SELECT s_suppkey AS symbol, s_name AS name, n_name AS sector, r_name AS asset_class, s_acctbal AS balance
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""",
    "weights": """weights AS (
  WITH v AS (SELECT symbol, sum(volume) AS v FROM bars GROUP BY symbol)
  SELECT 1 AS portfolio_id, symbol, 1.0::DOUBLE / count(*) OVER () AS weight FROM v
  UNION ALL SELECT 2, symbol, v::DOUBLE / (sum(v) OVER ())::DOUBLE FROM v)""",
    "holdings": """holdings AS (
  SELECT symbol, CAST(sum(volume) AS DOUBLE) AS quantity, arg_min(close, date) AS purchase_price,
         min(date) AS purchase_date, arg_max(close, date) AS current_price,
         CAST(symbol % 5 AS DOUBLE) AS dividend_yield,
         CASE symbol % 4 WHEN 0 THEN 'annual' WHEN 1 THEN 'semi_annual' WHEN 2 THEN 'quarterly' ELSE 'monthly' END AS frequency
  FROM bars GROUP BY symbol)""",
    "predictions": f"""predictions AS (
  WITH p AS (SELECT symbol, date, close AS y_true, row_number() OVER ({W}) AS rn, lag(close) OVER ({W}) AS naive,
               avg(close) OVER ({W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS mean5,
               avg(close) OVER ({W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS mean10 FROM bars)
  SELECT symbol, date, y_true, 'naive' AS model, naive AS y_pred FROM p WHERE rn > 10
  UNION ALL SELECT symbol, date, y_true, 'mean5', mean5 FROM p WHERE rn > 10
  UNION ALL SELECT symbol, date, y_true, 'mean10', mean10 FROM p WHERE rn > 10)""",
    "earnings": f"""earnings AS (
  SELECT symbol, date, eps_actual, lag(eps_actual) OVER ({W}) AS eps_estimate FROM (
    SELECT symbol, CAST(date_trunc('quarter', date) AS DATE) AS date, avg(close) AS eps_actual FROM bars GROUP BY 1, 2))""",
    "articles": """articles AS (
  SELECT doc_id, md5(CAST(doc_id AS VARCHAR)) AS id, split_part(text, chr(10), 1) AS title,
         'https://news.example/' || doc_id AS link, text AS content,
         CAST(DATE '2024-01-01' + CAST(doc_id % 90 AS INTEGER) AS DATE) AS published, source, lang FROM documents)""",
    "questions": """questions AS (
  SELECT conv_id * 1000 + turn AS query_id, CASE (conv_id + turn) % 3 WHEN 0 THEN text || ' ' || s WHEN 1 THEN text ELSE s || ' ' || text END AS query
  FROM (SELECT *, [__SAMPLES__][(conv_id + turn) % 5 + 1] AS s FROM conversations WHERE role = 'user'))""".replace(
        "__SAMPLES__", ", ".join(f"'{q}'" for q in SAMPLE_QUESTIONS)),
    "centroids": """centroids AS (
  SELECT label AS query_id, list(m ORDER BY i) AS embedding FROM (
    SELECT label, i, avg(v) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1)""",
    "vector_articles": """vector_articles AS (
  SELECT vec_id AS id, embedding, label, a.* EXCLUDE (id, doc_id), a.id AS article_id FROM embeddings JOIN articles a ON vec_id = doc_id)""",
    "portfolio_series": """portfolio_series AS (
  SELECT portfolio_id AS symbol, date, sum(weight * ret) AS ret FROM returns JOIN weights USING (symbol) GROUP BY 1, 2)""",
}

NEEDS = {
    "bars": ["ticks"], "returns": ["bars"], "benchmark_returns": ["returns"], "weights": ["bars"], "holdings": ["bars"],
    "predictions": ["bars"], "earnings": ["bars"], "portfolio_series": ["returns", "weights"],
    "vector_articles": ["articles"],
}


def shared_ctes(names: list[str]) -> str:
    order: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    return ",\n".join(CTES[n] for n in order)


def roll(fn: str, x: str, n: int, by: str = W) -> str:
    """Rolling aggregate that is null until n values are in the frame."""
    f = f"OVER ({by} ROWS {n - 1} PRECEDING)"
    return f"(CASE WHEN count({x}) {f} >= {n} THEN {fn}({x}) {f} END)"


def ema(x: str, span: int, rn: str = "rn", by: str = W) -> str:
    """Closed form of y = a*y' + (1-a)*x with y1 = x1; needs the row number."""
    a = f"({span - 1}.0::DOUBLE / {span + 1})"
    b = f"(CASE WHEN {rn} = 1 THEN {x} ELSE (2.0::DOUBLE / {span + 1}) * {x} END)"
    return f"(pow({a}, {rn} - 1) * sum({b} * pow({a}, 1 - {rn})) OVER ({by} ROWS UNBOUNDED PRECEDING))"
