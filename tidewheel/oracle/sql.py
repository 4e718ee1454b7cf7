"""Building blocks of the SQL twins."""

from __future__ import annotations

CANDLES = """candles AS (
  SELECT symbol, ts, first(value ORDER BY tick, event_id) AS open, max(value) AS high, min(value) AS low,
         last(value ORDER BY tick, event_id) AS close, sum(k) AS volume, sum(k * value) AS quote_volume, count(*) AS trades
  FROM (SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, ts AS tick, event_id, value,
               CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)
  GROUP BY symbol, ts)"""

DAILY = """candles AS (
  SELECT l_returnflag AS symbol, date_trunc('day', l_shipdate) AS ts, first(l_extendedprice ORDER BY l_orderkey, l_linenumber) AS open,
         max(l_extendedprice) AS high, min(l_extendedprice) AS low, last(l_extendedprice ORDER BY l_orderkey, l_linenumber) AS close,
         sum(l_quantity) AS volume, sum(l_quantity * l_extendedprice) AS quote_volume, count(*) AS trades
  FROM lineitem GROUP BY 1, 2)"""

#: a bar's key in results: hours since 1970
BAR = "CAST(floor(epoch(ts) / 3600) AS BIGINT) AS bar"
OVER = "PARTITION BY symbol ORDER BY ts"


def windows(*sizes: int) -> str:
    """Named windows w (all order), wa (up to this row), wb (before it) and w{n} (the last n rows)."""
    parts = [f"w AS ({OVER})", f"wa AS ({OVER} ROWS UNBOUNDED PRECEDING)", f"wb AS ({OVER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"]
    return "WINDOW " + ", ".join([*parts, *(f"w{n} AS ({OVER} ROWS {n - 1} PRECEDING)" for n in sizes)])


def rolling(agg: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) OVER w{n} = {n} THEN {agg}({x}) OVER w{n} END"


def final(body: str, doubles: list[str], others: list[str] = (), source: str = "f", digits: int = 6) -> str:
    """The query: key, rounded numbers, and other columns as they are."""
    cols = ["symbol", BAR, *(f'round("{c}", {digits}) AS "{c}"' for c in doubles), *(f'"{c}"' for c in others)]
    return f"WITH {body} SELECT {', '.join(cols)} FROM {source}"


def simple(select: dict[str, str], sizes: tuple[int, ...] = (), ints: tuple[str, ...] = (), source: str = CANDLES, digits: int = 6) -> str:
    """One stage of window expressions over candles."""
    cols = ", ".join(f'{x} AS "{k}"' for k, x in select.items())
    return final(f"{source}, f AS (SELECT symbol, ts, {cols} FROM candles {windows(*sizes)})", [k for k in select if k not in ints], list(ints), digits=digits)


def ewm(name: str, source: str, x: str, alpha: float, out: str, least: int = 1) -> str:
    """A stage that adds the recursive exponential mean in closed form: powers stay small for a few thousand rows."""
    d = repr(1 - alpha)
    return f"""{name} AS (SELECT * EXCLUDE (_k), CASE WHEN _k >= {least} THEN power({d}, _k - 1) *
      sum(CASE WHEN _k = 1 THEN {x} ELSE {alpha!r} * {x} * power({d}, 1 - _k) END) OVER ({OVER} ROWS UNBOUNDED PRECEDING) END AS "{out}"
      FROM (SELECT *, count({x}) OVER ({OVER} ROWS UNBOUNDED PRECEDING) AS _k FROM {source}))"""


def safe(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER w"


ATR = f"""{{src}}, r0 AS (SELECT *, greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')})) AS tr FROM candles {windows()}),
{ewm('r1', 'r0', 'tr', 1 / 14, 'ATR_14', 14)}"""

SWINGS = f"""s0 AS (SELECT *, row_number() OVER w - 1 AS i, {lag('high', 5)} AS t5, {lag('low', 5)} AS b5,
    max(high) OVER ({OVER} ROWS BETWEEN 10 PRECEDING AND 6 PRECEDING) AS told, max(high) OVER ({OVER} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS tnew,
    min(low) OVER ({OVER} ROWS BETWEEN 10 PRECEDING AND 6 PRECEDING) AS bold, min(low) OVER ({OVER} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS bnew
    FROM {{base}} {windows()}),
  s1 AS (SELECT *, CASE WHEN i >= 10 AND t5 > told AND t5 >= tnew THEN t5 END AS top, CASE WHEN i >= 10 AND b5 < bold AND b5 <= bnew THEN b5 END AS bot FROM s0),
  s2 AS (SELECT *, last_value(top IGNORE NULLS) OVER wa AS "Last_Swing_High", last_value(bot IGNORE NULLS) OVER wa AS "Last_Swing_Low",
    last_value(top IGNORE NULLS) OVER wb AS ptop, last_value(bot IGNORE NULLS) OVER wb AS pbot FROM s1 {windows()}),
  s3 AS (SELECT *, CAST(coalesce(top > ptop, false) AS INT) AS "Higher_High", CAST(coalesce(top <= ptop, false) AS INT) AS "Lower_High",
    CAST(coalesce(bot > pbot, false) AS INT) AS "Higher_Low", CAST(coalesce(bot <= pbot, false) AS INT) AS "Lower_Low",
    (close - "Last_Swing_High") / nullif(close, 0) AS "Distance_To_Swing_High", (close - "Last_Swing_Low") / nullif(close, 0) AS "Distance_To_Swing_Low" FROM s2)"""

#: the state machine itself, row by row
TREND = """ev AS (SELECT *, ("Higher_High" = 1 OR "Higher_Low" = 1) AS up, ("Lower_High" = 1 OR "Lower_Low" = 1) AS dn,
    coalesce(close > "Last_Swing_High", false) AS bu, coalesce(close < "Last_Swing_Low", false) AS bd FROM s3),
  machine AS (
    SELECT symbol, i, 0 AS before, CAST(0 AS INT) AS mid, CAST(0 AS INT) AS trend FROM ev WHERE i = 0
    UNION ALL
    SELECT e.symbol, e.i, m.trend,
      CASE WHEN e.up THEN CASE WHEN m.trend >= 0 OR e.bu THEN 1 ELSE m.trend END ELSE m.trend END,
      CASE WHEN e.dn THEN CASE WHEN (CASE WHEN e.up THEN CASE WHEN m.trend >= 0 OR e.bu THEN 1 ELSE m.trend END ELSE m.trend END) <= 0 OR e.bd THEN -1
                               ELSE (CASE WHEN e.up THEN CASE WHEN m.trend >= 0 OR e.bu THEN 1 ELSE m.trend END ELSE m.trend END) END
           ELSE CASE WHEN e.up THEN CASE WHEN m.trend >= 0 OR e.bu THEN 1 ELSE m.trend END ELSE m.trend END END
    FROM machine m JOIN ev e ON e.symbol = m.symbol AND e.i = m.i + 1),
  f AS (SELECT e.*, m.trend AS "Current_Trend", CAST((m.trend = 1 AND e.bu) OR (m.trend = -1 AND e.bd) AS INT) AS "Break_Of_Structure",
    CAST((e.up AND m.before < 0 AND e.bu) OR (e.dn AND m.mid > 0 AND e.bd) AS INT) AS "Change_Of_Character"
    FROM ev e JOIN machine m USING (symbol, i))"""


def order_blocks() -> str:
    """Zones by window, then every bar against every zone in view."""
    parts = [f"WITH {ATR.format(src=CANDLES)}, {SWINGS.format(base='r1')}"]
    parts.append(f"""z0 AS (SELECT *, coalesce({lag('close', 3)}, first_value(close) OVER wa) AS ref,
      last_value(CASE WHEN close < open THEN {{'lo': low, 'hi': high}} END IGNORE NULLS) OVER ({OVER} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS bear,
      last_value(CASE WHEN close > open THEN {{'lo': low, 'hi': high}} END IGNORE NULLS) OVER ({OVER} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS bull
      FROM s3 {windows()}),
    z1 AS (SELECT *, abs(close - ref) >= 2 * coalesce("ATR_14", 0) AS far, coalesce((close - ref) / nullif(ref, 0), 0) AS move FROM z0)""")
    cols = []
    for side, cond, z in (("Bullish", "(far OR move >= 0.03) AND close > ref AND close > \"Last_Swing_High\"", "bear"), ("Bearish", "(far OR move <= -0.03) AND close < ref AND close < \"Last_Swing_Low\"", "bull")):
        t = side[:4].lower()
        parts.append(f"""{t}z AS (SELECT symbol, i AS ci, {z}.lo AS zlo, {z}.hi AS zhi FROM z1 WHERE {cond} AND {z} IS NOT NULL),
    {t}j AS (SELECT b.symbol, b.i, b.close, z.ci, (zlo + zhi) / 2 AS mid, sum(CAST(b.close BETWEEN zlo AND zhi AS INT)) OVER (PARTITION BY b.symbol, z.ci ORDER BY b.i) AS retests
      FROM z1 b JOIN {t}z z ON b.symbol = z.symbol AND b.i BETWEEN z.ci AND z.ci + 500),
    {t}k AS (SELECT *, row_number() OVER (PARTITION BY symbol, i ORDER BY abs(close - mid), ci) AS rn FROM {t}j)""")
        cols += [f'CAST({t}k.ci IS NOT NULL AS INT) AS "{side}_OB_Exists"', f'round((b.close - {t}k.mid) / nullif(b.close, 0), 6) AS "Distance_To_{side}_OB"', f'b.i - {t}k.ci AS "{side}_OB_Age"', f'CAST(coalesce({t}k.retests, 0) AS INT) AS "{side}_OB_Retest_Count"']
    return ", ".join(parts) + f""" SELECT b.symbol, {BAR.replace('ts', 'b.ts')}, {', '.join(cols)} FROM z1 b
      LEFT JOIN bullk ON bullk.symbol = b.symbol AND bullk.i = b.i AND bullk.rn = 1 LEFT JOIN beark ON beark.symbol = b.symbol AND beark.i = b.i AND beark.rn = 1"""


def fair_value_gaps() -> str:
    return f"""WITH {CANDLES}, b AS (SELECT *, row_number() OVER w - 1 AS i, {lag('high', 2)} AS h2, {lag('low', 2)} AS l2 FROM candles {windows()}),
    z AS (SELECT symbol, i AS ci, 0 AS side, h2 AS zlo, low AS zhi FROM b WHERE low > h2 UNION ALL SELECT symbol, i, 1, high, l2 FROM b WHERE high < l2),
    j AS (SELECT b.symbol, b.i, b.close, z.ci, z.side, (zlo + zhi) / 2 AS mid, min(CASE WHEN b.close BETWEEN zlo AND zhi THEN b.i END) OVER (PARTITION BY b.symbol, z.ci, z.side) AS fi
      FROM b JOIN z ON b.symbol = z.symbol AND b.i BETWEEN z.ci AND z.ci + 500),
    a AS (SELECT *, coalesce(i = fi, false) AS filled FROM j WHERE fi IS NULL OR i <= fi),
    n AS (SELECT *, row_number() OVER (PARTITION BY symbol, i, side ORDER BY abs(close - mid), ci) AS rn FROM a WHERE NOT filled),
    m AS (SELECT *, row_number() OVER (PARTITION BY symbol, i ORDER BY ci DESC, side) AS rn FROM a)
    SELECT b.symbol, {BAR.replace('ts', 'b.ts')}, CAST(coalesce(low > h2, false) AS INT) AS "Bullish_FVG", CAST(coalesce(high < l2, false) AS INT) AS "Bearish_FVG",
      round((b.close - u.mid) / nullif(b.close, 0), 6) AS "Distance_To_Bullish_FVG", round((b.close - d.mid) / nullif(b.close, 0), 6) AS "Distance_To_Bearish_FVG",
      CAST(coalesce(m.filled, false) AS INT) AS "FVG_Filled", b.i - u.ci AS "FVG_Age"
    FROM b LEFT JOIN n u ON u.symbol = b.symbol AND u.i = b.i AND u.side = 0 AND u.rn = 1
      LEFT JOIN n d ON d.symbol = b.symbol AND d.i = b.i AND d.side = 1 AND d.rn = 1 LEFT JOIN m ON m.symbol = b.symbol AND m.i = b.i AND m.rn = 1"""
