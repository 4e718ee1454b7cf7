"""Market structure: swings, trend, breaks, order blocks, fair value gaps, and levels of the last day and week."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.operators.windows import before, carry, lag, ordered, ratio, upto

LOOKBACK = 5
#: bars that a zone stays in view, and the width of the join's bins, which has to be larger
MAX_AGE = 500
BIN = 512
OB_ATR, OB_MOVE, OB_LOOKBACK = 2.0, 0.03, 10


def numbered(df: DataFrame) -> DataFrame:
    """Add i: a bar's number in its symbol, from 0."""
    return df.withColumn("i", F.row_number().over(ordered()) - 1)


def swings(df: DataFrame, lookback: int = LOOKBACK) -> DataFrame:
    """Confirmed swings, `lookback` bars late: the price of a bar that is the first extreme of its surroundings."""
    n = F.row_number().over(ordered())
    old = ordered().rowsBetween(-2 * lookback, -lookback - 1)
    new = ordered().rowsBetween(-lookback + 1, 0)
    top, low = lag("high", lookback), lag("low", lookback)
    is_top = (n > 2 * lookback) & (top > F.max("high").over(old)) & (top >= F.max("high").over(new))
    is_low = (n > 2 * lookback) & (low < F.min("low").over(old)) & (low <= F.min("low").over(new))
    df = df.withColumns({"_top": F.when(is_top, top), "_low": F.when(is_low, low)})
    held = lambda c: F.last(c, ignorenulls=True).over(before())
    df = df.withColumns({"Last_Swing_High": carry(F.col("_top")), "Last_Swing_Low": carry(F.col("_low")), "_prior_top": held("_top"), "_prior_low": held("_low")})
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("int")
    t, pt, w, pw = (F.col(x) for x in ("_top", "_prior_top", "_low", "_prior_low"))
    df = df.withColumns({"Higher_High": flag(t > pt), "Lower_High": flag(t <= pt), "Higher_Low": flag(w > pw), "Lower_Low": flag(w <= pw)})
    c = F.col("close")
    df = df.withColumns({"Distance_To_Swing_High": ratio(c - F.col("Last_Swing_High"), c), "Distance_To_Swing_Low": ratio(c - F.col("Last_Swing_Low"), c)})
    return df.drop("_top", "_low", "_prior_top", "_prior_low")


def trend_state(df: DataFrame) -> DataFrame:
    """Trend, breaks of structure and changes of character, as a closed form of the state machine.

    A row resets the state whatever it was if the close breaks the swing on the
    side of its signal, or if it is the first row with any signal; between resets
    the state stays.
    """
    c = F.col("close")
    yes = lambda x: F.coalesce(x, F.lit(False))
    df = df.withColumns(
        {
            "_up": (F.col("Higher_High") == 1) | (F.col("Higher_Low") == 1),
            "_dn": (F.col("Lower_High") == 1) | (F.col("Lower_Low") == 1),
            "_bu": yes(c > F.col("Last_Swing_High")),
            "_bd": yes(c < F.col("Last_Swing_Low")),
        }
    )
    up, dn, bu, bd = (F.col(x) for x in ("_up", "_dn", "_bu", "_bd"))
    df = df.withColumn("_seen", F.sum((up | dn).cast("int")).over(upto()))
    first = (up | dn) & (F.col("_seen") == 1)
    df = df.withColumn("_reset", F.when(dn & bd, -1).when(up & bu, 1).when(first, F.when(up, 1).otherwise(-1)))
    df = df.withColumn("Current_Trend", F.coalesce(carry(F.col("_reset")), F.lit(0)))
    df = df.withColumn("_prev", F.coalesce(lag("Current_Trend"), F.lit(0)))
    prev, trend = F.col("_prev"), F.col("Current_Trend")
    mid = F.when(up & ((prev >= 0) | bu), 1).otherwise(prev)
    df = df.withColumns(
        {
            "Break_Of_Structure": (((trend == 1) & bu) | ((trend == -1) & bd)).cast("int"),
            "Change_Of_Character": ((up & (prev < 0) & bu) | (dn & (mid > 0) & bd)).cast("int"),
        }
    )
    return df.drop("_up", "_dn", "_bu", "_bd", "_seen", "_reset", "_prev")


def near_zones(bars: DataFrame, zones: DataFrame) -> DataFrame:
    """Join each bar with the zones (symbol, ci, zlo, zhi) made up to MAX_AGE bars before it.

    An equi-join on the symbol and a bin of bar numbers; a zone lies in two bins at most.
    """
    b = bars.select("symbol", "i", "close", F.floor(F.col("i") / BIN).alias("bin"))
    first = F.floor(F.col("ci") / BIN)
    last = F.floor((F.col("ci") + MAX_AGE) / BIN)
    z = zones.withColumn("bin", F.explode(F.sequence(first, last)))
    return b.join(z, ["symbol", "bin"]).where(F.col("i").between(F.col("ci"), F.col("ci") + MAX_AGE)).drop("bin")


def order_blocks(df: DataFrame) -> DataFrame:
    """Order blocks: the last opposite bar before a strong move that breaks the swing.  Needs ATR_14 and swings."""
    df = numbered(df)
    c, o = F.col("close"), F.col("open")
    ref = F.coalesce(lag("close", 3), F.first("close").over(upto()))
    near = ordered().rowsBetween(-OB_LOOKBACK, -1)
    zone = F.struct(F.col("low").alias("zlo"), F.col("high").alias("zhi"))
    df = df.withColumns(
        {
            "_ref": ref,
            "_bear": F.last(F.when(c < o, zone), ignorenulls=True).over(near),
            "_bull": F.last(F.when(c > o, zone), ignorenulls=True).over(near),
        }
    )
    far = F.abs(c - F.col("_ref")) >= OB_ATR * F.coalesce(F.col("ATR_14"), F.lit(0.0))
    move = F.coalesce(ratio(c - F.col("_ref"), F.col("_ref")), F.lit(0.0))
    sides = {
        "Bullish": (far | (move >= OB_MOVE)) & (c > F.col("_ref")) & (c > F.col("Last_Swing_High")) & F.col("_bear").isNotNull(),
        "Bearish": (far | (move <= -OB_MOVE)) & (c < F.col("_ref")) & (c < F.col("Last_Swing_Low")) & F.col("_bull").isNotNull(),
    }
    # one table of zones for both sides, joined once
    made = F.array(*(F.struct(F.lit(k).alias("side"), F.coalesce(on, F.lit(False)).alias("on"), F.col(z)["zlo"].alias("zlo"), F.col(z)["zhi"].alias("zhi")) for k, (on, z) in enumerate(zip(sides.values(), ("_bear", "_bull"), strict=True))))
    zones = df.select("symbol", F.col("i").alias("ci"), F.explode(made).alias("z")).where("z.on").select("symbol", "ci", "z.side", "z.zlo", "z.zhi")
    j = near_zones(df, zones).withColumn("mid", (F.col("zlo") + F.col("zhi")) / 2)
    hits = Window.partitionBy("symbol", "ci", "side").orderBy("i")
    j = j.withColumn("retests", F.sum(F.col("close").between(F.col("zlo"), F.col("zhi")).cast("int")).over(hits))
    near = F.struct(F.abs(F.col("close") - F.col("mid")), F.col("ci"))
    pick = lambda k: F.min_by(F.struct("mid", "ci", "retests"), F.when(F.col("side") == k, near))
    got = j.groupBy("symbol", "i").agg(*(pick(k).alias(f"_{side}") for k, side in enumerate(sides)))
    got = got.withColumnsRenamed({"symbol": "_s", "i": "_i"})
    out = df.join(got, (df["symbol"] == got["_s"]) & (df["i"] == got["_i"]), "left")
    for side in sides:
        z = F.col(f"_{side}")
        out = out.withColumns(
            {
                f"{side}_OB_Exists": z["ci"].isNotNull().cast("int"),
                f"Distance_To_{side}_OB": ratio(F.col("close") - z["mid"], F.col("close")),
                f"{side}_OB_Age": F.col("i") - z["ci"],
                f"{side}_OB_Retest_Count": F.coalesce(z["retests"], F.lit(0)).cast("int"),
            }
        )
    return out.drop("i", "_ref", "_bear", "_bull", "_s", "_i", *(f"_{side}" for side in sides))


def fair_value_gaps(df: DataFrame) -> DataFrame:
    """Three-bar gaps: their distance while no close lies in them, and whether the newest one is filled on this bar."""
    df = numbered(df)
    h2, l2 = lag("high", 2), lag("low", 2)
    df = df.withColumns({"_h2": h2, "_l2": l2})
    yes = lambda x: F.coalesce(x, F.lit(False))
    df = df.withColumns({"Bullish_FVG": yes(F.col("low") > F.col("_h2")).cast("int"), "Bearish_FVG": yes(F.col("high") < F.col("_l2")).cast("int")})
    made = df.select(
        "symbol",
        F.col("i").alias("ci"),
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("side"), (F.col("Bullish_FVG") == 1).alias("on"), F.col("_h2").alias("zlo"), F.col("low").alias("zhi")),
                F.struct(F.lit(1).alias("side"), (F.col("Bearish_FVG") == 1).alias("on"), F.col("high").alias("zlo"), F.col("_l2").alias("zhi")),
            )
        ).alias("z"),
    ).where("z.on")
    zones = made.select("symbol", "ci", "z.side", "z.zlo", "z.zhi")
    j = near_zones(df, zones).withColumn("hit", F.col("close").between(F.col("zlo"), F.col("zhi")))
    one = Window.partitionBy("symbol", "ci", "side")
    j = j.withColumn("fi", F.min(F.when(F.col("hit"), F.col("i"))).over(one)).where("fi is null or i <= fi")
    j = j.withColumns({"filled": F.coalesce(F.col("i") == F.col("fi"), F.lit(False)), "mid": (F.col("zlo") + F.col("zhi")) / 2})
    near = F.struct(F.abs(F.col("close") - F.col("mid")), F.col("ci"))
    pick = lambda side, x: F.min_by(F.when(~F.col("filled") & (F.col("side") == side), x), F.when(~F.col("filled") & (F.col("side") == side), near))
    got = j.groupBy("symbol", "i").agg(
        pick(0, F.col("mid")).alias("bull"),
        pick(0, F.col("ci")).alias("bull_ci"),
        pick(1, F.col("mid")).alias("bear"),
        F.max_by("filled", F.struct(F.col("ci"), -F.col("side"))).alias("newest"),
    )
    got = got.select(F.col("symbol").alias("_s"), F.col("i").alias("_i"), "bull", "bull_ci", "bear", "newest")
    c = F.col("close")
    out = df.join(got, (df["symbol"] == got["_s"]) & (df["i"] == got["_i"]), "left").withColumns(
        {
            "Distance_To_Bullish_FVG": ratio(c - F.col("bull"), c),
            "Distance_To_Bearish_FVG": ratio(c - F.col("bear"), c),
            "FVG_Filled": F.coalesce(F.col("newest"), F.lit(False)).cast("int"),
            "FVG_Age": F.col("i") - F.col("bull_ci"),
        }
    )
    return out.drop("i", "_h2", "_l2", "_s", "_i", "bull", "bull_ci", "bear", "newest")


def liquidity(df: DataFrame, previous_week: bool = False) -> DataFrame:
    """Distances to the high and low of the last calendar day and of a past week.

    A day without bars gives null on the day after it.  By default Monday to
    Saturday look at the week before the last and Sunday at the last one;
    previous_week=True always looks at the last one.
    """
    day, week = F.date_trunc("day", "ts").cast("date"), F.date_trunc("week", "ts").cast("date")
    df = df.withColumns({"_day": day, "_week": week})
    back = F.lit(7) if previous_week else F.when(F.weekday("ts") == 6, 7).otherwise(14)
    days = df.groupBy("symbol", "_day").agg(F.max("high").alias("dh"), F.min("low").alias("dl")).select(F.col("symbol").alias("s1"), F.date_add("_day", 1).alias("d1"), "dh", "dl")
    weeks = df.groupBy("symbol", "_week").agg(F.max("high").alias("wh"), F.min("low").alias("wl")).select(F.col("symbol").alias("s2"), F.col("_week").alias("w2"), "wh", "wl")
    out = df.withColumn("_back", F.date_sub(F.col("_week"), back))
    out = out.join(days, (out["symbol"] == days["s1"]) & (out["_day"] == days["d1"]), "left")
    out = out.join(weeks, (out["symbol"] == weeks["s2"]) & (out["_back"] == weeks["w2"]), "left")
    c = F.col("close")
    names = {"Day_High": "dh", "Day_Low": "dl", "Week_High": "wh", "Week_Low": "wl"}
    out = out.withColumns({f"Distance_To_Prev_{k}": ratio(c - F.col(x), c) for k, x in names.items()})
    return out.drop("_day", "_week", "_back", "s1", "d1", "dh", "dl", "s2", "w2", "wh", "wl")


#: the columns of the context symbol that other symbols get, with its prefix
CONTEXT = {"Close": "close", "Return_1h": "Return_1h", "RSI_14": "RSI_14", "ATR_14": "ATR_14", "BB_Width": "BB_Width", "Trend": "Current_Trend", "Volume_Change": "Volume_Change_Pct", "Volatility_24": "Historical_Volatility"}


def market_context(df: DataFrame, symbol: str = "BTC", prefix: str = "BTC") -> DataFrame:
    """Give every other symbol the context symbol's columns at the same time; null where it has none."""
    ctx = df.where(F.col("symbol") == symbol).select(F.col("ts").alias("_t"), *(F.col(x).alias(f"{prefix}_{k}") for k, x in CONTEXT.items()))
    return df.join(ctx, (df["ts"] == ctx["_t"]) & (df["symbol"] != symbol), "left").drop("_t")
