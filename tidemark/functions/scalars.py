"""Scalar column functions: times, percents and labels."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Translations of labels.
PATTERNS = {
    "hammer": "martelo",
    "bullish_engulfing": "engolfo de alta",
    "piercing_line": "linha de perfuração",
    "morning_star": "estrela da manhã",
    "dragonfly_doji": "doji libélula",
}
TIMEFRAMES = {"1h": "1 hora", "24h": "24 horas", "7d": "7 dias", "30d": "30 dias", "180d": "6 meses"}
REGIMES = {"risk_on": "Mercado favorável (risk-on)", "risk_off": "Mercado adverso (risk-off)"}
SEVERITIES = {"very_strong": "Críticos", "strong": "Fortes", "normal": "Normais"}
#: Quotes that a pair may end with, in the order they are tried.
QUOTES = ("USDT", "BUSD", "USDC", "FDUSD", "TUSD", "EUR", "TRY", "BRL", "BTC", "ETH", "BNB")


def label(key: Column, labels: dict[str, str], default: Column | None = None) -> Column:
    """The label of a key, else the default (null if none is given)."""
    table = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in labels.items()))
    found = F.try_element_at(table, key)
    return found if default is None else F.coalesce(found, default)


def friendly_name(symbol: Column) -> Column:
    """The pair without a USDT at its end, if something is left."""
    return F.when(symbol.endswith("USDT") & (F.length(symbol) > 4), F.regexp_replace(symbol, "USDT$", "")).otherwise(symbol)


def split_symbol(symbol: Column) -> Column:
    """(base, quote): the first known quote that leaves a base, else three letters of base."""
    parts = lambda n: F.struct(F.substring(symbol, F.lit(1), F.length(symbol) - n).alias("base"), F.right(symbol, F.lit(n)).alias("quote"))
    chain_ = None
    for q in QUOTES:
        fits = symbol.endswith(q) & (F.length(symbol) > len(q))
        chain_ = F.when(fits, parts(len(q))) if chain_ is None else chain_.when(fits, parts(len(q)))
    rest = F.struct(F.substring(symbol, 1, 3).alias("base"), F.substring(symbol, F.lit(4), F.length(symbol)).alias("quote"))
    return chain_.otherwise(rest)


def pct_change(base: Column, later: Column) -> Column:
    """Percent from base to later; null if either is or base is zero."""
    return F.try_divide(later - base, base) * 100


def positive_drop(reference: Column, price: Column) -> Column:
    """How many percent the price is under a reference; 0 if above or the reference isn't positive."""
    drop = F.when(reference > 0, F.greatest(F.try_divide(reference - price, reference) * 100, F.lit(0.0))).otherwise(0.0)
    return F.when(reference.isNotNull() & price.isNotNull(), drop)


def minutes_between(a: Column, b: Column) -> Column:
    return F.abs(F.timestamp_diff("MICROSECOND", a, b)) / 60e6


def utc_iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def from_utc_iso(text: Column) -> Column:
    return F.to_timestamp_ntz(text, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))


def millis_to_second(ms: Column) -> Column:
    """Epoch milliseconds to an NTZ time in UTC, cut to the second."""
    return F.timestamp_add("SECOND", F.floor(ms / 1000), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def second_to_millis(ts: Column) -> Column:
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts) * 1000


def floor_hour(ts: Column) -> Column:
    return F.date_trunc("hour", ts).cast("timestamp_ntz")


def floor_day(ts: Column) -> Column:
    return F.date_trunc("day", ts).cast("timestamp_ntz")


def day_month(ts: Column) -> Column:
    return F.date_format(ts, "dd/MM")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _rounded(size: Column, scale: Column) -> Column:
    """size * scale (a power of ten up to 1e9) to the nearest whole number, by the exact value of the double; ties to even.

    The product is split into a double and its exact error, which decides what
    looks like a tie.
    """
    big = size * 134217729.0
    split = F.struct((big - (big - size)).alias("high"), size.alias("v"), scale.alias("c"), (size * scale).alias("p"))

    def nearest(s: Column) -> Column:
        whole = F.floor(s["p"]).cast("double")
        error = (s["high"] * s["c"] - s["p"]) + (s["v"] - s["high"]) * s["c"]
        part = s["p"] - whole
        up = (part > 0.5) | ((part == 0.5) & ((error > 0) | ((error == 0) & (whole % 2 == 1))))
        return F.when(up, whole + 1).otherwise(whole)

    return _let(split, nearest)


def fixed(value: Column, digits: int) -> Column:
    """Text with so many decimals, rounded by the exact binary value; null stays null."""

    def text(v: Column) -> Column:
        n = _rounded(F.abs(v), F.lit(10.0**digits)).cast("decimal(28,0)")
        return F.concat(F.when(v < 0, "-").otherwise(""), (n * F.lit(Decimal(1).scaleb(-digits))).cast(f"decimal(38,{digits})").cast("string"))

    return _let(value, text)


def general(value: Column) -> Column:
    """Text with six significant digits: no trailing zeros, an exponent under 1e-4 and from 1e6 on."""
    powers = F.array(*[F.lit(10.0**k) for k in range(10)])
    units = F.array(*[F.lit(Decimal(1).scaleb(-k)).cast("decimal(10,9)") for k in range(10)])

    def parts(v: Column) -> Column:
        return F.struct(v.alias("v"), F.abs(v).alias("size"), F.format_string("%.16e", F.abs(v)).alias("long"), F.format_string("%.5e", F.abs(v)).alias("short"))

    def placed(s: Column) -> Column:
        exponent = F.regexp_extract(s["long"], r"e([+-]\d+)$", 1).try_cast("int")
        place = F.when(exponent.between(-4, 5), 5 - exponent).otherwise(0)
        n = _rounded(s["size"], F.get(powers, place)).cast("decimal(20,0)")
        return F.struct(s["v"].alias("v"), s["long"].alias("long"), s["short"].alias("short"), exponent.alias("e"), place.alias("place"), n.alias("n"))

    def text(s: Column) -> Column:
        over = (s["e"] == 5) & (s["n"] >= 1000000)
        plain = F.regexp_replace((s["n"] * F.get(units, s["place"])).cast("decimal(38,9)").cast("string"), r"\.?0+$", "")
        even = s["long"].rlike(r"^\d\.\d{4}[02468]50+e")  # a tie, which goes to the even digit
        cut = F.concat(F.regexp_extract(s["long"], r"^(\d\.\d{5})", 1), F.regexp_extract(s["long"], "(e.*)$", 1))
        far = F.regexp_replace(F.when(even, cut).otherwise(s["short"]), r"\.?0*e", "e")
        far = F.when(over, "1e+06").when(far == "1e-04", "0.0001").otherwise(far)  # rounded up from below
        body = F.when(s["v"] == 0, "0").when(s["e"].between(-4, 5) & ~over, plain).otherwise(far)
        body = F.when(F.abs(s["v"]) == float("inf"), "inf").otherwise(body)
        return F.when(F.isnan(s["v"]), "nan").otherwise(F.concat(F.when(s["v"] < 0, "-").otherwise(""), body))

    return F.when(value.isNotNull(), _let(_let(_let(value, parts), placed), text))


def plain(value: Column) -> Column:
    """Text of a double with all its digits, or of any other value; a missing one is None."""

    def text(v: Column) -> Column:
        said = v.cast("string")
        mantissa, exponent = F.regexp_extract(said, r"^(-?[\d.]+)E", 1), F.regexp_extract(said, r"E(-?\d+)$", 1).try_cast("int")
        small = F.regexp_replace(v.try_cast("decimal(38,20)").cast("string"), r"(\.\d*?)0+$", "$1")
        small = F.when(small.endswith("."), F.concat(small, F.lit("0"))).otherwise(small)
        sign = F.when(exponent < 0, "-").otherwise("+")
        far = F.concat(F.regexp_replace(mantissa, r"\.0$", ""), F.lit("e"), sign, F.lpad(F.abs(exponent).cast("string"), 2, "0"))
        return F.when(~said.contains("E"), said).when(exponent.between(-4, 15), small).otherwise(F.when(mantissa == "", said).otherwise(far))

    return F.coalesce(_let(value, text), F.lit("None"))


def signed_pct(value: Column, digits: int = 2) -> Column:
    """+1.24%, -0.50% or 0.00%; null stays null."""
    return F.concat(F.when(value > 0, "+").otherwise(""), fixed(value, digits), F.lit("%"))


def matured(anchor: Column, now: Column, days: int = 30) -> Column:
    return now >= F.timestamp_add("DAY", F.lit(days), anchor)


def quiet_hours(ts: Column, timezone: str, start: int, end: int) -> Column:
    """Whether a UTC time is in the local quiet hours; they may run over midnight."""
    if start == end:
        return F.lit(False)
    hour = F.hour(F.convert_timezone(F.lit("UTC"), F.lit(timezone), ts))
    return (hour >= start) & (hour < end) if start < end else (hour >= start) | (hour < end)
