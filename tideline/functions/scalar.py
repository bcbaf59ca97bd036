"""Scalar column functions; all stay inside whole-stage code generation."""

from __future__ import annotations

import math
from datetime import date, datetime, timedelta
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def micros(ts: str | Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone is."""
    c = F.col(ts) if isinstance(ts, str) else ts
    seconds = (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")
    return F.unix_date(c.cast("date")).cast("long") * DAY_US + F.hour(c).cast("long") * 3_600_000_000 + F.minute(c).cast("long") * 60_000_000 + seconds


def utc_day(us: str | Column) -> Column:
    """The UTC date of a number of microseconds."""
    c = F.col(us) if isinstance(us, str) else us
    return F.date_from_unix_date(F.floor(c / F.lit(DAY_US)).cast("int"))


def is_finite(c: Column) -> Column:
    """False for null, NaN and infinities."""
    d = c.cast("double")
    return F.coalesce(~F.isnan(d) & (F.abs(d) != F.lit(float("inf"))), F.lit(False))


def all_finite(*names: str) -> Column:
    return reduce(lambda x, y: x & y, [is_finite(F.col(n)) for n in names])


def safe_ratio(num: Column, den: Column, empty: float | None = 0.0) -> Column:
    """num / den in double; ``empty`` where the denominator is 0."""
    return F.when(den != 0, num.cast("double") / den.cast("double")).otherwise(F.lit(empty).cast("double"))


def midprice(bid: Column, ask: Column) -> Column:
    return (bid.cast("double") + ask.cast("double")) * 0.5


def relative_spread(bid: Column, ask: Column) -> Column:
    return (ask.cast("double") - bid.cast("double")) / midprice(bid, ask)


def relative_spread_f32(bid: Column, ask: Column, mid: Column) -> Column:
    """The feature: the difference is rounded to float, then the quotient is."""
    return ((ask.cast("double") - bid.cast("double")).cast("float").cast("double") / mid.cast("double")).cast("float")


def queue_imbalance(bid_size: Column, ask_size: Column) -> Column:
    num, den = (bid_size.cast("double") - ask_size.cast("double")).cast("float"), (bid_size.cast("double") + ask_size.cast("double")).cast("float")
    return (num.cast("double") / den.cast("double")).cast("float")


def signed_imbalance(signed: Column, total: Column) -> Column:
    """signed / total cut to [-1, 1]; 0 where there is nothing."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), safe_ratio(F.coalesce(signed, F.lit(0)), F.coalesce(total, F.lit(0))))).cast("float")


def maker_sign(buyer_is_maker: Column) -> Column:
    """-1 if the buyer is the maker (the seller was the aggressor), else 1."""
    return F.when(buyer_is_maker, -1).otherwise(1)


def is_close(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def argmax_label(probabilities: list[Column], labels: tuple[int, ...] = (-1, 0, 1)) -> Column:
    """The label of the greatest probability; the first of them on ties."""
    top = F.greatest(*probabilities)
    out = F.when(probabilities[0] == top, labels[0])
    for p, label in zip(probabilities[1:-1], labels[1:-1], strict=True):
        out = out.when(p == top, label)
    return out.otherwise(labels[-1]).cast("int")


def threshold_label(p_down: Column, p_up: Column, t_down: Column | float, t_up: Column | float) -> Column:
    """1 if the up probability reaches its threshold and is not below the other, -1 likewise, else 0."""
    t_down, t_up = (x if isinstance(x, Column) else F.lit(x) for x in (t_down, t_up))
    return F.when((p_up >= t_up) & (p_up >= p_down), 1).when((p_down >= t_down) & (p_down > p_up), -1).otherwise(0)


def parse_bool(c: Column) -> Column:
    """true/1 and false/0 in any case and with blanks around; null for all else."""
    s = F.lower(F.trim(c.cast("string")))
    return F.when(s.isin("true", "1"), True).when(s.isin("false", "0"), False)


#: The date formats that are accepted, in this order.
DATE_FORMATS = ("%Y-%m-%d", "%Y/%m/%d", "%d-%m-%Y", "%d/%m/%Y", "%Y%m%d")


def parse_date(value: str | date | datetime) -> date:
    """A date from text in one of ``DATE_FORMATS``; with slashes or dashes the day comes before the month, never after."""
    if isinstance(value, datetime):
        return value.date()
    if isinstance(value, date):
        return value
    if not isinstance(value, str):
        raise TypeError(f"a date, or text of one, is needed, not {type(value).__name__}")
    for form in DATE_FORMATS:
        try:
            return datetime.strptime(value.strip(), form).date()
        except ValueError:
            continue
    raise ValueError(f"not a date: {value!r}; use one of {', '.join(DATE_FORMATS)}")


def dates_between(start: str | date, end: str | date) -> list[date]:
    """All days from start to end, both included."""
    a, b = parse_date(start), parse_date(end)
    if b < a:
        raise ValueError(f"end {b} is before start {a}")
    return [a + timedelta(days=i) for i in range((b - a).days + 1)]


def window_us(start: str | date, end: str | date) -> tuple[int, int]:
    """Microseconds of the first midnight and, since the end's day is included, of the midnight after it."""
    days = dates_between(start, end)
    return tuple((d - date(1970, 1, 1)).days * DAY_US for d in (days[0], days[-1] + timedelta(days=1)))


def parse_horizons(text: str) -> tuple[int, ...]:
    """'10,20,50' as sorted unique positive numbers."""
    out = tuple(int(x) for x in text.split(",") if x.strip())
    if not out or any(h <= 0 for h in out) or len(set(out)) != len(out):
        raise ValueError(f"horizons must be unique and positive: {text!r}")
    return tuple(sorted(out))


def parse_splits(text: str, known: tuple[str, ...]) -> tuple[str, ...]:
    """'train,test' as unique known names, in the order given."""
    out = tuple(x.strip() for x in text.split(",") if x.strip())
    if not out or len(set(out)) != len(out) or not set(out) <= set(known):
        raise ValueError(f"splits must be unique and among {known}: {text!r}")
    return out


def json_ready(value):
    """Non-finite numbers become None, tuples lists, dates text; for JSON side files."""
    if isinstance(value, float) and not math.isfinite(value):
        return None
    if isinstance(value, dict):
        return {str(k): json_ready(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [json_ready(v) for v in value]
    if isinstance(value, (date, datetime)):
        return value.isoformat()
    return value
