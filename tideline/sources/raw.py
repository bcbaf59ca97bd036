"""Raw daily archives: zipped CSV files of quotes and trades, read as typed columns.

Paths are listed on the driver, archives are opened where a task reads them, and rows leave as Arrow batches of bounded
size; types are then cast by Spark. Values that do not parse become null; an archive without a CSV member,
or whose header lacks a required column, is an error.
"""

from __future__ import annotations

import csv
import io
import itertools
import zipfile
from collections.abc import Callable, Iterator
from datetime import date

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.scalar import dates_between, parse_bool
from tideline.sources.names import stem
from tideline.sources.sinks import write_table

#: File columns in order, for archives without a header line.
QUOTE_COLUMNS = ("update_id", "bid_price", "bid_size", "ask_price", "ask_size", "transaction_time", "event_time")
TRADE_COLUMNS = ("agg_trade_id", "price", "quantity", "first_trade_id", "last_trade_id", "trade_time", "buyer_is_maker")
#: Other names that the header of a quote file may use.
QUOTE_ALIASES = {
    "best_bid_price": "bid_price",
    "best_bid_qty": "bid_size",
    "best_ask_price": "ask_price",
    "best_ask_qty": "ask_size",
}
#: Other names that the header of a trade file may use.
TRADE_ALIASES = {
    "transact_time": "trade_time",
    "is_buyer_maker": "buyer_is_maker",
    "Aggregate tradeId": "agg_trade_id",
    "Price": "price",
    "Quantity": "quantity",
    "First tradeId": "first_trade_id",
    "Last tradeId": "last_trade_id",
    "Timestamp": "trade_time",
    "Transact time": "trade_time",
    "Transact Time": "trade_time",
    "Was the buyer the maker": "buyer_is_maker",
}
BATCH_ROWS = 50_000


def archive_name(symbol: str, kind: str, day: date) -> str:
    return f"{symbol}-{kind}-{day.isoformat()}.zip"


def archive_url(base: str, symbol: str, kind: str, day: date) -> str:
    return f"{base.rstrip('/')}/{kind}/{symbol}/{archive_name(symbol, kind, day)}"


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def fetch_days(spark: SparkSession, fetch: Callable[[str], bytes | None], base: str, folder: str, symbol: str, kind: str, start: str | date, end: str | date) -> dict[date, bool]:
    """Bring a range of daily archives into ``folder``; ``fetch`` gives a URL's bytes, or None where there is none.

    A file that exists and is not empty is kept. A new one is written beside its place, then renamed. A day that could
    not be had is False in the result; errors of the store are raised.
    """
    got = {}
    for day in dates_between(start, end):
        name = archive_name(symbol, kind, day)
        fs, target = _path(spark, f"{folder}/{name}")
        if fs.exists(target) and fs.getFileStatus(target).getLen() > 0:
            got[day] = True
            continue
        try:
            content = fetch(archive_url(base, symbol, kind, day))
        except OSError:
            content = None
        if content:
            _, part = _path(spark, f"{folder}/.{name}.part")
            out = fs.create(part, True)
            out.write(bytearray(content))
            out.close()
            fs.delete(target, False)
            got[day] = bool(fs.rename(part, target))
        else:
            got[day] = False
    return got


def complete_range(spark: SparkSession, folder: str, symbol: str, kind: str, start: str | date, end: str | date) -> list[str]:
    """Paths of all days of a range; a missing day is an error that names it."""
    paths = [(d, f"{folder}/{archive_name(symbol, kind, d)}") for d in dates_between(start, end)]
    missing = [d.isoformat() for d, p in paths if not (lambda f: f[0].exists(f[1]))(_path(spark, p))]
    if missing:
        raise FileNotFoundError(f"no {kind} archive of {symbol} for {', '.join(missing)}")
    return [p for _, p in paths]


def has_header(first: list[str]) -> bool:
    """A first line whose first field is no integer is a header."""
    try:
        int(first[0].lstrip("﻿").strip().strip('"'))
    except (ValueError, IndexError):
        return True
    return False


def _unzip(columns: tuple[str, ...], aliases: dict[str, str]):
    names = ["source_file", "raw_row_number", *columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                with zipfile.ZipFile(io.BytesIO(content.as_buffer())) as z:
                    members = [m for m in z.namelist() if m.lower().endswith(".csv")]
                    if not members:
                        raise ValueError(f"{path} holds no CSV file")
                    with z.open(members[0]) as raw:
                        lines = csv.reader(io.TextIOWrapper(raw, "utf-8-sig"))
                        first = next(lines, None)
                        if first is None:
                            continue
                        order = list(columns)
                        if has_header(first):
                            order = [aliases.get(n := c.strip().lstrip("\ufeff"), n) for c in first]
                            if missing := sorted(set(columns) - set(order)):
                                raise ValueError(f"{path} has no columns {missing}")
                        else:
                            lines = itertools.chain([first], lines)
                        at = [order.index(c) if c in order else None for c in columns]
                        number = 0
                        while rows := list(itertools.islice(lines, BATCH_ROWS)):
                            cells = [[r[i] if i is not None and i < len(r) else None for r in rows] for i in at]
                            arrays = [pa.array([path.rsplit("/", 1)[-1]] * len(rows), pa.string()), pa.array(range(number, number + len(rows)), pa.int64()), *[pa.array(c, pa.string()) for c in cells]]
                            number += len(rows)
                            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def _scan(spark: SparkSession, paths: list[str], columns: tuple[str, ...], aliases: dict[str, str]) -> DataFrame:
    if not paths:
        raise ValueError("no archives to read")
    # a scan task is dealt at most spark.sql.files.maxPartitionBytes, or one larger archive
    schema = "source_file string, raw_row_number long, " + ", ".join(f"`{c}` string" for c in columns)
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInArrow(_unzip(columns, aliases), schema)


def _number(name: str, kind: str) -> Column:
    return F.expr(f"try_cast(trim(`{name}`) AS {kind})")


def scan_quotes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """us, update_id, prices and sizes, source_file, raw_row_number of zipped quote files."""
    q = _scan(spark, paths, QUOTE_COLUMNS, QUOTE_ALIASES)
    return q.select(
        (_number("event_time", "bigint") * 1000).alias("us"), _number("update_id", "bigint").alias("update_id"), _number("bid_price", "double").alias("bid_price"),
        _number("ask_price", "double").alias("ask_price"), _number("bid_size", "double").alias("bid_size"), _number("ask_size", "double").alias("ask_size"), "source_file", "raw_row_number",
    )


def scan_trades(spark: SparkSession, paths: list[str]) -> DataFrame:
    """us, trade_id, price, quantity, buyer_is_maker (null unless true/false/1/0), source_file, raw_row_number of zipped trade files."""
    t = _scan(spark, paths, TRADE_COLUMNS, TRADE_ALIASES)
    return t.select(
        (_number("trade_time", "bigint") * 1000).alias("us"), _number("agg_trade_id", "bigint").alias("trade_id"), _number("price", "double").alias("price"),
        _number("quantity", "double").alias("quantity"), parse_bool(F.col("buyer_is_maker")).alias("buyer_is_maker"), "source_file", "raw_row_number",
    )


def in_days(rows: DataFrame, start: date, end: date) -> DataFrame:
    """Rows whose UTC day is within the range, both ends in."""
    edge = lambda d: (d - date(1970, 1, 1)).days * 86_400_000_000
    return rows.where((F.col("us") >= edge(start)) & (F.col("us") < edge(end) + 86_400_000_000))


def build_raw(spark: SparkSession, fetch: Callable[[str], bytes | None], base: str, folder: str, target: str, symbol: str, start: str | date, end: str | date, kinds: tuple[str, str] = ("bookTicker", "aggTrades"), overwrite: bool = False) -> tuple[DataFrame, DataFrame]:
    """Fetch the archives of both feeds, read the days of the range, and write both as tables under ``target``; (quotes, trades)."""
    days = dates_between(start, end)
    for kind in kinds:
        fetch_days(spark, fetch, base, folder, symbol, kind, start, end)
    out = []
    for kind, name, scan in zip(kinds, ("quotes", "trades"), (scan_quotes, scan_trades), strict=True):
        path = f"{target}/{stem(f'raw_{name}', symbol, days[0], days[-1])}"
        write_table(in_days(scan(spark, complete_range(spark, folder, symbol, kind, start, end)), days[0], days[-1]), path, overwrite)
        out.append(spark.read.parquet(path))
    return out[0], out[1]
