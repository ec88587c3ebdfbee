import datetime as dt

from candlework.sinks import text
from candlework.sources import files
from candlework.streaming.bars import event_bars


def record(symbol, market, expiry="", day="20260302"):
    line = [" "] * 245
    put = lambda at, x: line.__setitem__(slice(at, at + len(x)), list(x))
    put(0, "01" + day)
    put(12, symbol)
    put(24, market)
    for at, price in ((56, 1000), (69, 1100), (82, 900), (108, 1050), (188, 9800)):
        put(at, f"{price:013d}")
    put(147, "00007")
    put(202, expiry)
    return "".join(line)


def test_fixed_width(spark, tmp_path):
    (tmp_path / "f.txt").write_text("\n".join(["00HEADER", record("AAAA3", "010"), record("ZZZZ3", "010"), record("AAAAC98", "070", "20260317"), record("AAAAP98", "080"), "99TRAILER"]), encoding="latin-1")
    (tmp_path / "u.md").write_text("# list\n\n- AAAA3 | name\n`bbbb4`\n".replace("`", ""))
    universe = files.universe_list(spark, str(tmp_path / "u.md"))
    assert sorted(r.ticker for r in universe.collect()) == ["AAAA3", "BBBB4"]
    rows = files.records(spark, str(tmp_path / "f.txt"))
    bar = files.spot(rows, universe).collect()
    assert len(bar) == 1 and (bar[0].ticker, bar[0].close, bar[0].volume, bar[0].trade_count) == ("AAAA3", 10.5, 0, 7)
    chain = files.options(rows, universe).collect()
    assert len(chain) == 1 and (chain[0].option_side, chain[0].strike_price, chain[0].expiration_date) == ("call", 98.0, dt.date(2026, 3, 17))


def test_sinks_and_event_bars(spark):
    df = spark.createDataFrame([("a", 1.23456), ("b", float("inf")), ("c", None)], "k string, v double")
    assert [r.v for r in text.formatted(df).orderBy("k").collect()] == ["1.2346", "INF", ""]
    assert '"v":9999.0' in text.payload(df.where("k = 'b'")).first().value
    events = spark.createDataFrame([(1, dt.datetime(2026, 1, 1, 1), "buy", 3.0), (2, dt.datetime(2026, 1, 1, 2), "buy", 1.0)], "event_id long, ts timestamp, event_type string, value double")
    got = event_bars(events).first()
    assert (got.open, got.high, got.low, got.close, got.trade_count) == (3.0, 3.0, 1.0, 1.0, 2)
