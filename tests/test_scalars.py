"""Golden values of scalar rules, prices, plans and layouts."""

import pytest
from pyspark.sql import functions as F

from chronoloom.functions import scalars as S
from chronoloom.functions import tokens as P
from chronoloom.operators import budget, findings


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_times_are_parsed(spark):
    said = ["45", "1:30", "1:02:03", "0:01.5", "-1:30", "", None, " 7 "]
    got = values(spark, [(s,) for s in said], "s string", S.parse_time(F.col("s")))
    assert [g[0] for g in got] == [45, 90, 3723, 1.5, -90, None, None, 7]


@pytest.mark.parametrize("bad", ["x", "1:2:3:4", "1:x"])
def test_odd_times_raise(spark, bad):
    with pytest.raises(Exception, match="not a time"):
        values(spark, [(bad,)], "s string", S.parse_time(F.col("s")))


def test_times_are_shown(spark):
    rows = [(90.0,), (3723.0,), (1.5,), (1.9995,), (59.9996,), (-3.0,)]
    got = values(spark, rows, "t double", S.format_time(F.col("t")), S.format_time(F.col("t"), millis=True), S.format_duration(F.col("t")))
    assert [g[0] for g in got] == ["01:30", "1:02:03", "00:01", "00:01", "00:59", "00:00"]
    assert [g[1] for g in got] == ["01:30.000", "1:02:03.000", "00:01.500", "00:02.000", "01:00.000", "00:00.000"]
    assert [g[2] for g in got][:3] == ["01:30", "1:02:03", "1.5s"]


def test_prices(spark):
    golden = {
        (512, 288): {"anthropic": 209, "openai:4o": 255, "openai:5": 144, "gemini": 258, "qwen": 144, "qwen:video": 72},
        (1024, 576): {"anthropic": 777, "openai:4o": 765, "openai:5": 576, "gemini": 516, "qwen": 576, "qwen:video": 288},
        (384, 384): {"gemini": 258},
        (800, 400): {"gemini": 516},
        (8000, 8000): {"openai:5-high": 2500},
    }
    for (w, h), prices in golden.items():
        got = values(spark, [(w, h)], "w int, h int", *[P.tokens(F.col("w"), F.col("h"), f) for f in prices])[0]
        assert dict(zip(prices, got, strict=True)) == prices


def test_the_generic_price_is_the_highest(spark):
    sizes = [(w, h) for w in (2, 96, 512, 769, 2049) for h in (2, 288, 900, 4000)]
    for row in values(spark, sizes, "w int, h int", P.tokens(F.col("w"), F.col("h"), "generic"), *[P.tokens(F.col("w"), F.col("h"), f) for f in P.EDGES]):
        assert row[0] == max(row[1:])
    assert P.edge("generic") == 1536


def test_unknown_families_raise(spark):
    with pytest.raises(ValueError):
        P.tokens(F.lit(1), F.lit(1), "nobody")
    with pytest.raises(Exception, match="no such family"):
        P.resolve(spark.createDataFrame([("nobody",)], "request string")).collect()


def test_sampling_plans(spark):
    table = {5: (12, 18), 15: (17, 30), 30: (40, 60), 60: (60, 100), 120: (70, 100), 180: (80, 100), 600: (100, 100), 1800: (100, 100)}
    got = values(spark, [(float(d),) for d in table], "d double", S.sample_target(F.col("d"), False), S.sample_target(F.col("d"), True))
    assert got == list(table.values())
    assert values(spark, [(30.0,), (300.0,), (0.0,)], "d double", S.plan_target(F.col("d"), False, F.lit(1.0))) == [(30,), (300,), (1,)]


def test_long_edges(spark):
    got = values(spark, [(512, 288, 1568), (1536, 2731, 1568), (100, 50, None)], "w int, h int, e int", S.fit_edge(F.col("w"), F.col("w"), F.col("h"), F.col("e")), S.fit_edge(F.col("h"), F.col("w"), F.col("h"), F.col("e")))
    assert got[0] == (512, 288) and got[2] == (100, 50)
    assert max(got[1]) <= 1568 and got[1][0] % 2 == got[1][1] % 2 == 0 and abs(got[1][0] / got[1][1] - 1536 / 2731) < 0.01


def test_windows(spark):
    rows = [(None, None, 100.0), (99.99, None, 100.0), (5.0, 300.0, 100.0), (5.0, None, None)]
    got = values(spark, rows, "s double, e double, d double", S.window_start(F.col("s"), F.col("d")), S.window_end(F.col("s"), F.col("e"), F.col("d")))
    assert got == [(0.0, 100.0), (99.9, 100.0), (5.0, 100.0), (5.0, 65.0)]


def test_layouts_are_readable_and_wide_ones_larger(spark):
    rows = budget.sheet_layout(spark.createDataFrame([(1920, 1080), (1080, 1920), (1000, 1000)], "width int, height int")).collect()
    for r in rows:
        high = max(1, round(540 * r.height / r.width))
        assert 540 * min(1.0, 1568 / max(544 * r.cols, (high + 4) * r.rows)) >= 380
    assert rows[0].cols * rows[0].rows > rows[1].cols * rows[1].rows


def test_read_sizes(spark):
    rows = [(1, 1920, 1080, 20, None), (2, 1920, 1080, 80, None), (3, 1080, 1920, 500, None), (4, 1920, 1080, 900, 1000)]
    got = {r.k: (r.read_width, r.mode) for r in budget.read_size(spark.createDataFrame(rows, "k int, width int, height int, frames int, requested_width int"), "anthropic").collect()}
    assert got[1] == (512, "default") and got[3] == (384, "managed-floor") and got[4] == (1000, "explicit") and got[2][0] == 512


def test_scan_shrinks_tiles_and_refuses(spark):
    rows = budget.scan_plan(spark.createDataFrame([(1920, 1080), (1080, 1920), (100, 4000)], "width int, height int")).collect()
    assert all(r.fits == (r.sheet_tokens <= 3000) and (r.tiles is None) != r.fits for r in rows) and not rows[2].fits


def test_reading_load_counts_han_and_words(spark):
    row = findings.reading_load(spark.createDataFrame([("买买 now free", 2.0)], "text string, seconds double")).collect()[0]
    assert (row.units, row.load) == (4, 2.0)
