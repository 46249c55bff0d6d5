import pytest
from pyspark.sql import functions as F

from babelshelf.functions import duration, means, names, numeric
from babelshelf.operators import options


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("kind", "values", "want"),
    [("truncated", [0.1, 0.2, 0.3, 0.8], 0.35), ("truncated", [0, 0.2, 0.3, 0.4, 1], 0.3), ("truncated", list(range(10)), 4.5), ("geometric", [1, 4], 2), ("harmonic", [1, 4], 1.6), ("harmonic", [0, 4], None), ("geometric", [0, 4], 0), ("truncated", [], None), ("arithmetic", [], None), ("harmonic", [], None)],
)
def test_means(spark, kind, values, want):
    rows = spark.createDataFrame([(float(v),) for v in values], "x double")
    got = rows.agg(means.MEANS[kind](F.col("x")).alias("m")).first().m
    assert got is None if want is None else abs(got - want) < 1e-12


@pytest.mark.parametrize(
    ("seconds", "spec", "want"),
    [("60.102455", "d", "0:01:00"), ("60.102455", "0", "0:01:00"), ("60.102455", "1", "0:01:00.1"), ("60.102455", "2", "0:01:00.10"), ("60.102455", "3", "0:01:00.102"), ("60.102455", "4", "0:01:00.1025"), ("60.102455", "5", "0:01:00.10246"), ("60", "0n", "0:01:00"), ("60", "1n", "0:01:00"), ("60", "5n", "0:01:00"), ("0.999999", "2", "0:00:01.00")],
)
def test_duration_format(spark, seconds, spec, want):
    assert one(spark, duration.formatted(duration.from_seconds(F.lit(seconds).cast("decimal(18,6)")), spec)) == want


@pytest.mark.parametrize("spec", ["dn", "h", "7", "12", "-1"])
def test_duration_format_errors(spark, spec):
    with pytest.raises(ValueError):
        duration.formatted(duration.from_seconds(F.lit(1)), spec)


@pytest.mark.parametrize(("seconds", "want"), [("0", "0:00:00"), ("86400", "1 day, 0:00:00"), ("200000.5", "2 days, 7:33:20.500000"), ("-1", "-1 day, 23:59:59")])
def test_duration_text(spark, seconds, want):
    assert one(spark, duration.text(duration.from_seconds(F.lit(seconds).cast("decimal(18,6)")))) == want


def test_language_and_names(spark):
    assert tuple(one(spark, names.language(F.lit("de: German")))) == ("de", "German")
    assert one(spark, names.language(F.lit("a:b:c"))) is None
    assert tuple(one(spark, names.series(F.lit("Foo (2001) (2005)")))) == ("Foo (2001)", 2005)
    assert one(spark, names.season(F.lit("Staffel 123"), [])) == 12
    assert one(spark, names.suffix(F.lit(".hidden"))) is None and one(spark, names.stem(F.lit("a.b.mkv"))) == "a.b"
    assert one(spark, names.is_ignored(F.lit("x.MP4"), F.lit("file"), ["mp4"], [])) is True


def test_percent(spark):
    assert one(spark, numeric.parse_percent(F.lit("12.5%"))) == 0.125 and abs(one(spark, numeric.parse_percent(F.lit("12.5%"), legacy=True)) - 0.1205) < 1e-12


@pytest.mark.parametrize(("text", "want"), [("Infinity", float("inf")), ("-inf", float("-inf")), ("1e10", 1e10), ("1d", None), (" 5 ", 5.0)])
def test_float(spark, text, want):
    assert one(spark, numeric.parse_float(F.lit(text))) == want


def test_quadratic_inverse(spark):
    assert one(spark, numeric.quadratic_seconds(F.lit(17.0), F.lit(1.0), F.lit(0.0), F.lit(1.0))) == 4.0
    assert one(spark, numeric.quadratic_seconds(F.lit(0.0), F.lit(1.0), F.lit(0.0), F.lit(1.0))) is None


def test_options(tmp_path):
    assert options.merged({"a": {"b": 1, "c": 2}}, {"a": {"b": None, "c": 3}}) == {"a": {"b": 1, "c": 3}}
    assert options.load_config(str(tmp_path / "none.json")) is None
    (tmp_path / "c.json").write_text('{"x": 1}')
    assert options.load_config(str(tmp_path / "c.json")) == {"x": 1}
    with pytest.raises(ValueError):
        (tmp_path / "c.ini").write_text("")
        options.load_config(str(tmp_path / "c.ini"))
