from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from gridloom.functions.expressions import bands_of, compile_expression
from gridloom.functions.numerics import compensated, exact_sums
from gridloom.model import Grid, Options, RequestError
from gridloom.operators import coverage, cumulative, geometry, ordered, reducers, summaries, zonal

CYCLE = [1e16, 1.0, -1e16, -2.0] * 128


def joined(spark, values, fractions, weights=None, valid=None):
    rows = [("s", "z", 0, float(v), float(f), None if weights is None or weights[i] < 0 else float(weights[i]), True if valid is None else valid[i]) for i, (v, f) in enumerate(zip(values, fractions, strict=True))]
    return spark.createDataFrame(rows, "slice_id string, zone_id string, band int, value double, f double, w double, valid boolean")


def test_compensated_and_exact_sums(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(CYCLE)], "k string, i int, v double")
    fold = df.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("a")).select(compensated(F.transform("a", lambda x: x["v"])).alias("s"))
    assert fold.first()["s"] == -128
    assert exact_sums(df.repartition(7), ["k"], ["v"]).first()["v"] == -128


def test_overflow_fails(spark):
    df = spark.createDataFrame([("a", 1e308), ("a", 1e308)], "k string, v double")
    with pytest.raises(Exception, match="finite|overflow"):
        exact_sums(df, ["k"], ["v"]).collect()


def test_ranks(spark):
    j = joined(spark, [1, 5], [0.25, 0.75])
    assert zonal.ranks(j, (0.0, 0.25, 0.5, 1.0)).first()["quantiles"] == [1, 1, 5, 5]
    w = joined(spark, [1, 5, 9], [1, 1, 1], [4, 0, -1])
    assert zonal.ranks(w, (0.0, 0.5, 1.0), True).first()["weighted_quantiles"] == [1, 1, 1]


def test_exact_ranks_and_masses_below_double_precision(spark):
    tiny = 2.0**-54
    assert reducers.exact_quantiles([0, 1, 1], [0.5, 0.5, tiny], [0.5]) == [1]
    mass, top, kinds = reducers.exact_masses([10, 20, 20], [0.5, 0.5, tiny], [10, 20, 30])
    assert (top, kinds) == (20, 2) and mass[20] > mass[10]
    assert reducers.exact_masses([10, 20, 20], [0.5, 0.25, 0.25], [10, 20, 30])[1] == 10
    with pytest.raises(RequestError):
        reducers.exact_masses([40], [1], [10, 20])
    got = reducers.exact_statistics(joined(spark, [0, 1, 1], [0.5, 0.5, tiny]), ["zone_id"]).first()
    assert got["quantiles"] == [1]


def test_exact_variance():
    values, weights = [1e16, 1e16 + 2, 1e16 + 4, 1e16 + 6], [1, 0.5, 0.25, 0.125]
    w = list(map(Fraction, weights))
    mean = sum(Fraction(v) * x for v, x in zip(values, w, strict=True)) / sum(w)
    want = float(sum(x * (Fraction(v) - mean) ** 2 for v, x in zip(values, w, strict=True)) / sum(w))
    assert reducers.exact_variance(values, weights)[0] == want
    var, dev = reducers.exact_variance([0, 1e-200], [1, 1])
    assert dev > 0 and var == 0


def test_moments_and_invalid_cells(spark):
    got = zonal.moments(joined(spark, [-1000, 1, 5], [1, 0.25, 0.75], valid=[False, True, True])).first()
    assert got["variance"] == 3


def test_category_outside_domain_fails(spark):
    with pytest.raises(Exception, match="category_values"):
        zonal.categories(joined(spark, [40], [1]), (10.0, 20.0)).collect()


def test_histogram_bins_close_at_the_end(spark):
    o = Options(statistics=("histogram",), histogram_edges=(0.0, 10.0, 20.0))
    h = zonal.basic_states(joined(spark, [-1, 0, 10, 20, 21], [1, 1, 1, 1, 1]), o).first()["histogram"]
    assert (h["counts"], h["underflow"], h["overflow"]) == ([1, 2], 1, 1)


@pytest.mark.parametrize("bad", [
    {"statistics": ["sum", "sum"]}, {"statistics": ["nope"]}, {"weight_band": 1, "statistics": ["sum"]}, {"statistics": ["weighted_sum"]},
    {"category_values": [1, 2]}, {"statistics": ["histogram"]}, {"quantiles": [0.5], "statistics": ["median"]}, {"bands": [0, 0]}, {"histogram_edges": [1, 1]}, {"other": 1},
])
def test_strict_options(bad):
    with pytest.raises(RequestError):
        Options.of(bad)


def test_expressions_are_strict_about_null(spark):
    df = spark.createDataFrame([(8.0, 2.0), (3.0, 1.0), (0.0, 0.0), (4.0, None)], "a double, b double")
    band = lambda k: F.col("ab"[k])
    b0, b1 = {"op": "band", "band": 0}, {"op": "band", "band": 1}
    nd = compile_expression({"op": "normalized_difference", "left": b0, "right": b1}, band)
    assert [r[0] if r[0] is None else round(r[0], 12) for r in df.select(nd).collect()] == [0.6, 0.5, None, None]
    false = {"op": "less", "left": b0, "right": {"op": "constant", "value": -1}}
    both = compile_expression({"op": "and", "left": false, "right": b1}, band)
    assert [r[0] for r in df.select(both).collect()] == [0, 0, 0, None]
    assert [r[0] for r in df.select(compile_expression({"op": "divide", "left": b0, "right": b1}, band)).collect()] == [4, 3, None, None]
    for bad in ({"op": "python"}, {"op": "band", "band": -1}, {"op": "constant", "value": float("inf")}, {"op": "add", "left": b0}, {"op": "band", "band": 0, "more": 1}):
        with pytest.raises(RequestError):
            bands_of(bad)


def test_ordered_policies_charge_in_their_own_order(spark):
    nan = float("nan")
    rows = [("p", 0, i, v, m) for i, (v, m) in enumerate([(1.0, True), (-5.0, True), (-9.0, True), (nan, False), (nan, True), (2.0, False)])]
    df = spark.createDataFrame(rows, "polygon_id string, window_no int, pos long, value double, mask boolean")
    a = ordered.ordered_sums(df, ["polygon_id"], -9.0).first()
    assert (a["sum"], a["valid_count"], a["excluded_nonfinite"], a["excluded_nodata"], a["excluded_negative"]) == (3, 2, 2, 1, 1)
    b = ordered.ordered_sums(df, ["polygon_id"], -9.0, ordered.ORDERED_BULK).first()
    assert (b["sum"], b["excluded_mask"], b["excluded_nonfinite"], b["excluded_nodata"], b["excluded_negative"]) == (1, 2, 1, 1, 1)


def test_ordered_fold_does_not_depend_on_partitions(spark):
    df = spark.createDataFrame([("p", i // 50, i, v) for i, v in enumerate(abs(x) + 0.1 * k for k, x in enumerate(CYCLE[:200]))], "polygon_id string, window_no int, pos long, value double")
    want = 0.0
    for w in range(4):
        part = 0.0
        for i in range(50 * w, 50 * w + 50):
            part += abs(CYCLE[i]) + 0.1 * i
        want += part
    assert ordered.ordered_sums(df.repartition(9), ["polygon_id"]).first()["sum"] == want


def test_bulk_repeats_and_nonfinite(spark):
    v = spark.createDataFrame([("b", 0, i, float(i)) for i in range(5)], "band_id string, window_no int, idx long, value double")
    spans = ordered.spans(spark.createDataFrame([(0, 0, 1, 3), (0, 1, 2, 2)], "window_no int, span_no long, start long, count long"))
    r = ordered.bulk_reduce(v, spans).first()
    assert (r["sum"], r["valid_count"], r["min"], r["max"], r["mean"]) == (11, 5, 1, 3, 2.2)
    with pytest.raises(Exception, match="finite"):
        ordered.bulk_reduce(v.withColumn("value", F.lit(float("inf")))).collect()


@pytest.mark.parametrize("parts", [1, 7])
def test_sums_and_moments_do_not_depend_on_order(spark, parts):
    j = joined(spark, CYCLE, [1] * 512).repartition(parts)
    assert zonal.basic_states(j, Options()).first()["fractional_sum"] == -128
    tiny = joined(spark, [1e-200, 3e-200], [1, 1]).repartition(parts)
    got = zonal.moments(tiny).first()
    assert (got["variance"], got["stddev"]) == (0, 1e-200)
    values, weights = [1e16 + 2 * (i % 7) for i in range(40)], [float(i % 5) for i in range(40)]
    got = zonal.moments(joined(spark, values, [0.5] * 40, weights).repartition(parts), True).first()
    assert got["weighted_variance"] == reducers.exact_variance(values, [0.5 * w for w in weights])[0]
    huge = zonal.moments(joined(spark, [1e154, -1e154], [1, 1]).repartition(parts)).first()
    assert huge["stddev"] == 1e154


def test_exact_masses_decide_ranks_and_ties(spark):
    tiny = 2.0**-54
    assert zonal.ranks(joined(spark, [0, 1, 1], [0.5, 0.5, tiny]), (0.5,)).first()["median"] == 1
    got = zonal.categories(joined(spark, [10, 20, 20], [0.5, 0.5, tiny]), (10.0, 20.0, 30.0)).first()
    assert (got["majority"], got["variety"], [c["mass"] for c in got["categories"]]) == (20, 2, [0.5, 0.5, 0])
    assert zonal.categories(joined(spark, [10, 20, 20], [0.5, 0.25, 0.25]), (10.0, 20.0, 30.0)).first()["majority"] == 10


def test_plain_sums_stay_available(spark):
    assert zonal.basic_states(joined(spark, [1, 2, 4], [1, 1, 0.5]), Options(), exact=False).first()["fractional_sum"] == 5


def one_row(spark, values):
    return spark.createDataFrame([("s", 0, i, 0, float(v), True) for i, v in enumerate(values)], "slice_id string, row int, col int, band int, value double, valid boolean")


@pytest.mark.parametrize("parts", [1, 7])
def test_prefixes_edges_and_summaries_are_exact(spark, parts):
    cells = one_row(spark, [1e16] + [1] * 511).repartition(parts)
    grid = Grid.local(512, 1)
    zones = spark.createDataFrame([("z", '{"type":"Polygon","coordinates":[[[1,0],[512,0],[512,1],[1,1],[1,0]]]}')], "zone_id string, geometry string")
    selection = coverage.select_cells(zones, grid)
    assert summaries.measure_by_prefix(cells, selection).first()["fractional_sum"] == 511
    assert cumulative.edge_sums(cells, geometry.edges_of(zones, grid), grid).first()["fractional_sum"] == 511
    whole = spark.createDataFrame([("z", '{"type":"Polygon","coordinates":[[[0,0],[512,0],[512,1],[0,1],[0,0]]]}')], "zone_id string, geometry string")
    cells = one_row(spark, CYCLE).repartition(parts)
    table = summaries.pyramid(cells, 16, 3)
    assert {r["fractional_sum"] for r in table.where("level = 3").collect()} == {-32}
    got = summaries.measure_with(table, cells, coverage.select_cells(whole, grid), geometry.zone_facts(whole, grid), grid, 16, 3).first()
    assert (got["fractional_sum"], got["covered_cell_equivalents"], got["valid_cell_count"], got["status"]) == (-128, 512, 512, "ok")
