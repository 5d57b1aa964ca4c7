from __future__ import annotations

import pytest

from phyllary.functions.quantities import read_altitude, solve_units
from phyllary.operators.units import agreed_altitude, identity_units, normalise_altitudes

CASES = [
    ("1520 ft (463 m)", None, (463, 463)), ("94 m (310 ft)", None, (94, 94)), ("altitude 1,510 feet", None, (460, 460)), ("113-173 m", None, (113, 173)), ("between 2230 and 2330 ft.", None, (680, 710)), ("0,25 km", None, (250, 250)), ("1.45 km", None, (1450, 1450)),
    ("570 yd.", None, (521, 521)), ("2480", "ft", (756, 756)), ("2999.0", "m", (2999, 2999)), ("2480", None, None), ("25 m below sea level", None, (-25, -25)), ("-24 m", None, (-24, -24)), ("1 130 m s.m.", None, (1130, 1130)), ("標高 639 m", None, (639, 639)), ("海拔152米", None, (152, 152)),
    ("100 m; 900 m", None, (100, 900)), ("100 m and later 900 m and 1500 m", None, (100, 1500)), ("850 m at base, 1200 m at summit", None, (850, 1200)), ("1200 (3937 ft)", None, (1200, 1200)), ("3937 ft / 1200", None, (1200, 1200)), ("7 (3937 ft)", None, (1200, 1200)),
    ("1378英尺", None, (420, 420)), ("1043 Fuß", None, (318, 318)), ("863-1,060 '", None, (263, 323)), ("434 metres - 460 metres", None, (434, 460)), ("12 km N of bridge; 1007 m s.n.m.", None, (1007, 1007)), ("Slope 30°, 1740 pieds, trunk 12 cm thick", None, (530, 530)),
    ("Sheet 2 of 2. 1,148-1,640 ft", None, (350, 500)), ("720 m; 3 plants seen", None, (720, 720)), ("sea cliff", "m", None), ("n/a", "m", None), ("", "m", None), (None, "m", None), ("670 м над ур. м.", None, (670, 670)), ("1530' - 1857'", None, (466, 566)),
]


@pytest.mark.parametrize(("text", "unit", "span"), CASES)
def test_read_altitude(text, unit, span):
    got = read_altitude(text, (unit,) if unit else ())
    assert (got and got[:2]) == span


def test_units_chosen_by_another_altitude():
    both = ("ft", "m")
    assert read_altitude("610", both, 612)[:3] == (610, 610, True) and read_altitude("2000", both, 611)[:3] == (610, 610, True)
    # nothing speaks for a unit, or nothing fits: the likeliest, not unique
    assert read_altitude("610", both)[:3] == (186, 186, False) and read_altitude("610", both, 5000)[:3] == (186, 186, False)
    # two feet and two metres are both within a metre of one metre
    assert read_altitude("2", both, 1)[:3] == (1, 1, False) and read_altitude("610-700", ("m", "ft"), 186)[:3] == (186, 213, True)
    assert read_altitude("1520 ft (463 m)", ())[2:] == (True, pytest.approx(0.0006, abs=1e-4)) and read_altitude("0", both, 0)[:2] == (0, 0)


def test_agreed_altitude(spark):
    df = spark.createDataFrame([("a", 100), ("a", 101), ("b", 100), ("b", 900), ("c", None), ("", 5), (None, 5), ("d", -3)], "k string, low long")
    assert {(r.k, r.evidence_m) for r in agreed_altitude(df, "k", "low").collect()} == {("a", 100), ("d", -3)} and agreed_altitude(df.limit(0), "k", "low").count() == 0
    rows = spark.createDataFrame([("610", "ft", 612), ("610", "ft", None)], "text string, unit string, e long")
    assert [(r.low_m, r.unit_unique) for r in normalise_altitudes(rows, "text", "unit", ["m", "ft"], "e").collect()] == [(610, True), (186, False)]


def test_solve_units_by_identity():
    factors = {"g": 0.001, "kg": 1.0, "l": 0.001, "m3": 1.0, "kg/m3": 1.0, "g/cm3": 1000.0}
    # 2 kg are 0.8 kg/m3 in 2.5 m3 or 0.8 g/cm3 in 2.5 l: not unique, the prior decides
    case = [2000.0, 0.8, 2.5], [1, -1, -1], [["g", "kg"], ["kg/m3", "g/cm3"], ["l", "m3"]], factors
    assert solve_units(*case, prior={"l": 1.0})[0] == ("g", "g/cm3", "l") and solve_units(*case, prior={"m3": 1.0})[0] == ("g", "kg/m3", "m3")
    _, residual, unique = solve_units(*case)
    assert residual < 0.01 and not unique
    units, _, unique = solve_units([1520, 463], [1, -1], [["ft", "m"], ["ft", "m"]], {"ft": 0.3048, "m": 1.0})
    assert units == ("ft", "m") and unique


def test_rows_of_every_kind(spark):
    rows = [("1520 ft", None), ("100", "ft"), ("100", None), (None, "m"), ("", "m"), ("9" * 100_000 + " parrots", "m"), ("x 1 " * 50_000 + "7 m", "m"), ("1520 ft", None)]
    df = spark.createDataFrame(rows, "text string, unit string").selectExpr("*", "'mine' as low_m")
    got = [(r.low_m, r.high_m) for r in normalise_altitudes(df, "text", "unit").collect()]
    assert got == [(463, 463), (30, 30), (None, None), (None, None), (None, None), (None, None), (7, 7), (463, 463)]
    assert normalise_altitudes(df.limit(0), "text", "unit").count() == 0


def test_identity_units_of_columns(spark):
    df = spark.createDataFrame([(1520.0, 463.0), (463.0, 463.0), (None, 1.0), (0.0, 1.0), (-5.0, 3.0)], "a double, b double")
    out = identity_units(df, [("a", 1, ["ft", "m"]), ("b", -1, ["ft", "m"])], {"ft": 0.3048, "m": 1.0}).collect()
    assert (out[0].unit_a, out[0].unit_b, out[0].units_unique) == ("ft", "m", True) and abs(out[0].base_a - 463.296) < 1e-9
    assert out[1].unit_a == out[1].unit_b and not out[1].units_unique
    assert all(r.unit_a is None and r.base_b is None and not r.units_unique for r in out[2:])
