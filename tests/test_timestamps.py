from __future__ import annotations

import pytest

from phyllary.functions.dates import normal_time, read_date, zone_minutes
from phyllary.operators.timestamps import normalise_times

CASES = [
    ("2010-10-31T06:46:13+11", None, "2010-10-30T19:46:13Z"), ("October 21 1888", None, "1888-10-21"), ("Nov 1992", None, "1992-11"), ("28/5/1994", "dmy", "1994-05-28"), ("5/23/1993", "mdy", "1993-05-23"),
    ("23/5/1993", "mdy", None), ("13-16 Apr 1979", None, "1979-04-13/1979-04-16"), ("20220205", None, "2022-02-05"), ("27-Aug-1932", None, "1932-08-27"), ("09/2012", None, "2012-09"), ("1943-160", None, "1943-06-09"),
    ("1943-366", None, None), ("2022-10-01 23:41 CEST", None, "2022-10-01T21:41:00Z"), ("10MAR1906", None, "1906-03-10"), ("1961-01-29 to 1961-01-31", None, "1961-01-29/1961-01-31"), ("1998-05-25/27", None, "1998-05-25/1998-05-27"),
    ("1371156389495", None, "2013-06-13T20:46:29Z"), ("-173664000000", None, "1964-07-01T00:00:00Z"), ("1677196412", None, "2023-02-23T23:53:32Z"), ("Tue, 18 Sep 2018 01:11:49 +0900", None, "2018-09-17T16:11:49Z"),
    ("20191018T021111Z", None, "2019-10-18T02:11:11Z"), ("2017-04-05T20:18:27.166525Z", None, "2017-04-05T20:18:27Z"), ("昭和41年9月3日", None, "1966-09-03"), ("民國105年8月27日", None, "2016-08-27"), ("平成元年1月8日", None, "1989-01-08"),
    ("22 ก.พ. 2487", None, "1944-02-22"), ("15.I.1920", None, "1920-01-15"), ("coll. 24-x-1925", None, "1925-10-24"), ("Date: 27 février 2022", None, "2022-02-27"), ("6 de mayo de 1925", None, "1925-05-06"),
    ("25 августа 1903 г.", None, "1903-08-25"), ("December 1 to 3, 2011", None, "2011-12-01/2011-12-03"), ("28.-30. November 1995", None, "1995-11-28/1995-11-30"), ("19.XII.2018 0232 hrs UTC+2", None, "2018-12-19T00:32:00Z"),
    ("4 December 2010, 21:03 GMT", None, "2010-12-04T21:03:00Z"), ("2014-03-20 22.23 h UTC", None, "2014-03-20T22:23:00Z"), ("1987-13-40", None, None), ("0000-00-00", None, None), ("30.02.1990", None, None), ("s.d.", None, None), ("", None, None),
]


@pytest.mark.parametrize(("text", "order", "normal"), CASES)
def test_read_date(text, order, normal):
    assert read_date(text, order)[0] == normal


def test_zone_minutes():
    assert zone_minutes("UTC-05:30") == -330 and zone_minutes("+0900") == 540 and zone_minutes("XYZ") is None


def test_local_times_by_zone_intervals(spark):
    rows = [
        (1, "2023-11-05 01:42", "mdy", "America/New_York"), (2, "2023-03-12 02:56", "mdy", "America/New_York"), (3, "2019-03-31T01:39:00", "dmy", "Europe/London"), (4, "2013-07-01 12:00", "dmy", "Europe/Vienna"),
        (5, "2021-02-19 17:56:17 Asia/Tokyo", "dmy", "Europe/London"), (6, "2013-07-01 12:00", "dmy", None), (7, None, "dmy", "Europe/London"), (8, "   ", "dmy", "Europe/London"), (9, "x" * 200_000, "dmy", "Europe/London"), (4, "2013-07-01 12:00", "dmy", "Europe/Vienna"),
    ]
    df = spark.createDataFrame(rows, "id int, text string, o string, z string").selectExpr("*", "'old' as normal_text", "1 as zone")
    got = {(r.id, r.normal_text, r.time_status) for r in normalise_times(df, "text", "o", "z").collect()}
    assert got == {
        (1, "2023-11-05T05:42:00Z", "ambiguous"), (2, "2023-03-12T07:56:00Z", "nonexistent"), (3, "2019-03-31T01:39:00Z", "nonexistent"), (4, "2013-07-01T10:00:00Z", "unique"), (5, "2021-02-19T08:56:17Z", "unique"),
        (6, None, "no_zone"), (7, None, "none"), (8, None, "none"), (9, None, "none"),
    }
    assert normalise_times(df, "text", "o", "z").count() == len(rows)
    assert normalise_times(df.limit(0), "text", "o", "z").count() == 0


def test_zone_names_with_digits_and_shared_abbreviations(spark):
    rows = [("2020-01-01 10:00 Etc/GMT+5", "2020-01-01T15:00:00Z", "unique"), ("2020-01-01 10:00 CST", "2020-01-01T16:00:00Z", "assumed"), ("2020-01-01 10:00 IST", "2020-01-01T04:30:00Z", "assumed"), ("2020-01-01 10:00 EST", "2020-01-01T15:00:00Z", "instant")]
    df = spark.createDataFrame([(t,) for t, _, _ in rows], "text string")
    assert {(r.text, r.normal_text, r.time_status) for r in normalise_times(df, "text").collect()} == set(rows)
    assert normal_time("2023-11-05 01:42", "mdy", "America/New_York") == "2023-11-05T05:42:00Z" and normal_time("2023-03-12 02:56", "mdy", "America/New_York") == "2023-03-12T07:56:00Z" and normal_time("2023-03-12 02:56", "mdy") is None


def test_every_hour_of_a_year_agrees_with_the_zone_database(spark):
    from datetime import datetime, timedelta
    from zoneinfo import ZoneInfo

    zone = ZoneInfo("Australia/Sydney")
    local = [datetime(2021, 1, 1) + timedelta(hours=h, minutes=30) for h in range(8760)]
    df = spark.createDataFrame([(t.strftime("%Y-%m-%d %H:%M"), "dmy", "Australia/Sydney") for t in local], "text string, o string, z string")
    got = {r.text: r.normal_text for r in normalise_times(df, "text", "o", "z").collect()}
    for t in local:
        # fold 0 is the earlier instant of a repeated time and the offset before the change of a skipped one
        utc = t.replace(tzinfo=zone, fold=0).astimezone(ZoneInfo("UTC"))
        assert got[t.strftime("%Y-%m-%d %H:%M")] == utc.strftime("%Y-%m-%dT%H:%M:%SZ")
