import datetime as dt
import random

import pytest

from ledgerloom.operators.timestamps import civil_from_days, days_from_civil, fact_moments, normal_forms, read_moment, read_period


def test_day_arithmetic_agrees_with_the_calendar():
    for d in random.Random(1).sample(range(-200_000, 200_000), 3000):
        day = dt.date(1970, 1, 1) + dt.timedelta(days=d)
        assert civil_from_days(d) == (day.year, day.month, day.day) and days_from_civil(*civil_from_days(d)) == d
    assert days_from_civil(2023, 2, 29) is None and days_from_civil(2023, 13, 1) is None and days_from_civil(2024, 2, 29) is not None


@pytest.mark.parametrize(("text", "order", "form"), [
    ("3Q21", "", "2021-Q3"), ("Q4-25", "", "2025-Q4"), ("T3 2023", "DM", "2023-Q3"), ("the fourth quarter, 2020", "", "2020-Q4"), ("Q5 2022", "", None), ("FY'23", "", "FY2023"), ("fiscal 2024", "", "FY2024"),
    ("2024A", "", "2024"), ("CY2019", "", "2019"), ("H2 2023", "", None), ("month ended 31-Jan-22", "", "2022-01"), ("month ended 31 June 2022", "", None), ("febrero de 2021", "DM", "2021-02"), ("1er mars 2024", "DM", "2024-03"),
    ("03/2020", "", "2020-03"), ("13/2024", "", None), ("05/03/2024", "", None), ("05/05/2024", "", "2024-05"), ("05/03/2024", "MD", "2024-05"), ("05/03/2024", "DM", "2024-03"), ("TTM", "", None), ("", "", None), (None, "", None),
])
def test_periods(text, order, form):
    assert read_period(text, order) == form


@pytest.mark.parametrize(("text", "order", "form"), [
    ("45292", "", "2024-01-01"), ("20240105", "", "2024-01-05"), ("1710057485", "", "2024-03-10T07:58:05.000Z"), ("1637767437207", "", "2021-11-24T15:23:57.207Z"), ("2021-03-14T03:13:27.802976-06:00", "", "2021-03-14T09:13:27.802Z"),
    ("Sat, 27 Dec 2025 05:28:40 -0700", "", "2025-12-27T12:28:40.000Z"), ("Fri, 27 Dec 2025 05:28:40 -0700", "", None), ("7 Nov 2021 02:30 MST", "", "2021-11-07T09:30:00.000Z"), ("24-Oct-20", "", "2020-10-24"),
    ("31/11/2024", "MD", None), ("25/12/2024", "MD", "2024-12-25"), ("12/02/2022", "", None), ("29.02.2023", "DM", None), ("22 de mayo de 2020", "DM", "2020-05-22"), ("2023-14-32T08:00:00Z", "", None), ("0000-00-00", "", None), ("soon", "", None),
])
def test_moments_without_a_local_zone(text, order, form):
    assert read_moment(text, order)[0] == form


def test_local_times_follow_the_zone_and_its_gaps(spark):
    rows = [("2024-03-31 02:30", "Europe/Berlin", None), ("2024-10-27 02:30", "Europe/Berlin", None), ("2024-10-27 01:59:59", "Europe/Berlin", "2024-10-26T23:59:59.000Z"), ("3/10/2024 3:10 AM", "America/New_York", "2024-03-10T07:10:00.000Z"),
            ("15.01.2025 14:15 Uhr", "Europe/Berlin", "2025-01-15T13:15:00.000Z"), ("10/10/2024 à 10h22", "Europe/Paris", "2024-10-10T08:22:00.000Z"), ("2024-07-01 12:00", None, None), ("2024-07-01 12:00", "Mars/Phobos", None), ("2019-12-29 03:06:27 [America/Denver]", None, "2019-12-29T10:06:27.000Z")]
    df = spark.createDataFrame([("moment", t, z, "en-US" if "AM" in t else None) for t, z, _ in rows], "kind string, text string, time_zone string, locale string")
    got = {(r.text, r.time_zone): r.normal_form for r in normal_forms(df).collect()}
    assert got == {(t, z): f for t, z, f in rows}


def test_facts_with_nulls_repeats_and_unknown_sources(spark):
    f = spark.createDataFrame([("a", 1, "Apr-24", "2024-01-05"), ("a", 1, "Apr-24", "2024-01-05"), ("b", 9, None, " "), ("c", None, "2024", "x" * 50_000)], "fact_id string, source_id bigint, period_text string, observed_at_text string")
    s = spark.createDataFrame([(1, "en-US", None), (1, "en-US", None)], "source_id bigint, locale string, time_zone string")
    assert sorted(map(tuple, fact_moments(f, s).collect())) == [("a", "observed_at_text", "2024-01-05"), ("a", "period_text", "2024-04"), ("c", "period_text", "2024")]
    assert fact_moments(f.limit(0), s.limit(0)).count() == 0
