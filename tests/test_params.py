import datetime as dt

import pytest

from tidemark.params import FIRST_DAY, hour_window, parse_date
from tidemark.sources import hour_paths


def test_dates():
    assert parse_date("2015-01-01") == FIRST_DAY
    assert parse_date(dt.date(2020, 2, 29)) == dt.date(2020, 2, 29)
    for bad in ("2015-1-1", "20150101", "2015-02-30", "", dt.datetime(2020, 1, 1)):
        with pytest.raises(ValueError):
            parse_date(bad)


def test_date_range_check():
    assert parse_date("2015-01-01", check_range=True) == FIRST_DAY
    for bad in ("2014-12-31", "2999-01-01"):
        with pytest.raises(ValueError):
            parse_date(bad, check_range=True)


def test_hours():
    assert list(hour_window(22, 2)) == [22, 23]
    assert len(hour_window()) == 24
    for bad in ((24, 1), (-1, 2), (23, 2), (0, 0)):
        with pytest.raises(ValueError):
            hour_window(*bad)


def test_hour_paths_are_not_padded():
    paths = hour_paths("/lake", "2015-01-02")
    assert len(paths) == 24
    assert paths[3] == "/lake/bronze/2015-01-02/2015-01-02-3.json.gz"
    assert paths[-1].endswith("2015-01-02-23.json.gz")
