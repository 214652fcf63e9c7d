"""CSV records that do not fit their header."""

import pytest

from tillroll.operators.clean import clean
from tillroll.sources import reader

TEXT = ('date,Item,qty,Price\n'
        '2024-01-01,a,1,2\n'
        '2024-01-02,b,3\n'                       # short
        '2024-01-03\n'                           # very short
        '2024-01-04,"c, and ""d""",2,5\n'
        '2024-01-05,"c, d",2\n'                  # short, with a separator inside quotes
        '2024-01-06,e,1,2,3,4\n'                 # long
        '2024-01-07,f,1,2,\n'                    # long by an empty field
        '2024-01-08,"g,1,2\n'                    # a quote that is not closed
        '2024-01-09,h,,\n'
        ',,,\n')


@pytest.fixture
def path(tmp_path):
    (tmp_path / "in.csv").write_text(TEXT)
    return str(tmp_path / "in.csv")


def test_short_records_are_filled_and_others_set_aside(spark, path):
    load = reader.load_csv(spark, path)
    rows = sorted(map(tuple, load.rows.collect()), key=str)
    assert rows == sorted([("2024-01-01", "a", "1", "2"), ("2024-01-02", "b", "3", None), ("2024-01-03", None, None, None),
                           ("2024-01-04", 'c, and "d"', "2", "5"), ("2024-01-05", "c, d", "2", None),
                           ("2024-01-09", "h", None, None), (None, None, None, None)], key=str)
    assert sorted(map(tuple, load.rejects.collect())) == [
        ("long", 5, "2024-01-07,f,1,2,"), ("long", 6, "2024-01-06,e,1,2,3,4"), ("quotes", 4, '2024-01-08,"g,1,2')]
    assert {r["status"]: r["records"] for r in load.counts.collect()} == {"whole": 4, "short": 3, "long": 2, "quotes": 1}
    assert load.rows.columns == ["date", "Item", "qty", "Price"] and load.rows.select("Item").distinct().count() == 6


def test_repair_fails_on_what_it_cannot_repair(spark, tmp_path, path):
    with pytest.raises(Exception, match="malformed record"):
        reader.read_csv(spark, path, malformed="repair").collect()
    (tmp_path / "short.csv").write_text("date,Item,qty,Price\n2024-01-01,a,1,2\n2024-01-02,b,3\n")
    rows = reader.read_sales(spark, str(tmp_path / "short.csv"))
    assert rows.count() == 2 and clean(rows).count() == 1
    with pytest.raises(Exception, match="(?i)malformed"):
        reader.read_sales(spark, str(tmp_path / "short.csv"), malformed="fail").collect()
    with pytest.raises(ValueError):
        reader.read_csv(spark, path, malformed="guess")


def test_other_separator_and_charset(spark, tmp_path):
    (tmp_path / "in.csv").write_bytes("Item;qty;x\ncaf\xe9;1;2\n\"a;b\";1\n".encode("iso-8859-1"))
    load = reader.load_csv(spark, str(tmp_path / "in.csv"), sep=";")
    assert sorted(map(tuple, load.rows.collect()), key=str) == [("a;b", "1", None), ("café", "1", "2")]
    assert load.rejects.count() == 0
