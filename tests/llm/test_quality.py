import duckdb
import pytest
from pyspark.sql import functions as F

from tillroll.llm import quality


def verdicts(df, **how):
    return {r.doc_id: r for r in quality.judge(df, **how).collect()}


def test_boilerplate_and_depletion(docs_df, prose):
    line = "Accept all cookies to go on reading 7 items"
    more = "More news from our partners every day"
    rows = [(i, f"{prose(30)}\n{line.replace('7', str(i))}\n{more}\n{prose(3)}", "a") for i in range(20)]
    rows += [(100, f"{line}\n{more}\nand a few words of its own", "a")]              # depleted
    rows += [(200 + i, f"{prose(30)}\n{line}", "b") for i in range(5)]              # too few on this host
    v = verdicts(docs_df(rows))
    assert v[3].n_removed == 16 and v[3].kept
    assert v[100].n_removed == 16 and not v[100].kept and not v[100].base_failed
    assert v[201].n_removed == 0 and v[201].kept
    cleaned = {r.doc_id: r for r in quality.clean(docs_df(rows)).collect()}
    assert set(cleaned) == {i for i, x in v.items() if x.kept}
    assert "cookies" not in cleaned[3].text and cleaned[3].n_chars == len(cleaned[3].text)
    assert cleaned[201].text == rows[22][1]


def test_copies_are_not_boilerplate(docs_df, prose):
    page = "\n".join(prose(12) for _ in range(5))
    rows = [(i, page, "a") for i in range(40)] + [(50 + i, page + f"\nedition {i}", "a") for i in range(20)]
    assert all(x.kept and x.n_removed == 0 for x in verdicts(docs_df(rows)).values())


def test_base_counts(docs_df):
    eight = "a b c d e f g h"
    v = verdicts(docs_df([(1, f"{eight} {eight}"), (2, "é#*\t$ &\n\nx\nx\n \nx"), (3, "w " * 40)]))
    assert (v[1].n_words, v[1].n_repeat_words) == (16, 16)
    assert (v[2].n_words, v[2].word_chars, v[2].n_symbols, v[2].n_dup_lines) == (6, 8, 4, 2)
    assert v[3].n_repeat_words == 40 and v[3].base_failed


def test_edges(spark, docs_df, prose):
    good = prose(25)
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, good, None), (4, good), (4, good), (5, prose(9000))]
    got = quality.judge(docs_df(rows)).collect()
    assert len(got) == 7
    assert {r.doc_id: r.base_failed for r in got if r.doc_id in (1, 2, 3)} == {1: True, 2: True, 3: True}
    assert sum(r.kept for r in got if r.doc_id == 4) == 2
    assert quality.clean(docs_df(rows)).columns == docs_df(rows).columns
    assert quality.clean(docs_df(rows)).count() == 4
    assert quality.judge(docs_df([])).count() == 0 and quality.clean(docs_df([])).count() == 0


def test_repeated_rows_do_not_add_up(docs_df, prose):
    line = "one line that stands in many documents here"
    rows = [(i, f"{prose(30)}\n{line}") for i in range(15)]
    v = [r for r in quality.judge(docs_df(rows + rows[:1])).collect() if r.doc_id == 0]
    assert [r.n_removed for r in v] == [8, 8]


def test_no_python_in_plan(docs_df):
    plan = quality.judge(docs_df([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


NOTICE = "we and all our partners store cookies on your device to show adverts that suit you and to count visits"


def test_more_depleted_than_good_pages(docs_df, prose):
    rows = [(i, f"{NOTICE}\n{prose(12)}\n{prose(12)}") for i in range(20)]
    rows += [(100 + i, f"{NOTICE}\n{prose(4)}") for i in range(25)]
    v = verdicts(docs_df(rows))
    assert all(v[i].n_removed == 20 and v[i].kept for i in range(20))
    assert all(v[100 + i].n_removed == 20 and not v[100 + i].kept and not v[100 + i].base_failed for i in range(25))
    assert {r.doc_id for r in quality.clean(docs_df(rows)).collect()} == set(range(20))


def test_footer_with_a_large_copy_group(docs_df, prose):
    page = "\n".join(prose(12) for _ in range(5))
    rows = [(i, f"{page}\n{NOTICE}") for i in range(1200)] + [(2000 + i, f"{prose(30)}\n{NOTICE}") for i in range(12)]
    v = verdicts(docs_df(rows))
    assert all(x.n_removed == 20 and x.kept for x in v.values())


def test_lines_of_every_length(docs_df, prose):
    menu = "\n".join(f"{a} {b}" for a in ("log", "sign", "share", "read", "go") for b in ("in", "out", "up", "on", "to", "it"))
    legal = prose(70)
    rows = [(i, f"{menu}\n{prose(90)}\n{legal}\n{prose(80)}") for i in range(20)]
    rows += [(100, f"{menu}\n{prose(5)}"), (101, f"{legal}\n{prose(6)}")]
    rows += [(200 + i, f"{prose(30)}\n{'by chance' if i < 12 else prose(3)}", "b") for i in range(130)]
    v = verdicts(docs_df(rows))
    assert all(v[i].n_removed == 60 + 70 and v[i].kept for i in range(20))
    assert v[100].n_removed == 60 and v[101].n_removed == 70 and not v[100].kept and not v[101].kept
    assert all(v[200 + i].n_removed == 0 for i in range(130))


def test_pages_that_are_mostly_shared_notices(docs_df, prose):
    notices = "\n".join(prose(24, 900 + k) for k in range(3))
    rows = [(i, f"{notices}\n{prose(5, i)}") for i in range(60)]
    v = verdicts(docs_df(rows))
    assert all(x.n_removed == 72 and not x.kept and not x.base_failed for x in v.values())
    assert quality.clean(docs_df(rows)).count() == 0


def test_copies_count_once_beside_other_pages(docs_df, prose):
    page = "\n".join(prose(12, 70 + k) for k in range(5))
    rows = [(i, page) for i in range(300)] + [(1000 + i, prose(40, i)) for i in range(30)]
    assert all(x.kept and x.n_removed == 0 for x in verdicts(docs_df(rows)).values())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_sql_states_the_rule(spark, sf):
    folder = f"/root/testdata/{sf}"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = con.sql(quality.SQL)
    got = quality.judge(spark.read.parquet(f"{folder}/documents.parquet")).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_null_repeated_and_clashing_columns(spark, prose):
    line = "a notice that stands on every page of the host"
    rows = [(None if i % 4 == 0 else i % 9, f"{prose(30, i)}\n{line}", None if i % 2 else "h", i, i) for i in range(60)]
    df = spark.createDataFrame(rows + rows[:5], "doc_id long, text string, source string, n_words int, _host int")
    got = quality.judge(df).collect()
    assert len(got) == 65 and all(r.n_removed == 10 and r.kept for r in got)
    cleaned = quality.clean(df)
    assert cleaned.columns == df.columns and cleaned.count() == 65 and cleaned.where(F.col("text").contains("notice")).count() == 0
