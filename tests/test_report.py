import math

from echocache import schema as S
from echocache.operators import report as RP
from tests.rows import collected, entries


def checks(spark, rows):
    return spark.createDataFrame(rows, S.CHECK)


def test_report_of_passing_checks(spark):
    got = RP.report_text(checks(spark, [("fake", True, "ready", None)])).first()
    assert got.all_healthy and got.report == "Setup check passed.\n\n[OK] fake: ready"


def test_report_of_failing_checks_has_details(spark):
    rows = [("a", True, "ready", None), ("b", False, "not ready", "missing setup"), ("c", False, "bad", "")]
    got = RP.report_text(checks(spark, rows)).first()
    assert not got.all_healthy
    assert got.report == (
        "Setup check failed.\n\n[OK] a: ready\n[FAIL] b: not ready\n       missing setup\n[FAIL] c: bad"
    )


def test_no_checks_are_healthy(spark):
    empty = checks(spark, [])
    assert RP.all_healthy(empty).first()[0] is True
    assert RP.report_text(empty).first().report == "Setup check passed.\n\n"


def test_sound_table_passes_every_rule(spark):
    got = RP.table_checks(entries(spark, [(1, [1.0]), (2, [2.0])]))
    assert got.count() == 6 and got.where("NOT healthy").isEmpty()


def test_empty_table_passes_every_rule(spark):
    assert RP.table_checks(entries(spark, [])).where("NOT healthy").isEmpty()


def test_each_problem_is_counted(spark):
    rows = entries(spark, [(1, [1.0, 0.0]), (2, [0.0]), (3, [math.nan], 1, " \n"), (9, [1.0], 9)])
    got = RP.table_checks(rows, max_capacity=3)
    assert collected(got.where("NOT healthy"), "name", "details") == [
        ("capacity", "1 found"), ("dimensions", "1 found"), ("prompts", "1 found"),
        ("times", "1 found"), ("vectors", "2 found"),
    ]
