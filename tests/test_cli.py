"""The command line runs parametrised plan functions and registered queries."""

from __future__ import annotations

from orderdesk.__main__ import main, plan_functions

from .conftest import SMOKE_DIR


def test_list_covers_queries(capsys):
    assert main(["list"]) == 0
    names = {line.split()[0] for line in capsys.readouterr().out.splitlines() if line.strip()}
    assert {"booking_list", "workflow_state", "audit_fk"} <= names


def test_run_with_params_writes_csv(spark, tmp_path):
    out = str(tmp_path / "rev")
    assert main(["run", "monthly_revenue", "--data", SMOKE_DIR, "-p", "as_of=2001-06-15", "-p", "months=3",
                 "--out", out, "--format", "csv"]) == 0
    back = spark.read.option("header", True).csv(out)
    assert back.columns[:2] == ["month", "month_name"] and back.count() > 0


def test_int_params_are_coerced():
    fn = plan_functions()["top_products"]
    from orderdesk.__main__ import _coerce
    assert _coerce(fn, "n", "3") == 3 and _coerce(fn, "ranked", "true") is True
