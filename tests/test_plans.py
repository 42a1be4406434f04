"""What the plans read and how they join."""

from __future__ import annotations

import re
import subprocess
import sys
from pathlib import Path

import pytest

from tileframe import catalog

ROOT = Path(__file__).resolve().parents[1]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_only_needed_columns_are_read(spark, sf):
    plan = plan_of(catalog.queries()["severity_by_customer"](spark, sf))
    schemas = set(re.findall(r"ReadSchema: struct<([^>]*)>", plan))
    assert any("l_orderkey" in s and "l_discount" in s and "l_tax" not in s and "l_shipdate" not in s for s in schemas)
    assert any(s.startswith("o_orderkey") and "o_totalprice" not in s for s in schemas)


@pytest.mark.parametrize("name", ["severity_by_customer", "blend_overlap", "gaussian_smooth", "local_maxima", "stem_pairs", "export_rows"])
def test_no_product_of_large_sides(spark, sf, name):
    plan = plan_of(catalog.queries()[name](spark, sf))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_partial_aggregation_before_the_shuffle(spark, sf):
    plan = plan_of(catalog.queries()["blend_overlap"](spark, sf))
    assert plan.index("functions=[sum") < plan.index("Exchange") < plan.index("functions=[partial_sum")


def test_columns_don_t_depend_on_partitions(spark, sf):
    got = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        df = catalog.queries()["object_vote_upgrade"](spark, sf)
        got.append(sorted(map(tuple, df.collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[0] == got[1]


def test_nothing_else_imports_the_llm_subpackage():
    for f in (ROOT / "tileframe").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT / "tileframe").parts:
            assert not re.search(r"\bllm\b", re.sub(r'""".*?"""', "", f.read_text(), flags=re.S)), f


def test_the_rest_works_without_the_llm_subpackage(tmp_path):
    import shutil

    for part in ("tileframe", "__spark_entry__.py"):
        src = ROOT / part
        shutil.copytree(src, tmp_path / part, ignore=shutil.ignore_patterns("llm", "__pycache__")) if src.is_dir() else shutil.copy(src, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'severity_by_customer' in q and not [n for n in q if n.startswith('op1_')] and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
