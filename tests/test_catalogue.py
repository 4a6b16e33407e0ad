"""Every query with SQL against DuckDB on the smallest data, values and types."""

import datetime
import os
from pathlib import Path

import duckdb
import pytest

from inkfold.plans import catalogue_tree, registry

SF = os.environ.get("INKFOLD_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_matches_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    want = duck.execute(registry.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    got = sorted((tuple(plain(x) for x in r) for r in df.select(*names).collect()), key=repr)
    assert got == sorted((tuple(plain(x) for x in r) for r in want.fetchall()), key=repr)


def test_every_query_is_known():
    assert set(registry.SQL) <= set(registry.QUERIES)


#: Queries over layouts that read no later table of their own.
LAYOUTS = ["provider_lines", "provider_layout", "provider_marks", "figure_captions"]


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts_are_parsed_before(spark, name):
    """Neither the JSON nor its parsing is left in the plan, where filters would repeat both."""
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "to_json" not in plan.lower() and "parse_json" not in plan.lower() and "variant" not in plan.lower()


def test_trees_read_written_layouts(spark):
    plan = catalogue_tree._parsed(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "to_json" not in plan.lower() and "variant" not in plan.lower()


def held(spark, name):
    """What the table that a query over layouts reads holds, and the query's plan."""
    df = registry.QUERIES[name](spark, SF)
    return spark.read.parquet(df.inputFiles()[0]).schema.simpleString(), df._jdf.queryExecution().optimizedPlan().toString()


def test_captions_read_what_they_need(spark):
    kind, plan = held(spark, "figure_captions")
    assert "json" not in kind and "lines" not in kind and "Join" not in plan


def test_marks_read_what_they_need(spark):
    kind, _ = held(spark, "provider_marks")
    assert "json" not in kind and "lines" not in kind and "paragraphs" not in kind


#: Queries over trees, on documents of which some say nothing.
TREES = ["provider_tree", "tree_report"]


@pytest.mark.parametrize("name", TREES)
def test_trees_of_blank_documents(spark, tmp_path, name):
    texts = ["", " ", "\n", "\n \n\n", "a", "\n\nb\n|\n", None]
    rows = [(i, texts[i % len(texts)], "en") for i in range(30 * len(texts))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = c.execute(registry.SQL[name])
    names = [d[0] for d in want.description]
    got = sorted((tuple(r) for r in registry.QUERIES[name](spark, str(tmp_path)).select(*names).collect()), key=repr)
    assert got == sorted(want.fetchall(), key=repr)
