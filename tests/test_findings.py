"""Queries on small tables of their own, against their SQL."""

import os

import duckdb
import pytest

from crossgauge.plans import registry
from tests.test_oracle import rows

registry.load()


@pytest.fixture
def documents(spark, tmp_path):
    """A folder whose documents table has the given rows (doc_id, text, lang, source)."""

    def write(data):
        df = spark.createDataFrame([(*r, len(r[1] or "")) for r in data], "doc_id long, text string, lang string, source string, n_chars long")
        df.toPandas().to_parquet(os.path.join(tmp_path, "documents.parquet"), index=False)
        return str(tmp_path)

    return write


def both(spark, d, name):
    """Rows of a query by Spark and by its SQL."""
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    got, want = registry.QUERIES[name](spark, d).toPandas(), con.sql(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    return rows(got), rows(want)


def test_native_checks_list_every_id_and_count_every_row(spark, documents):
    data = [(3, "same", "en", "s"), (3, "same", "en", "s"), (4, "same", "en", "s"), (6, "bad �", "en", "s"), (9, "é", "en", "s"), (12, None, "en", "s"), (15, "same", "de", "s")]
    d = documents(data)
    got, want = both(spark, d, "AGG-32")
    assert got == want
    en = registry.QUERIES["AGG-32"](spark, d).where("lang = 'en'").first()
    assert (en["rows"], en["leaked"], en["corrupt"], en["not_nfc"]) == (5, ["3", "3"], ["6"], 1)


PAIRS = [(1, "a long enough text", "en", "s"), (2, "short", "de", "s"), (3, "short", "de", "s"), (4, " ", None, "s"), (5, "x �", None, "s"), (6, None, "fr", "s"), (7, "y", "fr", "s"), (8, "long " * 40, "de", "s"), (9, "long " * 40, "de", "s"), (10, "z", "de", "s")]


@pytest.mark.parametrize("name", ["AGG-31", "STR-13"])
def test_directions_without_ratio_or_language(spark, documents, name):
    got, want = both(spark, documents(PAIRS), name)
    assert got == want


def test_a_direction_gets_no_texts(spark, documents):
    from crossgauge.plans import derived as D

    x = D.measured_pairs(spark, documents(PAIRS))
    assert set(x.columns) == {"src_lang", "tgt_lang", "ratio", "blank", "copied", "replaced", "med"}
    assert "SortMergeJoin" not in x._jdf.queryExecution().executedPlan().toString()


def test_embedder_splits_few_texts_at_once(spark):
    import tracemalloc

    import pandas as pd

    from crossgauge.operators.models import hash_embedder

    texts = pd.Series([" ".join(f"w{(i * j) % 997}" for j in range(400)) for i in range(4000)])
    tracemalloc.start()
    made = next(hash_embedder(8).func(iter([texts])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(made) == 4000 and peak < 50_000_000


def test_a_text_is_folded_once_for_all_that_is_looked_for(spark):
    from pyspark.sql import functions as F

    from crossgauge.functions import numbers as N

    x = spark.createDataFrame([("₹ ५ लाख, 1,234 50%", "5 thousand 1234"), (None, "7"), ("", None)], "l string, r string").coalesce(1)
    c = x.select(N.compare_entities(F.col("l"), F.col("r")).alias("c"))
    plan = c._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") == 2 and plan.count("lower(") == 2
    assert [(r["c"]["preserved"], r["c"]["dropped"], r["c"]["added"], r["c"]["currency_lost"], r["c"]["percent_lost"]) for r in c.collect()] == [
        (False, [50.0, 500000.0], [5000.0], ["INR"], 1), (False, [], [7.0], [], 0), (True, [], [], [], 0)]


def test_tokens_of_odd_texts_cross_no_shuffle(spark, documents):
    texts = ["the end", "", None, " the  the ", "no term", "bathe", "é the", "a\tthe\nb c", "the", "   "]
    d = documents([(i, t, "en", "s") for i, t in enumerate(texts)])
    got, want = both(spark, d, "VEC-07")
    assert got == want and len(got) == 9
    plan = registry.QUERIES["VEC-07"](spark, d)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
