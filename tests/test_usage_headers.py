"""Usage files of different headers, and scenarios worked out in the row."""

import gzip
import os

import pytest

from churnkit.operators import explain as ex
from churnkit.operators.accounts import encode_accounts
from churnkit.operators.counterfactual import (best_change, best_changes, counterfactuals, delta_best_change,
                                               delta_counterfactuals)
from churnkit.plans.explain_queries import BUNDLE_VOCAB
from churnkit.session import scratch_path
from churnkit.sources import fixtures
from churnkit.sources.accounts import header_groups, read_usage

SF = "/root/testdata/sf0.001"


def put(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    data = text.encode()
    with (gzip.open if name.endswith(".gz") else open)(f"{folder}/{name}", "wb") as f:
        f.write(data)


def test_files_are_read_by_their_own_header(spark, tmp_dir):
    put(tmp_dir, "a.csv", "id,mou_6,mou_7,date_7\n1,1.5,2.5,x\n2,,4,\n")
    put(tmp_dir, "b.csv", 'mou_7,"id",mou_6\n20,3,10\n')
    put(tmp_dir, "c.csv.gz", "﻿id,mou_7,mou_8\n4,7,8\n")
    put(tmp_dir, "d.csv", "")
    got = read_usage(spark, tmp_dir)
    assert got.columns == ["id", "mou_6", "mou_7", "date_7", "mou_8"]
    assert dict(got.dtypes) == {"id": "string", "mou_6": "double", "mou_7": "double", "date_7": "string", "mou_8": "double"}
    assert sorted(tuple(r) for r in got.collect()) == [
        ("1", 1.5, 2.5, "x", None), ("2", None, 4.0, None, None), ("3", 10.0, 20.0, None, None), ("4", None, 7.0, None, 8.0)]
    assert len(header_groups(spark, tmp_dir)) == 3


def test_bad_headers(spark, tmp_dir):
    put(f"{tmp_dir}/twice", "a.csv", "id,mou_6,mou_6\n1,2,3\n")
    with pytest.raises(ValueError, match="twice"):
        read_usage(spark, f"{tmp_dir}/twice")
    put(f"{tmp_dir}/none", "a.csv", "")
    with pytest.raises(ValueError, match="no file"):
        read_usage(spark, f"{tmp_dir}/none")


def test_scenarios_in_the_row_equal_scored_copies(spark):
    raw, model = fixtures.accounts(spark, SF), ex.fixture_linear_score()

    def score(df):
        return ex.linear_contributions(encode_accounts(df, vocab=BUNDLE_VOCAB)[0], model).drop("contribs")

    def rows(df):
        return sorted(map(repr, df.collect()))

    copies = counterfactuals(raw, score)
    assert rows(delta_counterfactuals(raw, model, BUNDLE_VOCAB).select(*copies.columns)) == rows(copies)
    long = best_change(counterfactuals(raw, score, with_current=True))
    assert rows(delta_best_change(raw, model, BUNDLE_VOCAB).select(*long.columns)) == rows(long)


def test_best_changes_neither_copy_nor_shuffle_rows(spark):
    path = scratch_path(spark, "raw-accounts")
    fixtures.accounts(spark, SF).write.parquet(path)
    plan = best_changes(spark.read.parquet(path), ex.fixture_linear_score(), BUNDLE_VOCAB)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Exchange" not in plan and "Python" not in plan
