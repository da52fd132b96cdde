"""Other columns, whatever their names, and labelled tables of one row or none."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tallyhouse.llm import centroids, cross_polytope, jaccard, line_templates, mixing, packing, periodic_runs, quality_rules, secrets, substrings, token_files, warc
from tests.llm.test_native import DOCS, docs

NAMES = ["a.b", "we`ird", "_n_dropped", "_quality_verdict", "_row", "_text", "_key", "_id", "_own", "_p", "_rate", "key", "leaf", "component_id",
         "_positions", "_new", "_copies", "_chance", "_tokens", "KEPT", "n_words", "pos", "w"]
PROSE = " ".join(f"the word{k} of it" for k in range(30))
TEXTS = [PROSE, PROSE, PROSE + " end", "short", None, "", "all other words here " * 20]


def _wide(df):
    return df.select("*", *[F.lit(k).alias(name) for k, name in enumerate(NAMES)])


def _labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def _mixed(df, spark):
    return mixing.mix(df, _labels(spark, [(0, 1, 0), (3, 0, 0)]))


@pytest.mark.parametrize("stage", [
    lambda df, spark: quality_rules.keep_good(df), lambda df, spark: line_templates.without_boilerplate(df, 2),
    lambda df, spark: jaccard.keep_one(df), _mixed], ids=["rules", "lines", "jaccard", "mixing"])
def test_stages_pass_any_other_column(spark, stage):
    frame = _wide(docs(spark, TEXTS))
    out = stage(frame, spark)
    assert out.columns == frame.columns
    for row in out.collect():
        assert list(row)[len(DOCS):] == list(range(len(NAMES)))


def test_operators_ignore_any_other_column(spark):
    plain = docs(spark, TEXTS)
    wide = _wide(plain)
    for run in (packing.pack, substrings.digest_rows, jaccard.groups, secrets.scan, periodic_runs.digest_rows, token_files.round_trip):
        assert sorted(map(repr, run(wide).collect())) == sorted(map(repr, run(plain).collect())), run.__module__
    judged = quality_rules.judge(wide)
    assert [c for c in judged.columns if c in NAMES and c not in ("KEPT", "n_words")] == [n for n in NAMES if n not in ("KEPT", "n_words")]
    dropped = line_templates.drop_lines(wide, 2)
    assert dropped.columns == [*wide.columns, "__n_dropped"]
    pages = spark.createDataFrame([(1, "u", "x"), (2, "u", "x")], "page_id long, url string, html string")
    assert sorted(map(repr, warc.archive_round_trip(_wide(pages)).collect())) == sorted(map(repr, warc.archive_round_trip(pages).collect()))
    vectors = spark.createDataFrame([(k, [float(k + 1)] * 64, 1) for k in range(4)], "vec_id long, embedding array<float>, label int")
    for run in (cross_polytope.near_copies, centroids.clustering):
        assert sorted(map(repr, run(_wide(vectors)).collect())) == sorted(map(repr, run(vectors).collect())), run.__module__


@pytest.mark.parametrize("labelled", [[], [(4, 1, 0)], [(0, 1, 0)], [(4, 1, 0), (5, 0, 0), (99, 1, 0), (0, None, None)]])
def test_few_and_empty_labelled_texts_give_no_nan(spark, labelled):
    rows = mixing.report(docs(spark, TEXTS), _labels(spark, labelled)).collect()
    assert len(rows) == len(TEXTS)
    for row in rows:
        assert not any(isinstance(v, float) and math.isnan(v) for v in row)
        assert abs(sum(row[c] for c in row.asDict() if c.startswith("p_")) - 1) < 1e-9
