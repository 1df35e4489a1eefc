"""The limits that the flagships take as arguments (the registered queries have none)."""

import os

import pytest
from pyspark.sql import functions as F

from pairlab.plans import fixtures as FX
from pairlab.plans import flagships as FL
from pairlab.plans.catalog import ORACLE
from pairlab.plans.catalog import flagship as FS
from pairlab.sources import writers as W
from pairlab.sources.tables import Tables
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, SF_SMALL)


def test_registered_flagships_have_no_limit():
    for name in ("build_pair_dataset", "build_parallel_corpus"):
        assert "limit" not in ORACLE[name].lower()


def test_pair_dataset_limits(spark, tables, tmp_path):
    a = FX.articles(tables)
    path = lambda name: os.path.join(str(tmp_path), name)
    W.write_index(a.select(F.col("article_id").alias("id"), "language", "title", "url"), path("index"))
    W.write_records(a.select("article_id", "language", "title", "text", "url"), path("articles"))
    W.write_records(FX.summaries(tables), path("summaries"))
    pairs = [(r.language, r.article_id) for r in FX.pairs(tables).select("language", "article_id").collect()]
    ids = sorted(r.article_id for r in a.select("article_id").collect())
    for first, each in ((60, None), (None, 5), (60, 5)):
        out = path(f"out{first}-{each}")
        d = FL.build_pair_dataset_files(spark, path("index"), path("articles"), path("summaries"), out, "2024-01-01T00:00:00", max_articles=first, per_language=each)
        known, want = set(ids if first is None else ids[:first]), set()
        for lang in {x for x, _ in pairs}:
            want |= {(lang, i) for i in sorted(i for x, i in pairs if x == lang and i in known)[:each]}
        assert {(r.language, r.article_id) for r in d.collect()} == want


def test_parallel_corpus_limit(spark, tables):
    whole = FS.build_parallel_corpus(tables).toPandas()
    base, links = FX.base_links(tables)
    pages = FX.lang_pages(tables).select("language", "title", "doc_id", F.length("text").alias("n_text"))
    for n in (1, 2):
        first = FL.build_parallel_corpus(FX.base_pages(tables), links, pages, ["en", "fr", "de", "es"], max_sets=n).toPandas()
        assert first["page"].nunique() == min(n, whole["page"].nunique()) and set(first["doc_id"]) <= set(whole["doc_id"])
