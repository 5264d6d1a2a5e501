"""Ids of other types and columns whose names hold dots."""

import datetime
from decimal import Decimal

import pytest

from drawlens.llm import bpe, decontam, html_extract, lm, simhash, substring
from drawlens.llm.queries import tokenizer


@pytest.mark.parametrize("call", [simhash.simhash_groups, lm.score_documents, substring.kept_digest, lambda d, i: bpe.tokenize(d, *tokenizer(), doc_id=i)])
def test_names_with_dots(spark, call):
    docs = spark.createDataFrame([(i, f"some words of text {i}") for i in range(30)], "`doc.id` bigint, text string")
    assert sorted(r[0] for r in call(docs, "doc.id").collect()) == list(range(30))


def test_pages_with_dots(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>Some text of the article, long enough.</p></article>")], "`page.id` bigint, url string, html string")
    assert [r[0] for r in html_extract.extract(pages, "page.id").collect()] == [1]


@pytest.mark.parametrize(("kind", "value"), [("smallint", 3), ("decimal(5,2)", Decimal("1.50")), ("date", datetime.date(2020, 1, 2)), ("double", 2.5), ("binary", bytearray(b"x"))])
def test_items_with_ids_of_any_type(spark, kind, value):
    item = "what is the colour of the old bridge over the river near the mill it is a deep red since the year it was built"
    docs = spark.createDataFrame([(1, "nothing of the kind " * 9), (2, "before that " + item + " and after")], "doc_id bigint, text string")
    items = spark.createDataFrame([(value, item)], f"item_id {kind}, text string")
    assert [(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(docs, items).collect()] == [(2, value)]
