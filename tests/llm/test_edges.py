"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names for every operator and stage."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tieout.llm import decontaminate, kneser_ney, mixing, neardup, pii, quality, sharding, tokenstore, toxicity, webp

LONG = "word another third " * 4000
ROWS = [
    (1, "alpha beta gamma delta epsilon zeta eta", "en", "s1", 3, "x"), (1, "alpha beta gamma delta epsilon zeta eta", "en", "s1", 3, "x"), (2, "ALPHA beta gamma delta epsilon zeta eta", None, None, None, None),
    (3, None, "en", "s1", 0, "y"), (None, "someone a.b@c.de here", "en", "s2", 1, "z"), (4, "", "en", "s1", 0, "y"), (5, " \n\t", "en", None, 0, "y"), (6, LONG, "en", "s3", 1, "y"), (7, "short", "en", "s1", 1, "y"), (8, "naïve 日本 <|endoftext|>  x", "fr", "", 1, "y"),
]
DDL = "doc_id long, text string, lang string, source string, n_chars long, {}"
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture
def docs(spark):
    """Rows with further columns whose names the operators use within."""
    names = ("key", "id", "rep", "size", "score", "component", "epoch", "blob", "__id", "__mx_times", "__mx_time", "__MX_own", "h1", "a.b")
    df = spark.createDataFrame(ROWS, DDL.format("key string"))
    for name in names[1:]:
        df = df.withColumn(name, F.col("key"))
    return df.repartition(3)


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, None, 1), (None, 1, 1), (6, 0, None), (7, 0, 1), (7, 0, 1), (99, 1, 1)], LABELS)


@pytest.fixture
def benchmark(spark):
    return spark.createDataFrame([(0, "beta gamma delta epsilon zeta"), (1, None), (2, ""), (None, "word another third word another third"), (0, "beta gamma delta epsilon zeta")], "item_id long, text string")


def results(spark, docs, labels, benchmark):
    model = kneser_ney.train(docs)
    field = toxicity.train(docs, labels)
    pieces, documents = mixing.mixture(docs)
    return {
        "language model": kneser_ney.scores(docs, model), "quality": quality.quality_scores(docs, labels), "personal data": pii.personal_data(docs), "mixture": documents, "tokens": tokenstore.read_store(spark, tokenstore.write_store(docs)),
        "near duplicates": neardup.near_duplicates(docs), "sharding": sharding.interleave(docs, 4), "media": webp.from_media(webp.to_media(docs)), "toxicity": toxicity.toxicity(docs, field),
    }


def test_every_row_has_a_result(spark, docs, labels, benchmark):
    for name, df in results(spark, docs, labels, benchmark).items():
        assert df.count() == len(ROWS), name
    near = {r["doc_id"]: r for r in neardup.near_duplicates(docs).collect()}
    assert (near[1]["component_id"], near[2]["component_id"], near[2]["kept"]) == (1, 1, False) and near[3]["n_shingles"] == near[4]["n_shingles"] == near[5]["n_shingles"] == 0 and near[4]["kept"] and near[7]["n_shingles"] == 1
    lm = {r["id"]: r["n_tokens"] for r in kneser_ney.scores(docs, kneser_ney.train(docs)).collect()}
    assert lm[3] == lm[4] == lm[5] == 1 and lm[6] == 12001
    spans = {r["doc_id"]: r["spans"] for r in pii.personal_data(docs).collect()}
    assert spans[None] == "email:8:16" and spans[3] == ""
    hits = {(r["id"], r["item_id"]) for r in decontaminate.contaminations(docs, benchmark).collect()}
    assert hits == {(1, 0), (2, 0), (6, None)}


def test_stages_keep_columns(spark, docs, labels, benchmark):
    for out in (quality.good_documents(docs, labels), neardup.one_of_each(docs), decontaminate.without_contaminated(docs, benchmark), mixing.mixed_documents(docs)):
        assert out.columns == docs.columns
        out.collect()
    assert sorted(r["doc_id"] or 0 for r in neardup.one_of_each(docs).collect()) == [0, 1, 3, 4, 5, 6, 7, 8]
    assert sharding.interleave(docs, 4).columns == [*docs.columns, "shard", "slot"]


def test_rows_go_by_themselves(spark):
    """Null and repeated ids: what one row's text decides does not touch its namesakes."""
    bad, item, good = "beta gamma delta epsilon zeta", "one two three four five six seven", "the quiet river runs past the old stone mill every day"
    rows = [(None, item, "a"), (None, good, "a"), (1, item, "b"), (1, bad, "b"), (2, good, "c"), (2, good, "c"), (None, good, "d"), (None, bad, "e"), (None, bad, "e"), (3, "", "f"), (3, "", "f"), (None, None, "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    kept = [tuple(r) for r in decontaminate.without_contaminated(docs, spark.createDataFrame([(0, item)], "item_id long, text string")).collect()]
    assert sorted(kept, key=str) == sorted([r for r in rows if r[1] != item], key=str)
    kept = [tuple(r) for r in neardup.one_of_each(docs).collect()]
    assert sorted(kept, key=str) == sorted([(1, item, "b"), (1, bad, "b"), (2, good, "c"), (3, "", "f"), (3, "", "f"), (None, None, "g")], key=str)
    facts = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs).collect()}
    assert (None, 7, 2, False) in facts and (None, 3, 1, False) in facts and (None, 0, None, True) in facts
    alone = docs.filter("doc_id is null")
    assert sorted((r["text"] or "") for r in neardup.one_of_each(alone).collect()) == sorted(["", item, good, bad])
    labels = spark.createDataFrame([(k, k % 2) for k in range(100)], "doc_id long, quality int")
    learn = spark.createDataFrame([(k, ["!!! $$$ ||| 1 2 3", good][k % 2], "s") for k in range(100)], docs.schema)
    mixed = learn.unionByName(spark.createDataFrame([(None, "!!! $$$ ||| 1 2 3", "x"), (None, good, "x"), (1, "!!! $$$ ||| 1 2 3", "x")], docs.schema))
    kept = quality.good_documents(mixed, labels).collect()
    assert len(kept) == 51 and all(r["text"] == good for r in kept)


def test_empty_tables(spark, labels, benchmark):
    none = spark.createDataFrame([], DDL.format("extra string"))
    for name, df in results(spark, none, labels.limit(0), benchmark.limit(0)).items():
        assert df.count() == 0, name
    for out in (quality.good_documents(none, labels), neardup.one_of_each(none), decontaminate.without_contaminated(none, benchmark), mixing.mixed_documents(none)):
        assert out.count() == 0
    docs = spark.createDataFrame(ROWS, DDL.format("extra string"))
    assert decontaminate.contaminations(docs, benchmark.limit(0)).count() == 0
    assert {r["score"] for r in quality.quality_scores(docs, labels.limit(0)).collect()} == {0.5}


@pytest.mark.parametrize("most", [0, 1000])
def test_partitioning_does_not_matter(spark, monkeypatch, most):
    monkeypatch.setattr(sharding, "EQUAL_ROWS", most)
    docs = spark.createDataFrame(ROWS, DDL.format("extra string"))
    both = [sorted(map(str, sharding.interleave(d, 3).collect())) for d in (docs.coalesce(1), docs.repartition(5))]
    assert both[0] == both[1]
    with pytest.raises(ValueError):
        sharding.interleave(docs.withColumnRenamed("extra", "__il_x"), 3)


def test_near_copies_with_maps_anywhere(spark):
    """Rows that tie in id and text, with maps in structs and lists: one stays."""
    rows = [(1, ROWS[0][1], {"a": 1}, ({"b": 2},), [{"c": k}]) for k in range(3)] + [(2, "other words than those of the rest, all of them", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>, s struct<m: map<string,int>>, l array<map<string,int>>")
    assert sorted(r["doc_id"] for r in neardup.one_of_each(docs).collect()) == [1, 2]


def test_sharding_names_in_any_case(spark):
    docs = spark.createDataFrame([(k, f"t{k}", "s", k, k) for k in range(30)], "doc_id long, text string, source string, Shard int, SLOT int")
    placed = sharding.interleave(docs, 3)
    assert placed.columns == ["doc_id", "text", "source", "shard", "slot"] and {r["shard"] for r in placed.collect()} == {0, 1, 2}
    for name in ("__il_key", "__IL_key"):
        with pytest.raises(ValueError):
            sharding.interleave(docs.withColumn(name, F.lit(1)))
