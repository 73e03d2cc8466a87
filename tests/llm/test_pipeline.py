import itertools
import os
import re

import pytest

import corpus_pipeline
from gleaner.llm import language, quality

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, kept = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stash(stage(spark, docs, DATA), name)
        kept.append(docs.count())
        if name != "mix":
            assert docs.columns == columns
            assert docs.select("doc_id").distinct().count() == kept[-1]
    assert kept[0] >= kept[1] > kept[2] > kept[3] > kept[4] == kept[5] > 100
    assert docs.selectExpr("sum(taken) > 0.9 * sum(size)").first()[0]


def test_stages_against_plain_versions(spark):
    """Ids that each stage keeps, from texts in plain Python and from the models' own judgements of single rows."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels, items = spark.read.parquet(f"{DATA}/labels.parquet"), spark.read.parquet(f"{DATA}/benchmark.parquet").collect()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        told = {r.doc_id: r.text for r in docs.collect()}
        if name == "language":
            judged = language.predict(docs, language.train(docs)).collect()
            want = {r.doc_id for r in judged if not r.rejected}
        elif name == "quality":
            want = {r.doc_id for r in quality.classify(docs, quality.train(docs, labels), labels=labels).collect() if r.quality >= 0.5}
        elif name == "near_duplicates":
            sets = {i: plain_shingles(t) for i, t in told.items()}
            first = {i: i for i in told}
            for a, b in itertools.combinations(sorted(told), 2):
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 80 * len(sets[a] | sets[b]) and first[a] != first[b]:
                    low, high = sorted((first[a], first[b]))
                    first = {i: low if x == high else x for i, x in first.items()}
            want = {i for i in told if first[i] == i}
        else:
            windows = {g for r in items for g in plain_windows(r.text)}
            want = {i for i, t in told.items() if not any(g in windows for k in range(1, 11) for g in plain_windows(t, k))}
        docs = corpus_pipeline.stash(stage(spark, docs, DATA), name)
        assert {r.doc_id for r in docs.collect()} == want, name
    sizes = {r.doc_id: (r.source, len([w for w in re.split(r"[\x20\x09-\x0d]+", r.text or "") if w])) for r in docs.collect()}
    mixed = corpus_pipeline.mix_sources(spark, docs, DATA).collect()
    assert {r.doc_id: r.size for r in mixed} == {i: n for i, (_, n) in sizes.items()}
    assert all(0 <= r.taken <= 3 * r.size for r in mixed)
    assert all(r.source_size == sum(n for s, n in sizes.values() if s == sizes[r.doc_id][0]) for r in mixed)


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain_shingles(text):
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", lowered(text)) if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_windows(text, k=10):
    words = [w for w in re.split(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered(text)) if w]
    k = min(k, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def test_queries_can_be_listed():
    from gleaner.llm import queries

    assert {f"op{n}" for n in range(1, 11)} == {k.split("_")[0] for k in queries.QUERIES}


def test_stages_on_awkward_rows(spark, tmp_path):
    """Null and empty texts go, null ids stay where they may, repeated rows go or stay together; names of columns may clash."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = [(None, "The quick words of this text are told to all the others of the house.", "en", "src1", 10), (910_001, None, None, None, 0), (910_002, "", "en", "src1", 0), (910_002, "", "en", "src1", 0)]
    rows = docs.unionByName(docs.limit(3)).unionByName(spark.createDataFrame(odd, docs.schema)).withColumn("gone", docs["lang"]).withColumn("root", docs["doc_id"])
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{DATA}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before, empty = rows, rows.limit(0)
        rows = corpus_pipeline.stash(stage(spark, rows, str(tmp_path)), name)
        if name != "mix":
            assert rows.columns == before.columns and rows.exceptAll(before).count() == 0
            # what a stage drops is all rows of an id or, of near duplicates, all but one
            assert name == "near_duplicates" or rows.join(before.exceptAll(rows), "doc_id").count() == 0
        else:
            assert rows.count() == before.count()
        assert stage(spark, empty, str(tmp_path)).count() == 0
    assert rows.filter("doc_id >= 910000").count() == 0 and rows.groupBy("doc_id").count().filter("count > 1").count() == 0
