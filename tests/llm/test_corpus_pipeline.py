"""The stages one after another over small tables with planted cases, each against what it should decide."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from weftline.llm.base import cut


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    word = lambda: f"{rng.choice('bcdfghklmn')}{rng.choice('aeiou')}{rng.randint(0, 500)}"
    prose = lambda n: [word() for _ in range(n)]
    items = [(k, " ".join(prose(30))) for k in range(4)]
    docs, toxic, about = {}, set(), {}
    for k in range(300):
        ws = prose(rng.randint(5, 120))
        if k % 9 == 0:
            for _ in range(2):
                ws[rng.randrange(len(ws))] = rng.choice(["vile", "foul"])
            toxic.add(k)
        docs[k] = " ".join(ws)
        about[k] = int(k in toxic)
    copies = {300: 1, 301: 1, 302: 7}
    docs |= {k: docs[v] for k, v in copies.items()}
    near = {}
    for k, v in ((310, 2), (311, 2), (312, 10)):
        docs[v] = " ".join(prose(300)) if v not in near.values() else docs[v]
        ws = docs[v].split(" ")
        ws[5] = f"edit{k}"
        docs[k] = " ".join(ws)
        near[k] = v
    leaked = {320: 0, 321: 3}
    for k, v in leaked.items():
        docs[k] = " ".join([*prose(20), items[v][1], *prose(20)])
    docs |= {330: None, 331: ""}
    out = str(tmp_path_factory.mktemp("sf"))
    rows = [(k, t, "en", "src", None if t is None else len(t)) for k, t in docs.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(k, 1, v) for k, v in about.items()], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out, docs, toxic, copies, near, leaked


def test_stages(spark, folder):
    path, docs, toxic, copies, near, leaked = folder
    df = spark.read.parquet(f"{path}/documents.parquet")
    columns, left = df.columns, set(docs)
    gone = [toxic, {1, 300, 7, 330}, set(near), set(leaked)]
    for (name, stage), out in zip(corpus_pipeline.STAGES[:4], gone):
        df = cut(stage(spark, df, path))
        left -= out
        assert df.columns == columns, name
        assert Counter(r.doc_id for r in df.collect()) == Counter(left), name
    pieces = corpus_pipeline.STAGES[4][1](spark, df, path).collect()
    assert {r.doc_id for r in pieces} == left
    got = corpus_pipeline.run(spark, path)
    assert {r.doc_id for r in got.collect()} == left and sum(r.length for r in got.collect()) == sum(r.length for r in pieces)


def test_no_documents(spark, folder, tmp_path):
    path = folder[0]
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "SimHash near-dedup", "benchmark decontamination", "packing"]
