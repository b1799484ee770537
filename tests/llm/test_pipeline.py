"""The pipeline's stages against brute force on their own inputs."""

import hashlib

import corpus_pipeline as pipeline
from tessera.llm import decontam, quality
from tessera.llm.queries import MIX
from tests.llm.scans import reference_scan
from tests.llm.test_operators import ODD, reference_components, reference_lines, reference_mix


def stage(name):
    return dict(pipeline.STAGES)[name]


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}

    first = stage("quality classifier")(spark, docs, sf_dir)
    assert first.columns == pipeline.COLUMNS
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels)
    scores = dict(zip(rows, model.score(model.machine(), [r.text.encode() for r in rows.values()]), strict=True))
    kept = sorted(first.collect())
    assert [r.doc_id for r in kept] == sorted(i for i, s in scores.items() if s >= 0.7)
    assert all(r == rows[r.doc_id] for r in kept)

    second = stage("line dedup")(spark, first, sf_dir)
    assert second.columns == pipeline.COLUMNS
    after = sorted(second.collect())
    want = {i: d for i, _, _, d in reference_lines([(r.doc_id, r.text) for r in kept])}
    assert {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in after} == want
    assert all(r.n_chars == len(r.text) for r in after)

    third = stage("n-gram Jaccard join")(spark, second, sf_dir)
    assert third.columns == pipeline.COLUMNS
    groups = reference_components([(r.doc_id, r.text) for r in after], 5, 80, 100)
    left = sorted(third.collect())
    assert [r.doc_id for r in left] == sorted(i for i, _, c in groups if i == c)

    fourth = stage("benchmark decontamination")(spark, third, sf_dir)
    assert fourth.columns == pipeline.COLUMNS
    clean = sorted(fourth.collect())
    items = [(str(r.item_id), r.text.encode()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    before = reference_scan([r.text.encode() for r in left], items, 10)
    assert [r.doc_id for r in clean] == [r.doc_id for r in left]
    assert all(len(decontam.words_of(c.text.encode())) == n - hit and (hit or c.text == r.text) for c, r, (n, hit, _) in zip(clean, left, before, strict=True))
    assert all(not hit for _, hit, _ in reference_scan([r.text.encode() for r in clean], items, 10))

    fifth = stage("mixing sources to target weights")(spark, fourth, sf_dir)

    def kind(source):
        return "web" if source[-1] in "0123" else "books" if source[-1] in "456" else "forums"

    assert sorted(map(tuple, fifth.collect()), key=str) == reference_mix([(r.doc_id, (kind(r.source), r.lang, r.source), len(r.text.encode().split())) for r in clean], MIX)


def test_run_keeps_odd_rows(spark, sf_dir, tmp_path):
    rows = [(i, t, "en", "src1", len(t or "")) for i, t in ODD]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, f in pipeline.STAGES:
        odd = f(spark, odd, sf_dir)
    assert odd.count() > 0


def test_run_on_empty_documents(spark, sf_dir):
    d = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, f in pipeline.STAGES:
        d = f(spark, d, sf_dir)
    assert d.count() == 0


def test_run(spark, sf_dir):
    assert pipeline.run(spark, sf_dir).count() > 0
