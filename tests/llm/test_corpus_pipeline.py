import corpus_pipeline
from tapcast.llm import toxicity
from tapcast.session import materialize

from .cases import SF
from .test_decontamination import shingles
from .test_near_duplicates import brute as near_classes
from .test_repeats import brute as cut


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    rows = lambda df: {r.doc_id: r for r in df.collect()}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = rows(docs)
        docs = materialize(stage(spark, docs, SF))
        if name != "packing":
            after = rows(docs)
            assert docs.columns == names and len(after) == docs.count()
        if name == "toxicity":
            model = toxicity.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
            ids = sorted(before)
            score = model.score_batch([before[i].text.encode() for i in ids])
            assert set(after) == {i for i, s in zip(ids, score) if s < toxicity.CUT}
            assert all(after[i] == before[i] for i in after)
        if name == "near_duplicates":
            assert set(after) == {i for i, c in near_classes([(i, r.text) for i, r in sorted(before.items())]) if i == c}
        if name == "repeated_strings":
            assert set(after) == set(before)
            for i, n, removed, _, digest in cut((i, r.text.encode()) for i, r in sorted(before.items())):
                assert after[i].n_chars == len(after[i].text)
                if not removed:
                    assert after[i].text == before[i].text
        if name == "decontamination":
            leaks = {i for i, r in before.items() for t in items
                     if shingles(t) and len(shingles(t) & shingles(r.text)) >= 0.8 * len(shingles(t))}
            assert set(after) == set(before) - leaks
        if name == "packing":
            got = docs.collect()
            assert {r.doc_id for r in got} == set(before)
            assert sum(r.length for r in got) == sum({r.doc_id: r.doc_tokens for r in got}.values())


def test_run_gives_the_last_stage(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
