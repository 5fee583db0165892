import corpus_pipeline
from attestra.llm import decontaminate, near_duplicates, personal_data, quality_classifier


def test_stages_match_their_operators_one_by_one(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "benchmark"))
    kept = {r.doc_id: r for r in docs.collect()}
    good = {r.doc_id for r in quality_classifier.with_quality(docs, labels).where("predicted = 1").collect()}
    rest = docs.where(docs.doc_id.isin(list(good)))
    first = {r.doc_id for r in near_duplicates.near_duplicates(rest).where("doc_id = class_id").collect()}
    rest = rest.where(rest.doc_id.isin(list(first)))
    hits = {r.doc_id: r for r in decontaminate.decontaminate(rest, items).collect()}
    clean = {i for i, r in hits.items() if 2 * r.n_hit <= r.n_words}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert set(got) == clean and 0 < len(clean) < len(kept)
    assert len({(r.slot, r.place) for r in got.values()}) == len(got)
    found = {r.doc_id: r.spans for r in personal_data.with_personal_data(rest).collect()}
    for i, r in got.items():
        text = kept[i].text
        if not hits[i].n_hit and not any(x.kind != "context" for x in found[i]) and not found[i]:
            assert r.text == text
        for x in found[i]:
            if not hits[i].n_hit and x.kind != "context":
                assert text[x.start : x.end] not in r.text
    left = spark.createDataFrame([(r.doc_id, r.text) for r in got.values()], "doc_id long, text string")
    assert not [r for r in decontaminate.decontaminate(left, items).collect() if r.n_hit]


def test_columns_are_kept(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).schema.names == docs.schema.names


def test_odd_tables_pass_every_stage(spark, sf_dir):
    text = "one two three four five six seven eight nine ten, and a@b.co " + "x" * 30
    rows = [(1, text), (1, text), (2, None), (None, text), (3, ""), (4, "w " * 40_000), (None, None)]
    clash = ["spans", "row", "rest", "key", "a", "phases", "score", "predicted", "held_out", "hits", "n_words", "slot", "near__", "id_", "__x", "n_chars", "source"]
    docs = spark.createDataFrame([(*r, *("c" for _ in clash[:-2]), None, None) for r in rows], "doc_id long, text string, " + ", ".join(f"{c} string" for c in clash[:-2]) + ", n_chars long, source string")
    for name, stage in corpus_pipeline.STAGES:
        for table in (docs, docs.limit(0)):
            got = stage(spark, table, sf_dir)
            assert set(docs.columns) <= set(got.columns), name
            found = got.collect()
            assert all(r["key"] == "c" and (r["spans"] == "c") for r in found), name
            assert len(found) <= len(rows)
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, sf_dir).collect()]
    assert sorted(kept, key=repr) == sorted([(1, text), (2, None), (None, text), (3, ""), (4, "w " * 40_000), (None, None)], key=repr)
