"""The stages of the pipeline on planted documents."""

import random

import corpus_pipeline
from postlens.llm.common import materialize
from test_stages import fingerprint


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(9)
    stock = ["".join(rng.choice("aeioudrtlns") for _ in range(rng.randint(3, 8))) for _ in range(3000)]
    prose = lambda n: " ".join(rng.choice(stock) for _ in range(n))
    clean = {i: prose(rng.randint(60, 300)) for i in range(40)}
    passage, item = prose(90), prose(25)
    docs = dict(clean)
    docs[100] = clean[0]  # an exact copy
    docs[101] = clean[1] + " tail"  # a near copy: few bits apart, by the contract's fingerprints
    docs[102] = "%%% " * 80  # junk
    docs[103] = "short"
    docs[104], docs[105] = prose(80) + " " + passage, prose(80) + " " + passage
    docs[106] = prose(60) + " " + item + " " + prose(60)
    rows = [(i, t, "en", "s", len(t)) for i, t in docs.items()] + [(None, prose(70), None, None, None), (107, None, "en", "s", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids = []
    for name, stage in corpus_pipeline.STAGES:
        now = materialize(stage(spark, now, str(tmp_path)), f"test-{name}")
        ids.append({r["doc_id"] for r in now.select("doc_id").collect()})
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert sorted(now.columns) == sorted(["doc_id", "text", "lang", "source", "n_chars"])
    assert ids[0] == {*docs, None} - {102, 103, 107}
    near = (fingerprint(docs[101]) ^ fingerprint(clean[1])).bit_count() <= 3
    assert ids[0] - ids[1] == ({100, 101} if near else {100})
    assert ids[2] == ids[1] and ids[3] == ids[2] - {106} and ids[4] == ids[3]
    texts = {r["doc_id"]: r for r in now.collect()}
    assert passage not in texts[104]["text"] and passage not in texts[105]["text"]
    assert all(texts[i]["text"] == t for i, t in clean.items() if i > 1)
    assert all(r["ids"][-1] == 2 and len(r["ids"]) == r["n_tokens"] for r in texts.values())
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in run.collect()} == ids[4]
