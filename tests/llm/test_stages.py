"""Stages of the pipeline on near copies, repeated ids, odd columns and short passages, against brute force."""

import random
import re

import corpus_pipeline
import pyarrow as pa
import pytest
import xxhash
from postlens.llm import common

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return ["".join(rng.choice("aeioudrtlns") for _ in range(rng.randint(3, 8))) for _ in range(n)]


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)


def stage(name, spark, df):
    return dict(corpus_pipeline.STAGES)[name](spark, df, "").collect()


def fingerprint(text):
    """Majority bits of the XXH64 of all three-word shingles; 0 without words."""
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def plain_keep_one(rows):
    """The rows that stay: of those linked over at most three bits each, the smallest id, none last, then the first."""
    prints = [fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(i):
                if (prints[i] ^ prints[j]).bit_count() <= 3:
                    group[i] = group[j] = min(group[i], group[j])
    heads = {}
    for i, (doc, _) in enumerate(rows):
        key = (doc is None, doc or 0, i)
        heads[group[i]] = min(heads.get(group[i], key), key)
    return sorted((rows[k[2]] for k in heads.values()), key=repr)


def test_near_copies_are_linked_by_fingerprints(spark):
    rng = random.Random(11)
    line = " ".join(prose(rng, 12))
    texts = [" ".join(prose(rng, rng.randint(50, 300))) + " " + line for _ in range(40)]
    for k in range(40):
        words = texts[k].split()
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = prose(rng, 1)[0]
        texts.append(" ".join(words))
    rows = list(enumerate(texts))
    kept = stage("simhash_near_dedup", spark, docs_of(spark, rows))
    want = plain_keep_one(rows)
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=repr) == want and 40 <= len(want) < 75


def test_rows_of_one_id_are_rows_of_their_own(spark):
    rng = random.Random(12)
    one, two, three = (" ".join(prose(rng, 300)) for _ in range(3))
    rows = [(None, one), (7, one), (7, one), (3, two), (3, three), (None, three), (9, ""), (8, " \n"), (None, "x y")]
    kept = stage("simhash_near_dedup", spark, docs_of(spark, rows))
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=repr) == plain_keep_one(rows)
    without_id = stage("simhash_near_dedup", spark, docs_of(spark, [(None, one)] * 3))
    assert [(r["doc_id"], r["text"]) for r in without_id] == [(None, one)]
    whole = stage("suffix_array_dedup", spark, docs_of(spark, [(r["doc_id"], r["text"]) for r in kept]))
    assert {one, two, three} <= {r["text"] for r in whole}


NAMES = "doc_id long, text string, r string, doc string, _row string, key string, row string, n_chars long"


def test_columns_of_any_name_come_back(spark, tmp_path):
    rng = random.Random(15)
    texts = [" ".join(prose(rng, 80)) for _ in range(6)]
    rows = [(i, t, f"r{i}", "d", f"mine{i}", "k", "w", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame([(1, "no such words here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, work in corpus_pipeline.STAGES[:-1]:
        df = spark.createDataFrame(rows, NAMES)
        got = work(spark, df, str(tmp_path))
        assert got.columns == df.columns and sorted(map(tuple, got.collect())) == rows, name
    got = corpus_pipeline.STAGES[-1][1](spark, spark.createDataFrame(rows, NAMES), str(tmp_path)).drop("ids", "n_tokens")
    assert sorted(map(tuple, got.select(*df.columns).collect())) == rows


def test_empty_tables_and_rows_of_nulls(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows, left in (([], [0, 0, 0, 0, 0]), ([(None, None, None, None, None)] * 3, [0, 1, 3, 3, 3])):
        for (name, work), n in zip(corpus_pipeline.STAGES, left):
            assert work(spark, spark.createDataFrame(rows, SCHEMA), str(tmp_path)).count() == n, name


def test_contaminated_rows_go_and_no_others(spark, tmp_path):
    rng = random.Random(13)
    item, *clean = (" ".join(prose(rng, n)) for n in (25, 60, 60, 60))
    rows = [(1, clean[0] + " " + item), (1, clean[1]), (None, item + " " + clean[2]), (None, clean[2]), (2, clean[0])]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = corpus_pipeline.benchmark_decontamination(spark, docs_of(spark, rows), str(tmp_path))
    assert {(r["doc_id"], r["text"]) for r in left.collect()} == {rows[1], rows[3], rows[4]} and left.columns == docs_of(spark, rows).columns


def test_passages_of_over_50_words_are_cut(spark):
    rng = random.Random(14)
    short = lambda n: ["".join(rng.choice("aeioudrtlnsé") for _ in range(rng.randint(1, 5))) for _ in range(n)]
    rows, want = [], {}
    for i, n in enumerate([40, 50, 51, 52, 58, 65]):
        passage = short(n)
        assert len(" ".join(passage).encode()) < 400
        for k in range(2):
            before, after = prose(rng, 30 + k), prose(rng, 40)
            rows.append((2 * i + k, " ".join(before) + "\n" + ["  ", " "][k].join(passage) + " " + " ".join(after)))
            want[2 * i + k] = before + (passage if n < 51 else []) + after
    rows += [(100, " ".join(["so"] * 60)), (101, " ".join(["na"] * 51))]
    want |= {100: [], 101: ["na"] * 51}
    got = {r["doc_id"]: r["text"] for r in stage("suffix_array_dedup", spark, docs_of(spark, rows))}
    assert {i: t.split() for i, t in got.items()} == want
    assert all(got[i] == t for i, t in rows if i < 4)


@pytest.mark.parametrize("name", ["simhash_near_dedup", "suffix_array_dedup", "sentencepiece_ids"])
def test_batches_are_bounded_and_change_nothing(spark, name):
    """Texts go to Python a few megabytes at a time, and rows come out the same one by one."""
    rng = random.Random(12)
    passage = " ".join(prose(rng, 70))
    texts = [" ".join(prose(rng, 60)) for _ in range(6)]
    docs = docs_of(spark, [(i, t) for i, t in enumerate([*texts, texts[0], f"{texts[1]} {passage}", f"{passage} {texts[2]}", ""])])
    long = spark.range(0, 3000, 1, 1).selectExpr("repeat('ab ', 1000) AS text")

    def count(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    try:
        spark.conf.unset(common.BATCH_SETTING)
        whole = sorted(map(repr, stage(name, spark, docs)))
        sizes = [r["n"] for r in long.mapInArrow(count, "n long").collect()]
        assert sum(sizes) == 3000 and max(sizes) * 3000 <= common.BATCH_BYTES + (1 << 16)
        spark.conf.set(common.BATCH_SETTING, "1")  # a batch per row; a session's own setting stays
        assert sorted(map(repr, stage(name, spark, docs))) == whole
        assert spark.conf.get(common.BATCH_SETTING).rstrip("b") == "1"
    finally:
        spark.conf.unset(common.BATCH_SETTING)
