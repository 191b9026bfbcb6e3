"""The pipeline over a table of its own: nulls, repeats, copies, a very long text, clashing columns, and no rows at all."""

import random

import corpus_pipeline
from tests.llm.test_tokens import expected

DOC = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG, row STRING, kept INT, root STRING, id LONG, node LONG, value DOUBLE"


def prose(rng, n):
    return " ".join(f"w{rng.randrange(3000)}" for _ in range(n))


def write(spark, folder, docs, items):
    spark.createDataFrame([(*d, len(d[1] or ""), "r", 1, "x", 2, 3, 0.5) for d in docs], DOC).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id LONG, text STRING").write.parquet(f"{folder}/benchmark.parquet")


def test_pipeline_of_odd_rows(spark, tmp_path):
    rng = random.Random(12)
    item = prose(rng, 25)
    docs = [(k, prose(rng, 150), "en", "a") for k in range(60)]
    docs += [(100, None, "en", "a"), (101, "", None, None), (102, "few words", "en", "a"), (103, prose(rng, 100) + " " + item + " " + prose(rng, 60), "en", "a"), (104, prose(rng, 60_000), None, "a")]
    docs += [docs[3], (105, docs[4][1], "en", None), (106, docs[5][1] + " one more", "en", "a")]
    write(spark, str(tmp_path), docs, [(1, item), (2, None), (3, "")])
    whole = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept, now = [], whole
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        now = stage(spark, now, str(tmp_path))
        assert now.columns == whole.columns
        now.write.parquet(f"{tmp_path}/stage{k}")
        now = spark.read.parquet(f"{tmp_path}/stage{k}")
        kept.append(sorted(r.doc_id for r in now.collect()))
    clean = set(range(60))
    assert not {100, 101, 102} & set(kept[0]) and clean <= set(kept[0]) and 104 in kept[0]
    assert kept[1] == sorted(set(kept[1])) and not {105, 106} & set(kept[1]) and clean <= set(kept[1])
    assert set(kept[1]) - set(kept[2]) == {103} and set(kept[3]) <= set(kept[2])
    final = [tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).orderBy("start").collect()]
    texts = {d[0]: d[1] for d in docs}
    assert [f[0] for f in final] == kept[3] and final == expected([(d, texts[d]) for d in kept[3]])


def test_pipeline_of_no_rows(spark, tmp_path):
    write(spark, str(tmp_path), [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
