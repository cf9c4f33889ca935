"""The stages of the corpus pipeline against plain versions of their decisions."""

import random

import corpus_pipeline
from flowloom.llm.common import table


def corpus(spark, tmp_path):
    r = random.Random(9)
    words = [f"w{i}" for i in range(500)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    docs, labels = [], []
    for i in range(300):
        text = prose(80)
        if i % 6 == 0:
            text += " vile nasty awful horrid"
        labels.append((i, 1, int(i % 6 == 0)))
        docs.append((i, text))
    item = prose(30)
    passage = ". ".join(prose(20).capitalize() for _ in range(3)) + "."
    docs += [(1001, docs[1][1]), (1002, docs[2][1] + " end"), (1003, prose(40) + " " + item + " " + prose(40)), (1004, prose(50) + "\n" + passage), (1005, passage + "\n" + prose(50)), (1006, None), (1007, "")]
    spark.createDataFrame([(*d, "en", "s", len(d[1] or "")) for d in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return dict(docs), passage


def test_stages(spark, tmp_path):
    text, passage = corpus(spark, tmp_path)
    docs = table(spark, str(tmp_path), "documents")
    columns, seen = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        seen.append({r.doc_id: r for r in docs.collect()})
        assert k == 4 or docs.columns == columns
    toxic = {i for i in text if i < 300 and i % 6 == 0}
    assert set(seen[0]) == set(text) - toxic
    assert set(seen[1]) == set(seen[0]) - {1001, 1002}
    assert set(seen[2]) == set(seen[1])
    assert {i for i in seen[2] if seen[2][i].text != text[i]} == {1005} and passage not in seen[2][1005].text
    assert seen[2][1005].n_chars == len(seen[2][1005].text)
    assert set(seen[3]) == set(seen[2]) - {1003}
    assert set(seen[4]) == set(seen[3])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()
