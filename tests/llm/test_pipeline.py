"""The pipeline on a small corpus with planted cases, each stage against what it must do."""

import random

import corpus_pipeline
from tests.llm.conftest import DOCS
from tests.llm.test_classifiers import LABELS
from tests.llm.test_decontamination import ITEMS, shingles
from tests.llm.test_passages import words


def test_planted_cases(spark, tmp_path):
    rnd = random.Random(11)
    docs, labels, clean = [], [], []
    passage, item = words(rnd, 70), words(rnd, 25)
    toxic_words = ["grumbor", "zorkly", "vexpat"]
    for i in range(400):
        w = words(rnd, 60).split()
        kind = ("toxic", "copy", "near", "passage", "leak", "clean", "clean", "clean")[i % 8]
        if kind == "toxic":
            for t in toxic_words:
                w.insert(rnd.randrange(len(w)), t)
        elif kind in ("copy", "near") and i > 7:
            w = docs[1][1].split()
            if kind == "near":
                w[30] = f"edit{i}"
        elif kind == "passage":
            w[20:20] = passage.split()
        elif kind == "leak":
            w[10:10] = item.split()
        else:
            clean.append(i)
        docs.append((i, " ".join(w), "en", "s", None))
        labels.append((i, 1, int(kind == "toxic")))
    docs += [(1000, None, None, None, None), (1001, "", "en", "s", 0)]
    for name, rows, schema in (("documents", docs, DOCS), ("labels", labels, LABELS), ("benchmark", [(1, item), (2, None)], ITEMS)):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/out-{name}")
        now = spark.read.parquet(f"{tmp_path}/out-{name}")
        seen[name] = {r.doc_id: r for r in now.collect()}
        if name != "byte_pairs":
            assert now.columns == corpus_pipeline.COLUMNS
    ids = {name: set(rows) for name, rows in seen.items()}
    texts = {d: t for d, t, *_ in docs}
    assert ids["toxicity"] == set(texts) - set(range(0, 400, 8))
    # of the copies and near copies of document 1 the document itself stays
    assert ids["near_duplicates"] == ids["toxicity"] - {i for i in range(8, 400) if i % 8 in (1, 2)}
    assert ids["repeated_passages"] == ids["near_duplicates"]
    assert [d for d in sorted(ids["repeated_passages"]) if passage in (seen["repeated_passages"][d].text or "")] == [3]
    assert all(seen["repeated_passages"][i].text == texts[i] for i in clean if i in ids["repeated_passages"])
    # the first leak holds the item and goes; a later one goes too, unless the item was cut out as a repeated passage
    gone, wanted = ids["repeated_passages"] - ids["decontamination"], shingles(item, 5)
    assert 4 in gone and all(d % 8 == 4 for d in gone)
    assert all(len(wanted & shingles(r.text or "", 5)) < 0.8 * len(wanted) for r in seen["decontamination"].values())
    assert all(seen["byte_pairs"][d].text == (seen["decontamination"][d].text or "") and 4 * seen["byte_pairs"][d].n_tokens == len(seen["byte_pairs"][d].ids) for d in ids["decontamination"])
    assert ids["byte_pairs"] == ids["decontamination"] >= {i for i in clean if i % 8 >= 5}
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == ids["byte_pairs"]
