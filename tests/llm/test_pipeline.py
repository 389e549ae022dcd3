"""The pipeline's stages, each beside a plain Python version of what it decides."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from convoyspark.llm import queries, toxicity
from test_jaccard import brute
from test_text_operators import _texts

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(9)
    folder = tmp_path_factory.mktemp("tables")
    data = []
    for d, text, _ in _texts(300, 4):
        lines = [text[i : i + 90] for i in range(0, len(text), 90)]
        source = rng.choice(["a", "b", None])
        data.append((d, "\n".join((["shared head"] if source == "a" else []) + lines), "en", source, len(text)))
    data += [(400 + i, data[i][1] + " tail", "en", "b", 1) for i in range(0, 60, 4)] + [(500, None, None, None, None), (501, "", "en", "a", 0), (7, data[7][1], "en", data[7][3], data[7][4])]
    spark.createDataFrame(data, SCHEMA).repartition(3).write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame([(d, 1, y) for d, _, y in _texts(300, 4)], "doc_id bigint, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    return str(folder)


def test_stages(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    kept = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, tables).write.parquet(str(tmp_path / str(i)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(i)))
        kept[name] = (before.collect(), docs.collect())
        if i < 4:
            assert docs.columns == list(corpus_pipeline.COLUMNS)

    before, after = kept["toxicity"]
    model = toxicity.train(spark.read.parquet(f"{tables}/documents.parquet"), spark.read.parquet(f"{tables}/labels.parquet"))
    clean = [r for r in before if model.scores([r.text])[0] < 0.5]
    assert sorted(map(str, after)) == sorted(map(str, clean)) and len(after) < len(before)

    before, after = kept["line dedup"]
    pages = Counter(r.source for r in before)
    seen = Counter((r.source, x.strip(" ")) for r in before for x in set((r.text or "").split("\n")))
    bad = {k for k, n in seen.items() if n >= 5 and n > 0.05 * pages[k[0]] and k[1]}
    for r in before:
        lines = (r.text or "").split("\n")
        left = [x for x in lines if (r.source, x.strip(" ")) not in bad]
        want = None if r.text is None else "\n".join(left if any(x.strip(" ") for x in left) else lines)
        assert any(a.doc_id == r.doc_id and a.text == want and a.n_chars == (None if want is None else len(want)) for a in after)
    assert len(after) == len(before) and ("a", "shared head") in bad

    before, after = kept["near copies"]
    top = brute([(r.doc_id, r.text) for r in before])
    want = {d for d, n, c in top if n == 0 or d == c}
    assert sorted(r.doc_id for r in after) == sorted(want) and len(after) < len(before)

    before, after = kept["mixing"]
    times = Counter(r.doc_id for r in after)
    assert all(n <= 2 for n in times.values()) and {r.doc_id for r in after} <= {r.doc_id for r in before}
    words = lambda rows: sum(len((r.text or "").split()) for r in rows)
    assert abs(words(after) - 1.5 * words(before)) <= 0.05 * words(before)

    before, after = kept["packing"]
    assert Counter(r.doc_id for r in after if r.piece == 0) == Counter(r.doc_id for r in before)
    used = Counter()
    for r in after:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 2048 and len(used) <= 1.1 * sum(used.values()) / 2048 + 1


def test_pipeline_is_registered_and_handles_empty_tables(spark, tables, tmp_path):
    assert set(queries.QUERIES) >= {"pipeline"} and corpus_pipeline.ORACLE_SQL is None
    empty = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        empty = stage(spark, empty, tables)
        assert empty.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, empty, tables).count() == 0
