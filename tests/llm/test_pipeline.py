"""The corpus pipeline, stage by stage, and its registration."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from test_joins import plain_dedup, plain_join
from test_light import plain_hits


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    base = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(base / str(k))
        stage(spark, docs, sf).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def texts(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_registered():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()


def test_columns_stay(stages):
    for before, after in stages[:-1]:
        assert after.columns == before.columns


def test_toxicity_stage(stages):
    before, after = map(texts, stages[0])
    assert set(after) <= set(before)


def test_line_stage(stages):
    before, after = map(texts, stages[1])
    left = [(i, t) for i, t in plain_dedup(before) if t is None or t.strip() or (i, t) in before]
    assert after == left


def test_near_duplicate_stage(stages):
    before, after = map(texts, stages[2])
    _, groups = plain_join(before)
    assert set(after) <= set(before) and len(after) == groups


def test_benchmark_stage(spark, sf, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    before, after = (dict(texts(x)) for x in stages[3])
    assert set(after) == {i for i, t in before.items() if not plain_hits(t, items)[-1]}
    for i, t in after.items():
        assert t == before[i] or plain_hits(before[i], items)[1] > 0


def test_mix_stage(stages):
    docs, rows = stages[4]
    ids = {r.doc_id for r in docs.collect()}
    rows = rows.collect()
    assert {r.doc_id for r in rows} <= ids
    assert abs(sum(r["take"] for r in rows) - sum(len(r.text.split()) for r in docs.collect())) <= 20


def test_run_gives_the_last_stage(spark, sf, stages):
    assert sorted(map(str, corpus_pipeline.run(spark, sf).collect())) == sorted(map(str, stages[-1][1].collect()))


ODD = ("doc_id long, text string, lang string, source string, n_chars long, score double, predicted int, n_lines long, "
       "cls string, digest long, spans string, contaminated boolean, size long, _doc string, _order string, "
       "position double, _cls binary, KEY string")


def odd_rows():
    long = " ".join(f"word{i}" for i in range(30_000))
    texts = [None, "", " \n\t", "one", "a few words here", "A few words here!", long, long + " and more", "x" * 300_000,
             "same line of text\nsame line of text\nanother line here", "é" * 50 + " ß\n\n", None]
    return [(None if i == 10 else i, t, None, None if i % 3 else f"s{i}", None, 0.5, 7, None, "c", 1, f"span{i}", None, 3, "d", "o",
             None, None, "k") for i, t in enumerate(texts)] * 2


def test_stages_take_odd_tables(spark, sf):
    docs = spark.createDataFrame(odd_rows(), ODD)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), sf).count() == 0, name
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert {r.spans for r in rows} <= {r.spans for r in docs.collect()} and all(r.score == 0.5 and r.predicted == 7 for r in rows)
        if name in ("toxicity", "decontamination"):
            assert len(rows) == docs.count()
        if name == "line dedup":  # rows that repeat id and text count once; two texts lose their only line
            assert len(rows) == len({(r.doc_id, r.text) for r in docs.collect()}) - 2
        if name == "near duplicates":
            assert [r.text for r in rows].count(None) == 4 and sum("few" in (r.text or "") for r in rows) == 1
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert set(docs.columns) - {"size", "position"} <= set(mixed.columns)
    assert all(r["take"] > 0 and len(r.text.split()) == r["take"] for r in mixed.collect())
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), sf).count() == 0
