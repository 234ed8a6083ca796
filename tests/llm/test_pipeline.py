"""The pipeline, stage by stage, against brute force; SQL twins."""

import sys
from collections import Counter

import duckdb

from sunder.llm import queries
from tests.conftest import DATA
from tests.llm.helpers import DOCS, corpus, same, words
from tests.llm.test_joins_and_lines import brute_components, brute_lines

import corpus_pipeline as pipeline


def test_stages(spark, tmp_path):
    rows = [r for r in corpus(6, 150) if r[1] is None or len(r[1]) < 8000]
    rows += [(5000 + k, " ".join(f"w{k}x{j}" for j in range(80)), "en", "a", 1) for k in range(20)]
    docs = spark.createDataFrame(rows, DOCS).withColumnRenamed("n_chars", "n_chars")
    frames = {}
    for name, stage in pipeline.STAGES:
        before = docs
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        frames[name] = (before.collect(), docs.collect())
        if name != "sentencepiece":
            assert docs.columns == list(pipeline.COLUMNS)
    before, after = frames["quality_rules"]
    assert {r.doc_id for r in before} >= {5000 + k for k in range(20)} and {5000 + k for k in range(20)} <= {r.doc_id for r in after}
    before, after = frames["line_dedup"]
    expected = brute_lines([tuple(r) for r in before], 50)
    assert {r.doc_id: r.text for r in after} == dict(zip((r.doc_id for r in before), expected, strict=True))
    before, after = frames["ngram_jaccard_join"]
    assert {r.doc_id for r in after} == {c for *_, c in brute_components([tuple(r) for r in before], pipeline.NEAR_WORDS, pipeline.NEAR_PERCENT)}
    before, after = frames["mix_sources"]
    times = Counter(r.doc_id for r in after)
    assert max(times.values()) <= 2 and all(r in before for r in after)
    total = sum(len(words(r.text)) for r in before)
    assert abs(sum(len(words(r.text)) for r in after) - 1.5 * total) <= 6 * max(len(words(r.text)) for r in before)
    before, after = frames["sentencepiece"]
    assert len(before) == len(after)


def test_repeated_and_null_ids(spark, tmp_path):
    """Unrelated texts that share an id, or have none, go through all stages."""
    text = lambda k: "\n".join(" ".join(f"w{k}x{n}y{j}" for j in range(12)) + "." for n in range(8))
    rows = [(k % 3 if k % 4 else None, text(k), "en", "abc"[k % 3], 1) for k in range(24)]
    rows += rows[:5] + [(None, text(1) + " more", "en", "a", 1)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 th", "2 kid", "3 carry")
    for name, stage in pipeline.STAGES[:3]:
        stage(spark, docs, "").write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    # Copies and repeated runs go, but no line is lost, and each is there once.
    lines = Counter(x for r in docs.collect() for x in r.text.split("\n") if words(x))
    assert set(lines) == {x for r in rows for x in r[1].split("\n")} and set(lines.values()) == {1}
    mixed = pipeline.mix(spark, docs, "")
    assert {r.text for r in mixed.collect()} <= {r.text for r in docs.collect()}
    assert pipeline.pieces(spark, mixed, "").count() == mixed.count()


def test_empty_and_nulls(spark, tmp_path):
    for rows in ([], [(None, None, None, None, None), (1, "", None, None, None)]):
        docs = spark.createDataFrame(rows, DOCS)
        for k, (_, stage) in enumerate(pipeline.STAGES):
            path = str(tmp_path / f"{len(rows)}-{k}")
            stage(spark, docs, "").write.parquet(path)
            docs = spark.read.parquet(path)


def test_run(spark):
    assert pipeline.run(spark, f"{DATA}/sf0.001").count() > 50


def test_sql_twins(spark):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/sf0.001/{t}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        ours = queries.QUERIES[name](spark, f"{DATA}/sf0.001")
        theirs = con.execute(sql)
        cols = [d[0] for d in theirs.description]
        assert sorted(cols) == sorted(ours.columns), name
        same([tuple(r) for r in ours.select(*cols).collect()], [tuple(r) for r in theirs.fetchall()])


def test_nothing_else_imports_these():
    import pathlib

    root = pathlib.Path(sys.modules["corpus_pipeline"].__file__).parent
    for p in (root / "sunder").rglob("*.py"):
        if "llm" not in p.parts:
            assert "sunder.llm" not in p.read_text()
