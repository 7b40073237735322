"""The stages one after another on a small table, each against what it should keep."""

import sys
from pathlib import Path

import pytest
from test_decontamination import brute
from test_near_duplicates import classes_by_hand

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline
from shotstream.llm import language, line_rules, pieces
from shotstream.llm.common import split_words, stored

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="given tables are absent")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, SF_DIR), name)
        rows = {r["doc_id"]: r for r in docs.collect()}
        kept = {r["doc_id"]: r for r in out.collect()}
        assert out.count() == len(kept) and kept.keys() <= rows.keys()
        if name != "pieces":
            assert out.columns == docs.columns and len(kept) > 0.6 * len(rows)
        if name == "language":
            assert all(language.letters(r["text"].encode()) for r in kept.values())
        if name == "quality":
            verdicts = {r["doc_id"]: r for r in line_rules.line_verdicts(docs).collect()}
            assert {i: r["text"] for i, r in kept.items()} == {
                i: r["clean_text"] for i, r in verdicts.items() if r["kept"]
            }
        if name == "near_dedup":
            ids = list(rows)
            assert set(kept) == set(classes_by_hand([rows[i]["text"] for i in ids], ids).values())
        if name == "decontamination":
            plain = {i: b" ".join(split_words(r["text"].encode())).decode() for i, r in rows.items()}
            benchmark = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()
            items = {r["item_id"]: b" ".join(split_words(r["text"].encode())).decode() for r in benchmark}
            assert set(kept) == set(rows) - {d for d, _ in brute(plain, items)}
        if name == "pieces":
            assert all(kept[i]["decoded"] == r["text"] for i, r in rows.items())
        docs = out


def test_run_equals_stages(spark):
    rows = corpus_pipeline.run(spark, SF_DIR)
    assert set(rows.columns) == {"doc_id", "ids", "n_pieces", "n_byte_pieces", "decoded"}


def test_stages_take_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF_DIR).count() == 0


def test_model_file_is_a_parameter(make, tmp_path):
    copy = tmp_path / "m.model"
    copy.write_bytes(Path(pieces.MODEL_FILE).read_bytes())
    assert pieces.encode_documents(make(["a b"]), str(copy)).first()["decoded"] == "a b"


def test_stages_take_odd_rows(spark, clashing):
    """Null, empty, repeated and very long rows with columns that have the operators' own names."""
    given = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    given = given.filter("doc_id < 60")
    english = given.filter("lang = 'en' AND length(text) > 2000").orderBy("doc_id").first()
    long_text = "\n".join(" ".join(f"the{i} of{j} and{i * j}" for j in range(20)) + "." for i in range(500))
    odd = [
        (9001, None, None, None, None),
        (9002, "", "en", "s", 0),
        (9003, "½ ² 123 …", None, "s", 9),
        (None, None, None, None, None),
        (9005, long_text, "en", "s", len(long_text)),
        (9006, "x" * 200_000, "en", "s", 200_000),
        tuple(english),
        tuple(english),
    ]
    docs = clashing(given.unionByName(spark.createDataFrame(odd, given.schema)))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stored(stage(spark, docs, SF_DIR), name)
        assert out.columns == docs.columns, name
        assert {tuple(r) for r in out.select("score", "kept", "node", "words", "n_words").distinct().collect()} == {("x",) * 5}
        docs = out
    ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and not {9001, 9002, 9003, 9006, None} & set(ids)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).count() == len(ids) > 0
