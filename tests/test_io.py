import pytest
from conftest import rows_of

from lontar.plans.pipeline import Pipeline
from lontar.sources import readers, writers
from test_operators import glossary


def test_csv(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("﻿" + ",".join(readers.COLUMNS) + '\nIzin,"a ""b""\nc",L,,u,OK\nX,y\n', encoding="utf-8")
    got = readers.read_csv(spark, str(path)).collect()
    assert [r._raw_row_number for r in got] == [2, 3]
    assert got[0].pengertian == 'a "b"\nc' and got[1].status == ""
    path.write_text("a,b\n1,2\n", encoding="utf-8")
    with pytest.raises(ValueError, match="unexpected CSV columns"):
        readers.read_csv(spark, str(path))
    path.write_text(",".join(readers.COLUMNS) + "\n1,2,3,4,5,6,7\n", encoding="utf-8")
    with pytest.raises(Exception, match="extra values"):
        readers.read_csv(spark, str(path)).collect()


def test_splits_and_contracts(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "data" / "train-0.parquet"))
    spark.range(4).write.parquet(str(tmp_path / "data" / "train-1.parquet"))
    rows = readers.read_split(spark, str(tmp_path), "train")
    assert rows.count() == 7 and readers.read_split(spark, str(tmp_path), "train", first_only=True).count() == 3
    assert readers.split_counts(spark, str(tmp_path), ["train"]) == {"train": 7}
    readers.require_counts(rows, {"train": 7})
    with pytest.raises(ValueError):
        readers.require_counts(rows, {"train": 8})
    with pytest.raises(ValueError, match="missing"):
        readers.require_columns(rows, ["id", "x"], "rows")
    with pytest.raises(FileNotFoundError):
        readers.split_files(spark, str(tmp_path), "test")


def test_jsonl_and_cases(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"a": 1}\n\n{"a": 2}\n', encoding="utf-8")
    assert rows_of(readers.read_jsonl(spark, str(path), "a int")) == [(1,), (2,)]
    path.write_text("[1]\n", encoding="utf-8")
    with pytest.raises(Exception, match="no object"):
        readers.read_jsonl(spark, str(path), "a int").collect()
    path.write_text('{"question": "q", "answer": "x"}\n', encoding="utf-8")
    assert rows_of(readers.read_cases(spark, str(path))) == [("", "q", "x")]
    path.write_text('{"question": "", "answer": "x"}\n', encoding="utf-8")
    with pytest.raises(Exception, match="without a prompt"):
        readers.read_cases(spark, str(path)).collect()


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a", 'x "y"', float("nan")), ("b", None, 1.0)], "k string, v string, d double")
    writers.write_csv(df, str(tmp_path / "c"), ["k", "v"], single=True)
    assert rows_of(spark.read.csv(str(tmp_path / "c"), header=True, escape='"')) == [("a", 'x "y"'), ("b", None)]
    writers.write_jsonl(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).where("d is null").count() == 1
    assert writers.content_hash(df) == writers.content_hash(df.repartition(3)) != writers.content_hash(df.union(df))
    assert writers.upsert([{"i": 1, "x": 1}, {"i": 2}], {"i": 1, "y": 2}, "i") == [{"i": 1, "x": 1, "y": 2}, {"i": 2}]
    writers.write_json(str(tmp_path / "m.json"), {"b": 1, "a": 2})
    assert (tmp_path / "m.json").read_text().endswith("}\n")


def test_pinned_and_unchanged_files(tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("x", encoding="utf-8")
    digest = readers.sha256_file(str(path))
    assert readers.require_snapshot(str(path), 1, digest) == str(path)
    for size, sha in ((2, digest), (1, "0" * 64)):
        with pytest.raises(ValueError, match="pinned"):
            readers.require_snapshot(str(path), size, sha)
    with readers.unchanged(str(path)):
        pass
    with pytest.raises(ValueError, match="was changed"), readers.unchanged(str(path)):
        path.write_text("y", encoding="utf-8")


def test_config_and_reports(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text('{"seed": "s", "target_count": 3, "quotas": {"a": 1, "b": 2}}', encoding="utf-8")
    assert readers.read_config(str(path), ["seed"])["quotas"] == {"a": 1, "b": 2}
    with pytest.raises(ValueError, match="missing fields"):
        readers.read_config(str(path), ["seed", "cap"])
    path.write_text('{"target_count": 4, "quotas": {"a": 1, "b": 2}}', encoding="utf-8")
    with pytest.raises(ValueError, match="add up"):
        readers.read_config(str(path), [])
    assert writers.portable(str(tmp_path / "x" / "y"), str(tmp_path)) == "x/y" and writers.portable("/elsewhere/z", str(tmp_path)) == "z"
    assert writers.counts_report("Audit", {"Status": {"ok": 1200, "": 3, "share": "4.0 %"}}) == "# Audit\n\n## Status\n\n- ok: 1,200\n- (missing): 3\n- share: 4.0 %\n"
    df = spark.createDataFrame([("a", "1"), ("b", "2")], "k string, v string")
    writers.write_review_csv(df, str(tmp_path / "r"), ["k"], ["decision"])
    assert spark.read.csv(str(tmp_path / "r"), header=True).columns == ["k", "decision"]
    changed = spark.createDataFrame([("b", "3"), ("c", "4")], "k string, v string")
    assert rows_of(writers.upsert_rows(df, changed, "k")) == [("a", "1"), ("b", "3"), ("c", "4")]


def test_pipeline_resumes_and_refuses(spark, tmp_path):
    p = Pipeline(spark, str(tmp_path))
    raw = glossary(spark)
    assert p.status()["next"] == "audit"
    first = p.audit(raw)
    assert p.audit(raw) == first
    p.select({"typical_fill": 1})
    assert p.read("pilot").count() == 1 and p.status()["next"] == "enrich"
    with pytest.raises(RuntimeError, match="changed"):
        p.audit(raw.limit(1))


def test_stream_dedupe(spark, tmp_path):
    from lontar.streaming.dedupe import first_of_key

    spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, n int").selectExpr("k", "n", "timestamp_seconds(n) as t").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, n int, t timestamp").parquet(str(tmp_path / "in"))
    q = first_of_key(stream, ["k"], "t").writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert [r.k for r in spark.sql("select k from firsts order by k").collect()] == ["a", "b"]
