"""The manifest sink under kills and replays, and deletions by a list."""

import gzip
import os

import pytest
from pyspark.sql import functions as F

from kifu_spark.operators import deletion
from kifu_spark.sources.manifest import ManifestSink

SCHEMA = "path string, n_moves int"


def rows(spark, *names):
    return spark.createDataFrame([(n, len(n)) for n in names], SCHEMA)


def listed(sink):
    return sorted(r.value.path for r in sink.read(SCHEMA).collect())


def test_batches_count_once(spark, tmp_path):
    sink = ManifestSink(spark, str(tmp_path / "m"))
    assert listed(sink) == [] and sink.committed() == {}
    assert sink.append(0, rows(spark, "a", "b")) and sink.append(1, rows(spark, "c"))
    assert not sink.append(0, rows(spark, "a", "b"))  # a stream repeats its last batch
    assert not sink._commit(1, sink._staged(rows(spark, "x"), 1))  # two runs at once: the second one loses
    assert listed(sink) == ["a", "b", "c"] and sorted(sink.committed()) == [0, 1]
    assert not [n for n in os.listdir(tmp_path / "m" / "commits") if n.startswith(".") and not n.endswith(".crc")]


def test_killed_between_two_writes_and_resumed(spark, tmp_path, monkeypatch):
    sink = ManifestSink(spark, str(tmp_path / "m"))
    records = rows(spark, *"abcdefg").select("path")
    scan = lambda df: df.withColumn("n_moves", F.lit(7))
    assert sink.resume(records.filter("path < 'c'"), scan, SCHEMA)

    def killed(self, number, folder):
        raise KeyboardInterrupt

    with monkeypatch.context() as patched:
        patched.setattr(ManifestSink, "_commit", killed)
        with pytest.raises(KeyboardInterrupt):
            sink.resume(records, scan, SCHEMA)
    assert listed(sink) == ["a", "b"]
    again = ManifestSink(spark, str(tmp_path / "m"))
    assert again.resume(records, scan, SCHEMA) and not again.resume(records, scan, SCHEMA)
    assert listed(again) == list("abcdefg")


def test_cut_off_lines_are_scanned_again(spark, tmp_path):
    sink = ManifestSink(spark, str(tmp_path / "m"))
    sink.append(0, rows(spark, "a", "b").coalesce(1))
    (folder,) = sink.committed().values()
    (part,) = (tmp_path / "m" / "rows" / folder).glob("*.gz")
    whole = gzip.decompress(part.read_bytes())
    part.with_name(f".{part.name}.crc").unlink()
    part.write_bytes(gzip.compress(whole[:-9]))
    assert sink.resume(rows(spark, "a", "b", "c").select("path"), lambda df: df.withColumn("n_moves", F.lit(1)), SCHEMA)
    found = [r.value.path for r in sink.read(SCHEMA).filter("not damaged").collect()]
    assert sorted(found) == ["a", "b", "c"]


def test_stream_into_the_sink(spark, tmp_path):
    sink = ManifestSink(spark, str(tmp_path / "m"))
    rows(spark, *"abcdef").repartition(3).write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run has another checkpoint, so it repeats every batch
        source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = source.writeStream.foreachBatch(lambda batch, number: sink.append(number, batch) and None).option("checkpointLocation", str(tmp_path / f"c{_}"))
        query.trigger(availableNow=True).start().awaitTermination()
    assert listed(sink) == list("abcdef")


@pytest.fixture
def folder(tmp_path):
    for name, text in {"kept": "same", "copy": "same", "changed": "other", "bad": "x", "twin": "same", "loose": "same"}.items():
        (tmp_path / name).write_text(text)
    (tmp_path / "held").mkdir()  # cannot be removed as a file
    return tmp_path


def plan(spark, folder):
    at = lambda n: n and str(folder / n)
    lines = [("copy", "duplicate", "kept"), ("changed", "duplicate", "kept"), ("bad", "empty", None), ("gone", "empty", None), ("held", "empty", None), ("twin", "duplicate", "bad"), ("loose", "duplicate", None)]
    return spark.createDataFrame([(at(n), r, at(k)) for n, r, k in lines], deletion.DELETE_LIST)


EXPECTED = {"copy": "deleted", "changed": "skipped", "bad": "deleted", "gone": "already gone", "held": "failed", "twin": "skipped", "loose": "skipped"}


def test_deletions_are_guarded_logged_and_repeatable(spark, folder, tmp_path):
    deletion.write_delete_list(plan(spark, folder), str(tmp_path / "lists"))
    listed = deletion.read_delete_list(spark, str(tmp_path / "lists"))
    outcome = lambda df: {os.path.basename(r.path): r.outcome for r in df.collect()}
    dry = deletion.guarded_delete(listed, str(tmp_path / "dry"))
    assert outcome(dry) == {n: "would delete" if o == "deleted" else o for n, o in EXPECTED.items()}
    assert (folder / "copy").exists() and (folder / "bad").exists()
    first = deletion.guarded_delete(listed, str(tmp_path / "first"), dry=False)
    assert outcome(first) == EXPECTED and outcome(first) == EXPECTED  # reading the log deletes nothing more
    assert sorted(p.name for p in folder.iterdir() if p.is_file()) == ["changed", "kept", "loose", "twin"]
    counts = {r.outcome: (r.files, r.bytes) for r in deletion.summary(first).collect()}
    assert counts["deleted"] == (2, 5) and counts["skipped"] == (3, 0)
    assert "kept copy" in {os.path.basename(r.path): r.detail for r in first.collect()}["twin"]
    again = outcome(deletion.guarded_delete(listed, str(tmp_path / "second"), dry=False))
    assert again == {n: "already gone" if o == "deleted" else o for n, o in EXPECTED.items()}
