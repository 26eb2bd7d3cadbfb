"""The corpus source hands over bounded batches."""

from __future__ import annotations

from exposure.sources import corpus


def test_batches_hold_bounded_content_and_all_rows(tmp_path):
    lines = b"".join(b"%07d\n" % i for i in range(5 << 20))
    (tmp_path / "big").write_bytes(lines)
    (tmp_path / "empty").write_bytes(b"")
    reader = corpus.CorpusReader({"roots": f"{tmp_path},{tmp_path}/missing", "maxBytes": str(1 << 20)})
    batches = [b for share in reader.partitions() for b in reader.read(share)]
    sizes = [sum(len(x or b"") for x in b.column("content").to_pylist()) for b in batches]
    assert max(sizes) <= corpus.BATCH_BYTES + (1 << 20) and len(batches) > 4
    rows = [r for b in batches for r in b.to_pylist()]
    big = sorted((r for r in rows if r["path"].endswith("big")), key=lambda r: r["part_no"])
    assert b"".join(r["content"] for r in big) == lines
    assert [r["content"] for r in rows if r["path"].endswith("empty")] == [b""]
    assert [r["error"] is not None for r in rows if r["path"].endswith("missing")] == [True]


def test_source_reads_the_same_rows(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"x\ny\n")
    spark.dataSource.register(corpus.CorpusSource)
    found = spark.read.format("corpus").option("roots", str(tmp_path)).load().collect()
    assert [(r.path, r.size, bytes(r.content), r.part_no, r.error) for r in found] == [(f"{tmp_path}/a", 4, b"x\ny\n", 0, None)]
    assert found[0].modified is not None
