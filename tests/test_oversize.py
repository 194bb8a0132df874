"""Files above the size limit in the reassembly query."""

from reelfold.plans.registry import QUERIES
from reelfold.sources import files


def test_every_file_has_a_row_at_any_size(spark, sf_dir, monkeypatch):
    query = QUERIES["s3_reassemble_chunks"]
    want = sorted(map(tuple, query(spark, sf_dir).collect()))
    whole = files.reassemble_chunks
    monkeypatch.setattr(files, "reassemble_chunks", lambda chunks: whole(chunks, max_bytes=2_000))
    assert sorted(map(tuple, query(spark, sf_dir).collect())) == want
