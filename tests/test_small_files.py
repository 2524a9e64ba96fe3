"""One file a row: written by many tasks, shelf by shelf."""

from __future__ import annotations

from pathlib import Path

from corpusloom.sources import readers as R
from corpusloom.sources import sinks as K


def test_files_of_one_partition_are_written_by_many_tasks(spark, tmp_path):
    """a table in one partition was written by one task."""
    df = spark.range(40).selectExpr("id AS key", "concat('---\nid: ', id, '\n---\nx') AS content").coalesce(1)
    K.write_files(df, str(tmp_path / "m"), "key", "content", 8)
    assert len({p.name.split("-")[1] for p in Path(tmp_path / "m").rglob("part-*.txt")}) > 1
    got = R.read_markdown(spark, f"{tmp_path}/m/shelf=*").collect()
    assert sorted(int(r.metadata["id"]) for r in got) == list(range(40)) and all(f"/key={r.metadata['id']}/" in r.path for r in got)
