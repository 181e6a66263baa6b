"""Publishing a bound data set: whole folders only, newest first, no writer on another's files."""
import os
import tempfile
import time

from conftest import SF_SMALL
from ledgerlens.sources import binding


def test_only_published_folders_count_and_the_newest_is_taken(spark):
    root = tempfile.mkdtemp(prefix="bound-", dir="/tmp")
    assert binding._published(spark, root) is None
    spark.range(3).write.parquet(f"{root}/unfinished/orgs")          # a writer that was lost before its marker
    assert binding._published(spark, root) is None
    for name in ("b-first", "a-second"):
        spark.range(3).write.parquet(f"{root}/{name}/orgs")
        binding._publish(spark, f"{root}/{name}")
        assert binding._published(spark, root) == f"{root}/{name}"
        time.sleep(1.1)
    assert os.path.exists(f"{root}/b-first/orgs")                    # what readers may be on stays


def test_bound_tables_lie_in_the_published_folder(spark, wh_small):
    root = binding.warehouse_root(spark, SF_SMALL)
    folder = binding._published(spark, root)
    assert folder and folder.startswith(root)
    assert all(f"{folder}/orgs/" in f.replace("file://", "") for f in wh_small.table("orgs").inputFiles())
    assert binding.bound_warehouse(spark, SF_SMALL) is wh_small
