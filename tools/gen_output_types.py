"""Regenerate ledgerlens/oracle/output_types.py from the Spark schemas of every registered query.

    python tools/gen_output_types.py

Only analysis runs (``df.schema``), no job. The oracle SQL uses the map to
normalise integer and boolean columns exactly as ``registry.normalise`` does.
"""

from __future__ import annotations

import os
import pprint
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerlens.plans.catalog import ENTRIES  # noqa: E402
from ledgerlens.plans.registry import column_kinds  # noqa: E402
from ledgerlens.session import local_session  # noqa: E402
from ledgerlens.sources.binding import bound_warehouse  # noqa: E402


def main():
    spark = local_session()
    wh = bound_warehouse(spark, "/root/testdata/sf0.001")
    out = {key: column_kinds(e.spark_fn(wh).schema) for key, e in sorted(ENTRIES.items())}
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))),
                        "ledgerlens", "oracle", "output_types.py")
    with open(path, "w") as fh:
        fh.write('"""Integer and boolean output columns per registered query (generated by tools/gen_output_types.py)."""\n\n')
        fh.write("OUTPUT_TYPES = " + pprint.pformat(out, width=110, sort_dicts=True) + "\n")
    print(f"wrote {len(out)} keys to {path}")


if __name__ == "__main__":
    main()
