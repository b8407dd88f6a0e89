"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

One run of each after a warm-up, as the JVM compiles on first use. Minimum
utilities scale with the table so that the answer keeps its size.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

HERE = str(Path(__file__).resolve().parent)
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [HERE, os.environ.get("PYTHONPATH")]))  # for the workers

from lodestone.functions import bounds  # noqa: E402
from lodestone.plans.levelwise import mine  # noqa: E402
from lodestone.plans.utility_list import mine_lists  # noqa: E402
from lodestone.session import local_session, stored  # noqa: E402
from lodestone.sources import relational  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))


def main() -> None:
    spark = local_session(CPUS, int(CPUS))
    scale = float(Path(SF_DIR).name.removeprefix("sf")) if Path(SF_DIR).name.startswith("sf") else 0.1
    brand, part, supp = relational.brand_baskets, relational.part_baskets, relational.supplier_baskets
    high, supplier = max(1, int(200_000 * scale)), max(1600, int(16_000 * scale))

    def eucs(tx):  # noqa: ANN001, ANN202
        return bounds.pair_bounds(bounds.revised(tx, bounds.ranks(bounds.promising(bounds.twu(tx), high))))

    runs = {
        "twu_part": lambda: bounds.twu(part(spark, SF_DIR)).count(),
        "eucs_brand": lambda: eucs(stored(brand(spark, SF_DIR), "baskets")).count(),
        "hui_brand": lambda: mine(brand(spark, SF_DIR), high).found.count(),
        "hui_part": lambda: mine(part(spark, SF_DIR), 400).found.count(),
        "hui_supp": lambda: mine(supp(spark, SF_DIR), supplier).found.count(),
        "hui_brand_levelwise": lambda: mine(brand(spark, SF_DIR), high, local_elements=0).found.count(),
        "hui_fhm_brand": lambda: mine_lists(brand(spark, SF_DIR), high).found.count(),
    }
    runs["hui_brand"]()
    seconds, rows = {}, {}
    for name, run in runs.items():
        took = []
        for _ in range(1):
            began = time.perf_counter()
            rows[name] = run()
            took.append(time.perf_counter() - began)
            spark.catalog.clearCache()
        seconds[name] = round(min(took), 3)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "rows": rows, "sf": scale}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
