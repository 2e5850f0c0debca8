"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import Observation  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from ampliq.session import build_session  # noqa: E402
from checks import derived as D  # noqa: E402
from checks.registry import QUERIES  # noqa: E402

HEADLINE = {
    "J3_seed_extend_hits": "seed_extend_hits",
    "J4_fr_amplicon_join": "fr_amplicon_join",
    "J7_pair_candidates": "pair_candidates",
    "W1_pair_topn": "pair_topn",
    "G3_thermo_catalog": "thermo_catalog",
    "G4_homodimer_screen": "homodimer_screen",
    "G5_heterodimer_screen": "heterodimer_screen",
    "G6_hairpin_screen": "hairpin_screen",
    "J1_template_window_fetch": "template_window_fetch",
    "J9_methylation_join": "methylation_join",
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": os.environ.get("BENCH_PARTITIONS", str(2 * int(cpus) if cpus.isdigit() else 16)),
        "spark.driver.memory": "20g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    D.contigs(spark, sf_dir).count()
    chosen = os.environ.get("BENCH_QUERIES")
    times, rows = {}, {}
    for label, name in HEADLINE.items():
        if chosen and name not in chosen.split(","):
            continue
        began = time.time()
        df = QUERIES[name](spark, sf_dir)
        # Every column is worked out and every row visited, but nothing is brought to the driver.
        seen = Observation(label)
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.format("noop").mode("overwrite").save()
        times[label] = round(time.time() - began, 2)
        rows[label] = seen.get["rows"]
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(times.values()), 2), "unit": "sec",
        "queries": times, "rows": rows, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1], "cpus": cpus,
    }))


if __name__ == "__main__":
    main()
