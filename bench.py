"""Time the headline queries and print one JSON line.

Folder from $BENCH_SF_DIR, cores from $BENCH_CPUS. Every query runs twice over
its whole tables and the better time counts; models are fitted before their
scoring is timed.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from vigilark.operators import normalize, risk  # noqa: E402
from vigilark.plans import analysis, catalog, models, tables  # noqa: E402
from vigilark.session import local_session, stored  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = {  # query -> table its rows/s refer to
    "window_features": "events", "window_features_multi": "events",
    "rate_threshold": "events", "success_after_failures": "events", "scan_then_login": "events",
    "entity_correlation": "events", "top_offenders": "events", "threat_summary": "events", "timeline_1min": "events",
    "triage_log": "events", "classification_report": "orders", "roc_auc": "orders", "threshold_sweep": "orders",
    "recommendation_text": "orders",
}

def timed(df_of) -> float:
    best = float("inf")
    for _ in range(2):
        start = time.perf_counter()
        df_of().write.format("noop").mode("overwrite").save()
        best = min(best, time.perf_counter() - start)
    return best


def main() -> None:
    spark = local_session(CPUS, shuffle_partitions=int(CPUS))
    spark.sparkContext.setLogLevel("ERROR")
    rows = {name: tables.read(spark, SF_DIR, name).count() for name in set(HEADLINE.values())}
    seconds = {name: timed(lambda name=name: catalog.QUERIES[name](spark, SF_DIR)) for name in HEADLINE}
    per_second = {name: rows[table] / seconds[name] for name, table in HEADLINE.items()}

    # the driver's tables are single small files; a table at scale has many splits
    spread = int(CPUS)
    lines = stored(tables.raw_alert_lines(spark, SF_DIR).repartition(spread), "bench-lines")
    seconds["normalize_alert"] = timed(lambda: normalize.normalize_batch(lines)[0])
    per_second["normalize_alert"] = rows["events"] / seconds["normalize_alert"]
    coded = catalog.encoded(spark, SF_DIR).drop("score", "iso_flag", "difficulty_level")
    sessions = stored(coded.repartition(spread), "bench-sessions")
    train, _ = catalog.parts(sessions)
    every = sessions.drop("is_test")
    start = time.perf_counter()
    fit = models.fitted(stored(train.drop("is_test"), "bench-train"))  # 200 rounds of depth 6 and 200 trees; found in the registry if fitted before
    fitting = time.perf_counter() - start
    for name, run in {
        "risk_score": lambda: risk.risk_score(fit.risk, every),
        "assess": lambda: analysis.assess(fit.risk, fit.forest, every),
        "analyze": lambda: analysis.analyze(fit.risk, fit.forest, fit.tactics, every, true_label="label"),
    }.items():
        seconds[name] = timed(run)
        per_second[name] = rows["orders"] / seconds[name]
    print(json.dumps({
        "metric": "headline_total_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": {k: round(v, 3) for k, v in seconds.items()},
        "rows_per_second": {k: round(v) for k, v in per_second.items()},
        "fit_seconds": {"all_models_or_lookup": round(fitting, 2)},
        "models": {**models.TREES, **models.FOREST},
        "sf": os.path.basename(SF_DIR.rstrip("/")),
        "cpus": int(CPUS),
    }))


if __name__ == "__main__":
    main()
