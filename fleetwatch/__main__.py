"""Command line.

    python -m fleetwatch batch  --sf /root/testdata/sf0.01 [--out DIR]
        end-to-end batch job: features, detectors, RUL models, decisions, evaluation,
        results table and metric sinks, saved models.
    python -m fleetwatch score  --models DIR --requests DIR [--stateful]
        drain the scoring stream over a folder of JSON requests with saved models.
    python -m fleetwatch query  NAME --sf DIR [--show N]
        run one registered query.
"""
from __future__ import annotations

import argparse
import json
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main(argv=None):
    ap = argparse.ArgumentParser(prog="fleetwatch")
    sub = ap.add_subparsers(dest="cmd", required=True)
    b = sub.add_parser("batch")
    b.add_argument("--sf", required=True)
    b.add_argument("--out")
    b.add_argument("--no-sequence-model", action="store_true")
    s = sub.add_parser("score")
    s.add_argument("--models", required=True)
    s.add_argument("--requests", required=True)
    s.add_argument("--stateful", action="store_true")
    q = sub.add_parser("query")
    q.add_argument("name")
    q.add_argument("--sf", required=True)
    q.add_argument("--show", type=int, default=20)
    a = ap.parse_args(argv)

    from .session import get_spark
    spark = get_spark()
    if a.cmd == "batch":
        from .plans.pipeline import run_batch
        print(json.dumps(run_batch(spark, a.sf, a.out, with_sequence_model=not a.no_sequence_model)))
    elif a.cmd == "score":
        from .streaming.pipeline import run_model_scoring
        print(json.dumps(run_model_scoring(spark, a.requests, a.models, stateful=a.stateful)))
    else:
        from .plans.registry import all_queries
        all_queries()[a.name](spark, a.sf).show(a.show, truncate=False)


if __name__ == "__main__":
    main()
