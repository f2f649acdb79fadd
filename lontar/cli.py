"""python -m lontar.cli STAGE --tables FOLDER --out FOLDER"""

from __future__ import annotations

import argparse
import json

from lontar.plans.pipeline import Pipeline
from lontar.runtime import session, table


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("stage", choices=["status", *Pipeline.ORDER], nargs="?", default="status")
    parser.add_argument("--tables", default=".")
    parser.add_argument("--out", default="out")
    parser.add_argument("--quotas", type=json.loads, default={"multi_sense": 10, "alias": 15, "numeric": 15, "typical_fill": 10})
    given = parser.parse_args(arguments)
    spark = session()
    pipeline = Pipeline(spark, given.out)
    if given.stage == "status":
        result = pipeline.status()
    elif given.stage == "audit":
        result = pipeline.audit(table(spark, given.tables, "glossary"))
    elif given.stage == "select":
        result = pipeline.select(given.quotas)
    else:
        result = pipeline.enrich(table(spark, given.tables, "corpus"))
    print(json.dumps(result, indent=2, sort_keys=True))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
