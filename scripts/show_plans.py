"""Print the final (post-AQE) physical plan of every registered query.

    python scripts/show_plans.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main() -> None:
    from parlance.fixtures import TEST_CATALOGUE, load_lines, load_lookups
    from parlance.operators.dispatch import dispatch_commands
    from parlance.registry import QUERIES
    from parlance.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = build_session("plans", master="local[8]", shuffle_partitions=8,
                          extra={"spark.ui.showConsoleProgress": "false"})

    cases = [(name, lambda fn=fn: fn(spark, sf_dir)) for name, fn in QUERIES.items()]
    for strategy in ("shuffle", "keys"):
        cases.append((
            f"dispatch_commands (strategy={strategy})",
            lambda s=strategy: dispatch_commands(
                load_lines(spark, sf_dir), TEST_CATALOGUE, load_lookups(spark, sf_dir), strategy=s
            ),
        ))
    print(f"# Physical plans at `{sf_dir}`\n")
    print("Final plans after adaptive execution, from `scripts/show_plans.py`. Paths are local.")
    print("The write-then-read queries (`log_append`, `log_tail`, `stream_dispatch`) show the read.\n")
    for name, build in cases:
        df = build()
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        plan = plan.split("+- == Initial Plan ==")[0]
        print(f"## {name}\n\n```text\n{plan.rstrip()}\n```\n")
    spark.stop()


if __name__ == "__main__":
    main()
