"""python -m gistmill COMMAND: evals; audit PATH; learn PATH [TARGET]; retrieve TABLE HASH."""

from __future__ import annotations

import sys


def main(args: list[str]) -> int:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .plans import audit, compress, store, tools
    from .sources import readers

    if not args or args[0] not in ("evals", "audit", "learn", "retrieve"):
        print(__doc__)
        return 2
    spark = SparkSession.builder.appName("gistmill").getOrCreate()
    what, rest = args[0], args[1:]
    if what == "evals":
        print(tools.report(audit.evaluate(audit.eval_fixtures(spark)), "name"))
    elif what == "audit":
        print(tools.report(compress.totals(compress.compress_messages(readers.messages_of(readers.read_requests(spark, rest[0]))), "conv_id"), "conv_id"))
    elif what == "learn":
        events = readers.read_sessions(spark, rest[0]).withColumn("payload", F.col("payload").withField("correction", readers.correction_text()))
        block = audit.rules_block(audit.findings(events)).first()["block"]
        print(tools.apply_rules(block, rest[1], dry_run=False) if rest[1:] else block)
    else:
        row = store.retrieve(spark.createDataFrame([(rest[1],)], "hash string"), readers.load_originals(spark, rest[0])).first()
        if row is None or row["original"] is None:
            return 1
        print(row["original"])
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
