"""Run the package's queries on one folder against their SQL: ``python -m tests.llm.try_queries FOLDER NAME...``."""

import sys
import time

from spanwave.llm import queries
from spanwave.session import local_session
from tests import compare

if __name__ == "__main__":
    spark = local_session(8, "try")
    con = compare.connect(sys.argv[1])
    for name, build in queries.QUERIES.items():
        if sys.argv[2:] and not any(w in name for w in sys.argv[2:]):
            continue
        start = time.time()
        try:
            got = build(spark, sys.argv[1]).toPandas()
        except Exception as error:  # noqa: BLE001
            print(name, "ERROR", str(error)[:600], flush=True)
            continue
        spent = time.time() - start
        note = compare.difference(got, con.execute(queries.ORACLES[name]).df()) or "match" if name in queries.ORACLES else got.head(8)
        print(name, len(got), round(spent, 1), note, flush=True)
