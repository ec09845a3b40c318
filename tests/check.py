"""python tests/check.py [name-part ...] [--sf DIR]: run registered queries against their SQL."""

import sys
import time
import traceback

sys.path[:0] = ["/root/repo", "/root/repo/tests"]
import __spark_entry__ as entry_module  # noqa: E402
from compare import compare, connect  # noqa: E402

from repovigil.session import local_session  # noqa: E402


def main():
    args = sys.argv[1:]
    sf = "/root/testdata/sf0.01"
    if "--sf" in args:
        i = args.index("--sf")
        sf = args[i + 1]
        del args[i : i + 2]
    spark = local_session("8")
    con = connect(sf)
    queries, sqls = entry_module.queries(), entry_module.oracle_sql()
    bad = 0
    for name, run in queries.items():
        if args and not any(a in name for a in args):
            continue
        start = time.time()
        try:
            df = run(spark, sf)
            rows = [tuple(r) for r in df.collect()]
            took = time.time() - start
            diff = compare(df.dtypes, rows, sqls[name], con) if name in sqls else None
            note = f"{len(rows)} rows{'' if name in sqls else ', no SQL'}"
        except Exception as e:  # report and go on
            took, diff, note = time.time() - start, f"{type(e).__name__}: {str(e)[:1500]}", ""
            if "-v" in args:
                traceback.print_exc()
        bad += diff is not None
        print(f"{'ok ' if diff is None else 'BAD'} {name} {took:.1f}s {note} {diff or ''}", flush=True)
    print("bad:", bad, "of", len(queries), "with SQL:", len(sqls))


main()
