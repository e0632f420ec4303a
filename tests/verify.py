"""Compare queries with their SQL as the driver does: python tests/verify.py SF [NAME...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def rows_of(df):
    import pandas as pd

    cols = sorted(df.columns)

    def norm(v):
        if v is None or (not isinstance(v, (list, dict, str)) and pd.api.types.is_scalar(v) and pd.isna(v)):
            return None
        if isinstance(v, bool):
            return v
        if isinstance(v, float):
            return round(v, 6)
        if hasattr(v, "tolist"):
            v = v.tolist()
        return str(v) if isinstance(v, (list, dict)) else int(v) if hasattr(v, "__index__") else v

    return cols, sorted((tuple(norm(v) for v in r) for r in df[cols].itertuples(index=False, name=None)), key=repr)


def main(sf: str, names: list[str]) -> int:
    import duckdb

    import __spark_entry__ as e
    from tidewatch.session import local_session

    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    d = f"/root/testdata/{sf}"
    for p in Path(d).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    bad = 0
    sql = e.oracle_sql()
    for n, f in e.queries().items():
        if names and n not in names:
            continue
        t = time.time()
        try:
            pdf = f(spark, d).toPandas()
            took = time.time() - t
            if n not in sql:
                print(f"{n}: {len(pdf)} rows, no SQL, {took:.1f} s", flush=True)
                continue
            a, b = rows_of(pdf), rows_of(con.sql(sql[n]).df())
            ok = a == b
            bad += not ok
            print(f"{n}: {'same' if ok else 'DIFFERENT'} {len(a[1])} {len(b[1])} rows, {took:.1f} s", flush=True)
            if not ok:
                print("  ", a[0], b[0])
                sa, sb = set(map(repr, a[1])), set(map(repr, b[1]))
                print("   spark only:", [x for x in a[1] if repr(x) not in sb][:3], "\n   sql only:", [x for x in b[1] if repr(x) not in sa][:3])
        except Exception as x:
            bad += 1
            print(f"{n}: FAILED {str(x)[:1500]}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
