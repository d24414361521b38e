"""Run registered queries beside their checking SQL and compare whole results."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return con


def _plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object:
            values = df[c].dropna()
            if len(values) and not isinstance(values.iloc[0], (str, bool)):
                df[c] = pd.to_numeric(df[c])
            elif len(values) and isinstance(values.iloc[0], bool):
                df[c] = df[c].astype("boolean").astype("string")
        if pd.api.types.is_bool_dtype(df[c].dtype):
            df[c] = df[c].astype("boolean").astype("string").str.lower()
    return df.sort_values(list(df.columns), na_position="last").reset_index(drop=True)


def compare(spark_df: pd.DataFrame, sql_df: pd.DataFrame) -> str | None:
    """None where equal, otherwise what differs."""
    if sorted(spark_df.columns) != sorted(sql_df.columns):
        return f"columns {sorted(spark_df.columns)} vs {sorted(sql_df.columns)}"
    if len(spark_df) != len(sql_df):
        return f"rows {len(spark_df)} vs {len(sql_df)}"
    a, b = _plain(spark_df), _plain(sql_df)
    for c in a.columns:
        x, y = a[c], b[c]
        if pd.api.types.is_numeric_dtype(x) and pd.api.types.is_numeric_dtype(y):
            if pd.api.types.is_float_dtype(x) != pd.api.types.is_float_dtype(y) and not (x.isna().any() or y.isna().any()):
                return f"{c}: types {x.dtype} vs {y.dtype}"
            u, v = x.to_numpy(float), y.to_numpy(float)
            bad = ~((u == v) | (np.isnan(u) & np.isnan(v)))
        else:
            bad = (x.astype("string").fillna("~").str.lower() != y.astype("string").fillna("~").str.lower()).to_numpy()
        if bad.any():
            k = int(np.flatnonzero(bad)[0])
            return f"{c}: {int(bad.sum())} differ, first {x.iloc[k]!r} vs {y.iloc[k]!r}"
    return None


def main() -> None:
    from heliospark.session import local_session

    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    wanted = sys.argv[2:]
    spark = local_session("8")
    spark.sparkContext.setLogLevel("OFF")
    con = database(sf_dir)
    failed = 0
    for name, build in entry.queries().items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        start = time.time()
        try:
            got = build(spark, sf_dir).toPandas()
            took = time.time() - start
            text = entry.oracle_sql().get(name)
            if text is None:
                note = f"no SQL, {len(got)} rows"
            else:
                start = time.time()
                note = compare(got, con.execute(text).df()) or f"ok, {len(got)} rows, sql {time.time() - start:.1f}s"
        except Exception as error:  # noqa: BLE001
            took, note = time.time() - start, f"ERROR {type(error).__name__}: {str(error)[:600]}"
        if not note.startswith(("ok", "no SQL")):
            failed += 1
            note = "FAIL " + note
        print(f"{name:24s} {took:6.1f}s {note}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
