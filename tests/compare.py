"""Run a registered query and its SQL side by side and compare rows, names, types and values."""
from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _type_class(t: str) -> str:
    t = t.lower()
    if t in ("bigint", "long"):
        return "bigint"
    if t in ("integer", "int"):
        return "int"
    if t in ("varchar", "string"):
        return "string"
    if t.startswith("timestamp"):
        return "timestamp"
    return t


def _canon(df: pd.DataFrame, kinds: dict[str, str]) -> pd.DataFrame:
    """Comparable columns in name order, rows in value order."""
    out = pd.DataFrame(index=df.index)
    for c in sorted(kinds):
        s = df[c]
        if kinds[c] in ("bigint", "int", "double", "boolean"):
            out[c] = s.astype("float64") if s.dtype != object else pd.to_numeric(s.map(lambda v: np.nan if v is None else float(v)))
        elif kinds[c] in ("timestamp", "date"):
            out[c] = pd.to_datetime(s).astype("datetime64[us]")
        else:
            out[c] = s.map(lambda v: None if v is None or v is pd.NA or v != v else str(v)).astype(object)
    return out.sort_values(list(out.columns), na_position="first").reset_index(drop=True)


def compare(spark_df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    rel = con.sql(sql)
    dcols = {c: _type_class(str(t)) for c, t in zip(rel.columns, rel.types)}
    scols = {c: _type_class(t) for c, t in spark_df.dtypes}
    if sorted(dcols) != sorted(scols):
        return f"columns: spark {sorted(scols)} sql {sorted(dcols)}"
    bad = {c: (scols[c], dcols[c]) for c in dcols if scols[c] != dcols[c]}
    if bad:
        return f"types (spark, sql): {bad}"
    a, b = _canon(spark_df.toPandas(), scols), _canon(rel.df(), dcols)
    if len(a) != len(b):
        return f"row count: spark {len(a)} sql {len(b)}; e.g. spark {a.head(2).to_dict('records')} sql {b.head(2).to_dict('records')}"
    if a.equals(b):
        return None if len(a) else "EMPTY on both sides"
    m = a.merge(b, how="outer", indicator=True, on=list(a.columns))
    only_s, only_d = m[m._merge == "left_only"], m[m._merge == "right_only"]
    if not len(only_s) and not len(only_d):
        return None
    drop = {"columns": "_merge"}
    return (
        f"values, {len(only_s)} of {len(a)}: only spark {only_s.drop(**drop).head(3).to_dict('records')} "
        f"only sql {only_d.drop(**drop).head(3).to_dict('records')}"
    )
