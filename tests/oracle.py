"""Compare a registered query with its SQL, as rows without order."""

from __future__ import annotations

import datetime
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (bytes, bytearray, memoryview)):
        return bytes(v).hex()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(plain(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{plain(k)}:{plain(v[k])}" for k in sorted(v)) + "}"
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return str(v)


def rows(found, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in found), [names[i] for i in order]


def compare(df, sql: str, sf_dir: str) -> int:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    res = con.execute(sql)
    want, want_names = rows(res.fetchall(), [c[0] for c in res.description])
    got, got_names = rows([tuple(r) for r in df.collect()], df.columns)
    assert got_names == want_names, (got_names, want_names)
    assert len(got) == len(want), (len(got), len(want))
    for g, w in zip(got, want, strict=True):
        assert g == w, f"{got_names}\nspark {g}\nduckdb {w}"
    return len(got)
