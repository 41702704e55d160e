"""Repeated lines of any length."""

import collections

import duckdb

from glosspark.llm import queries


def test_lines_all(spark, tmp_path):
    hot = "this line of nine words is in every third"
    docs = [(i, "\n".join([f"own {i} " + "x " * (i % 20), *([hot] if i % 3 == 0 else []), "", " \t", f"pair {i // 2}"])) for i in range(60)] + [(None, hot), (90, None), (91, "")]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op8_lines_all(spark, str(tmp_path)).toPandas()
    seen, want = {}, []
    for i, text in sorted(docs, key=lambda r: (r[0] is None, r[0] or 0)):
        at = 0
        for line in (text or "").split("\n"):
            if key := " ".join(line.lower().split()):
                if key in seen:
                    want.append((i, at, at + len(line.rstrip()), *seen[key], key))
                else:
                    seen[key] = (i, at)
            at += len(line) + 1
    copies = collections.Counter(w[-1] for w in want)
    want = {(*w[:-1], copies[w[-1]] + 1) for w in want}
    clean = lambda df: {tuple(None if v != v else int(v) for v in r) for r in df[["doc_id", "start", "stop", "first_doc_id", "first_start", "copies"]].astype("float64").itertuples(index=False)}
    assert clean(got) == want and len(got) == len(want)
    assert sum(c == len(range(0, 60, 3)) + 1 for *_, c in want) == 20  # all but the first place of the hot line
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    sql = con.execute(queries.ORACLES["op8_lines_all"]).df()
    assert clean(sql) == want
