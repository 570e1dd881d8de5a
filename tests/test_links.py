"""d4_near_dup and d5_vector_dup tell every pair of classes by themselves, not only how many there are."""

from itertools import combinations

import duckdb

import __spark_entry__ as entry


def rows_and_sql(spark, tmp_path, name, table, df):
    df.write.parquet(str(tmp_path / f"{table}.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    got = entry.queries()[name](spark, str(tmp_path))
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    got = [tuple(r) for r in got.collect()]
    assert sorted(got) == sorted(want)
    return {r[0]: r for r in got}


def test_near_documents_tell_their_pairs(spark, tmp_path):
    base = [f"w{i}" for i in range(30)]
    texts = [base, base[::-1], base[:-1], ["new", *base], ["x", "y"], ["y", "x"], base[:-3]]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)] + [(50, None)], "doc_id long, text string")
    rows = rows_and_sql(spark, tmp_path, "d4_near_dup", "documents", df)
    classes = {i: [j for j, r in rows.items() if r[1] == i] for i in rows if rows[i][1] == i}
    got = {(min(a, b), max(a, b)): 1.0 for ids in classes.values() for a, b in combinations(ids, 2)}
    for x, ids in classes.items():
        for y, jaccard in (told.split(":") for told in rows[x][4].split()):
            got |= {(min(a, b), max(a, b)): float(jaccard) for a in ids for b in classes[int(y)]}
    score = lambda a, b: round(len(set(a) & set(b)) / len(set(a) | set(b)), 6)
    assert got == {(i, j): score(texts[i], texts[j]) for i, j in combinations(range(len(texts)), 2) if score(texts[i], texts[j]) >= 0.85} and len(got) > 8


def test_near_vectors_tell_their_pairs_and_none_is_left_out(spark, tmp_path):
    data = [(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1), (3, [1.0, 2.0], None), (4, [1.0, 2.0], None), (5, [5.0, 1.0], 1), (6, [1.1, 2.0], 1), (7, [3.0, 3.0], 2)]
    rows = rows_and_sql(spark, tmp_path, "d5_vector_dup", "embeddings", spark.createDataFrame(data, "vec_id long, embedding array<float>, label int"))
    assert rows[1][1:] == (1, 2, 2, "6") and rows[2][1:] == (1, 2, 2, "")
    assert rows[3][1:] == (3, 2, 0, "") and rows[4][1:] == (3, 2, 0, "") and len(rows) == 14
