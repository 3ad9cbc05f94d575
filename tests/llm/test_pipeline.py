"""The corpus pipeline: stages, their order and their effect, and the SQL twin
of exact dedup."""

import random

import duckdb

from gridwright.llm.queries import ORACLE, QUERIES

import corpus_pipeline  # noqa: E402  (the repository root is on the path, see tests/conftest.py)


def rows(df):
    return sorted(str(tuple(r)) for r in df.collect())


def test_stages_filter_whole_rows(spark, tmp_path):
    rng = random.Random(1)
    text = lambda n: " ".join(f"w{rng.randint(0, 5000)}" for _ in range(n))
    clean = [(k, text(60)) for k in range(40)]
    toxic = [(k, text(30) + " moron scum " + text(20) + " idiot clown") for k in range(100, 150)]
    item = text(40)
    leak = [(200, text(20) + " " + item + " " + text(20))]
    near = [(300, clean[3][1] + " tail")]
    odd = [(400, None), (401, ""), (None, text(50)), (2, clean[2][1])]
    copies = [(500 + k, clean[k][1].replace(" ", "  ", 1)) for k in range(5)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "extra") for i, t in clean + toxic + leak + near + odd + copies],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint, score string")
    labels = spark.createDataFrame([(i, 1, int(100 <= i < 150)) for i, _ in clean + toxic], "doc_id bigint, quality int, toxic int")
    d = str(tmp_path)
    docs.write.parquet(f"{d}/documents.parquet")
    labels.write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "benchmark decontamination", "bpe"]
    at, left = docs, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, d)
        if k < 4:
            assert out.columns == docs.columns, name
        out.write.parquet(f"{d}/out{k}")
        at = spark.read.parquet(f"{d}/out{k}")
        left.append([r["doc_id"] for r in at.collect()])
    assert not {i for i, _ in toxic} & set(left[0]) and set(left[0]) >= {i for i, _ in clean}
    assert sorted(map(str, left[1])) == sorted(map(str, [i for i, _ in clean] + [200, 300, 400, None]))
    assert set(left[2]) >= {i for i, _ in clean} - {3} and len({400, 401} & set(left[2])) == 1
    assert set(left[2]) - set(left[3]) == {200}
    assert sorted(map(str, left[4])) == sorted(map(str, left[3]))
    assert at.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert rows(corpus_pipeline.run(spark, d)) == rows(at)


def test_queries_match_their_sql(spark, sf_small):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    for name, sql in ORACLE.items():
        want = con.execute(sql)
        cols = [c[0] for c in want.description]
        assert rows(QUERIES[name](spark, sf_small).select(*cols)) == sorted(str(r) for r in want.fetchall())


def test_queries_and_guard():
    import __spark_entry__ as entry
    assert {n.split("_")[0] for n in QUERIES} == {f"op{k}" for k in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
