"""The queries of the corpus operators: SQL where there is some, and the pipeline."""

from collections import Counter, defaultdict

import pytest

from loomstrand.llm.queries import ORACLE_SQL, QUERIES

from ..conftest import canonical


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, duck, small, name):
    got = [r.asDict() for r in QUERIES[name](spark, small).collect()]
    rel = duck.sql(ORACLE_SQL[name])
    want = [dict(zip(rel.columns, row, strict=True)) for row in rel.fetchall()]
    assert canonical(got) == canonical(want)


def test_pipeline_stages(spark, small):
    import corpus_pipeline as p
    from loomstrand.llm import toxicity

    from .test_operators import brute_exact, brute_hits, brute_near

    docs = spark.read.parquet(f"{small}/documents.parquet")
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    names = [n for n, _ in p.STAGES]
    assert names == ["toxicity", "exact dedup", "near dedup", "decontamination", "mixing"]
    now = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = toxicity.train(docs, spark.read.parquet(f"{small}/labels.parquet"))
    for name, stage in p.STAGES:
        frame = docs.where(docs["doc_id"].isin(list(now)))
        out = stage(spark, frame, small)
        if name == "mixing":
            break
        assert out.columns == docs.columns
        got = {r["doc_id"] for r in out.collect()}
        if name == "toxicity":
            want = {d for d, h in zip(now, model.hits(list(now.values())), strict=True) if model.score(h) < 0.7}
        elif name == "exact dedup":
            want = {k[0] for k in brute_exact(list(now.items())) if k[3]}
        elif name == "near dedup":
            want = {d for d, c in brute_near(list(now.items())).items() if d == c}
        else:
            want = {d for d, t in now.items() if not brute_hits(t, items)[1]}
        assert got == want and 0 < len(got) <= len(now), name
        now = {d: now[d] for d in got}
    passes = defaultdict(Counter)
    for r in out.collect():
        passes[r["doc_id"]][r["pass"]] += 1
        assert r["pass_words"] <= len(now[r["doc_id"]].split())
    assert set(passes) <= set(now) and all(set(c) <= {1, 2} and max(c.values()) == 1 for c in passes.values())


def test_pipeline_odd(spark, tmp_path):
    import corpus_pipeline as p

    from .test_operators import odd

    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([("a", None), (None, "")], "item_id string, text string")
    for name, docs in (("odd", odd(spark)), ("none", odd(spark).where("false"))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.where("doc_id is not null" if name == "odd" else "false").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        items.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        out = p.run(spark, f"{tmp_path}/{name}")
        assert out.columns[: len(docs.columns)] == docs.columns
        got = Counter(r["doc_id"] for r in out.collect())
        if name == "none":
            assert not got
        else:  # 5 and one of the rows of 1 are exact copies of 1; 2, 3 and another have no words
            assert set(got) <= {1, None, 6, 7} and got[6]
