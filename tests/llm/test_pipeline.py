from collections import Counter

import duckdb

import corpus_pipeline
from cropframe.llm import decontaminate, near_dedup, quality, queries, toxicity
from cropframe.llm.common import table as given

SF = "/root/testdata/sf0.001"


def test_stages_keep_and_drop_what_the_operators_say(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "quality", "near_dedup", "decontamination", "sentencepiece"]
    table = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        table = stage(spark, table, SF)
        assert table.columns == docs.columns, name
    kept = {r.doc_id: r.text for r in table.collect()}
    assert 0 < len(kept) < docs.count()
    assert all(kept[r.doc_id] == r.text for r in docs.collect() if r.doc_id in kept)
    hit = {r.doc_id for r in queries.QUERIES["op5_decontamination"](spark, SF).collect() if r.contaminated}
    toxic = {r.doc_id for r in queries.QUERIES["op1_toxicity"](spark, SF).collect() if r.predicted}
    assert not set(kept) & hit and not set(kept) & toxic
    last = corpus_pipeline.STAGES[-1][1](spark, table, SF).collect()
    assert {r.doc_id for r in last} == set(kept) and all(r.round_trip for r in last)


def test_queries_with_sql_match_it(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    for name, sql in queries.ORACLE.items():
        df = queries.QUERIES[name](spark, SF)
        want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({sql})").fetchall()
        assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str), name


def test_every_stage_keeps_exactly_the_rows_its_operator_keeps(spark):
    labels, benchmark = given(spark, SF, "labels"), given(spark, SF, "benchmark")
    docs = given(spark, SF, "documents")
    stages = dict(corpus_pipeline.STAGES)

    def ids(df):
        return Counter(r.doc_id for r in df.select("doc_id").collect())

    civil = ids(toxicity.scored(docs, labels).where("predicted = 0"))
    assert ids(stages["toxicity"](spark, docs, SF)) == civil and len(civil) > 150
    good = ids(quality.scored(docs, labels).where("predicted = 1"))
    assert ids(stages["quality"](spark, docs, SF)) == good and len(good) > 100
    classes = near_dedup.near_classes(docs).select("class_id").distinct()
    assert ids(stages["near_dedup"](spark, docs, SF)) == Counter(r.class_id for r in classes.collect())
    judged = decontaminate.digest(decontaminate.decontaminate(docs, benchmark))
    clean = ids(judged.where("not contaminated"))
    assert ids(stages["decontamination"](spark, docs, SF)) == clean and len(clean) > 100


def test_stages_take_null_empty_repeated_rows_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string"
    prose = " ".join(f"word{i}" for i in range(60))
    rows = [(1, prose), (1, prose), (2, prose + " more"), (None, "no id"), (3, None), (4, ""), (4, ""), (5, " \n ")]
    docs = spark.createDataFrame([(i, t, None, "s", 1, "x") for i, t in rows], schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns, name
        assert not Counter(map(tuple, kept.collect())) - Counter(map(tuple, docs.collect())), name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
    assert Counter(r.doc_id for r in corpus_pipeline.STAGES[2][1](spark, docs, SF).collect()) == Counter([1, None, 3, 4, 5])
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == len(rows) and corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), SF).count() == 0
