"""Clashing columns, tables without labels, hot groups, stored maps, and the pipeline on awkward tables."""

import re
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import decontam, langid, lm, mixing, ngram_join, secrets, sharding, suffix, tokens
from tests.conftest import SF
from tests.llm.test_operators import brute_repeats, chains, rows_of

CLASHING = ("spans", "n_words", "items", "contaminated", "found", "before", "body", "score", "lang_pred", "positions", "r", "all_spans", "tokens", "row", "base", "more", "h", "d", "times", "copies", "n", "e", "root", "label", "cid", "kind", "N")


def clashing(docs):
    return docs.select("doc_id", "text", "lang", "source", *[F.lit(c).alias(c) for c in CLASHING[:-1]])


def test_clashing_columns_stay(spark, awkward):
    docs = clashing(awkward)
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta"), (2, "lorem ipsum dolor sit amet consectetur adipiscing elit sed do lorem ipsum dolor")], "item_id long, text string")
    for out in (decontam.clean(docs, bench), decontam.clean(docs, bench, "spans"), langid.known(docs, 0.4), secrets.redact(docs), mixing.mixed(docs), ngram_join.one_of_each(docs)):
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[c] == c for r in rows for c in CLASHING[:-1])
    assert 1 not in {r["doc_id"] for r in decontam.clean(docs, bench).collect()}


def test_pipeline_stages_on_awkward_and_empty_tables(spark, awkward):
    for docs in (clashing(awkward), clashing(awkward).limit(0)):
        for _, step in corpus_pipeline.STAGES[:-1]:
            out = step(spark, docs, SF)
            assert out.columns == docs.columns
            assert (out.count() == 0) == (docs.count() == 0)
        last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
        assert last.count() == docs.count()


def test_without_labels_only_rows_without_letters_go(spark, awkward):
    docs = awkward.withColumn("lang", F.lit(None).cast("string"))
    assert langid.known(docs, 0.4).count() == docs.where(F.col("text").rlike(r"\p{L}")).count() > 0


def test_repeated_rows_are_one_to_the_fit(spark, corpus):
    one = corpus.where("lang = 'en'").limit(1).select("doc_id", "text", "lang")
    many = one.withColumn("doc_id", F.lit(8)).crossJoin(spark.range(5000)).drop("id").union(corpus.where("lang <> 'en'").select("doc_id", "text", "lang"))
    assert "en" in langid.fit(many).labels


def test_mixed_shares_repeats_of_equal_rows(spark):
    rows = [(None, "a", "one two three")] * 7 + [(1, "a", "one two three"), (1, "b", "one two three"), (2, None, "four five"), (3, "b", "")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    words = sum(r["taken"] for r in mixing.mix(docs).collect())
    got = mixing.mixed(docs).collect()
    assert sum(len(r["text"].split()) for r in got) == words


def test_slot_map_is_kept_and_edited(spark, corpus, tmp_path):
    path = str(tmp_path / "map")
    first, versions = sharding.shard_records(corpus, path=path)
    assert {r["version"] for r in versions.collect()} == {1, 2}
    before = {(r["vslot"], r["version"]): r["shard"] for r in sharding.stored_map(spark, path).collect()}
    placed, _ = sharding.shard_records(corpus.union(corpus.withColumn("doc_id", F.col("doc_id") + 100_000)), path=path)
    after = {(r["vslot"], r["version"]): r["shard"] for r in sharding.stored_map(spark, path).collect()}
    assert {v for _, v in after} == {1, 2, 3} and all(after[k] == s for k, s in before.items())
    sizes = placed.groupBy("shard").agg(F.sum("size").alias("s"), F.count("*").alias("n"), F.max("slot").alias("m"), F.countDistinct("slot").alias("d")).collect()
    assert all(r["n"] == r["m"] + 1 == r["d"] for r in sizes)
    texts = {d["doc_id"]: (d["text"] or "").encode() for d in rows_of(corpus)}
    for r in first.collect():
        assert (r["size"], r["text_crc32"]) == (len(texts[r["doc_id"]]) + 1, zlib.crc32(texts[r["doc_id"]]))


def test_any_token_of_many_files(spark, corpus, tmp_path, monkeypatch):
    from tessera.llm.queries import tokenizer_path

    monkeypatch.setattr(tokens, "FILE_IDS", 3000)
    path = str(tmp_path / "files")
    every = tokens.tokenize(corpus.select("doc_id", "text").limit(40), tokenizer_path()).orderBy("doc_id").collect()
    ids = np.concatenate([np.frombuffer(r["ids"], f"<u{r['width']}") for r in every])
    tokens.encode_corpus(corpus.select("doc_id", "text").limit(40), tokenizer_path(), path, "uncompressed")
    assert spark.read.parquet(path).count() > 1
    for i in (0, 2999, len(ids) // 2, len(ids) - 1):
        assert tokens.token_at(spark, path, i) == ids[i]
    with pytest.raises(IndexError):
        tokens.token_at(spark, path, len(ids))


def test_hot_suffixes_give_the_same_spans(spark, monkeypatch):
    monkeypatch.setattr(suffix, "HOT", 3)
    docs = chains(spark)
    got = suffix.repeats(docs).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_repeated"], str([(s["start"], s["stop"]) for s in r["spans"]])) for r in got) == brute_repeats(rows_of(docs))


def test_many_matches_in_one_text(spark):
    text = " é".join(f"{i:030x}" + "z" * (i % 3) for i in range(700))
    (r,) = secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    want = [(m.start(), m.end()) for m in re.finditer("[0-9a-f]{24,}", text)]
    assert [(s["start"], s["stop"]) for s in r["all_spans"] if s["kind"] == 2] == want


def test_lm_hardly_depends_on_partitions(spark, corpus, monkeypatch):
    monkeypatch.setattr(lm, "COPY_TOKENS", 15_000)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = []
    for n in (3, 16):
        r = lm.score(docs.repartition(n)).where("held_out").agg(F.sum("score") / F.sum("n_tokens"), F.sum("base_score") / F.sum("n_tokens")).first()
        got.append(r[0])
    assert abs(got[0] - got[1]) < 0.02 and min(got) > r[1]


@pytest.mark.parametrize("call, known", [('ngram_join.join(docs).select("doc_id", "component_id")', [(1, 1), (2, 1), (3, 3), (4, 4)]), ('corpus_pipeline.join_near_duplicates(spark, docs, "").select("doc_id")', [(1,), (3,), (4,)])])
def test_ngram_join_in_workers_that_ran_nothing_before(call, known):
    code = f"""
from pyspark.sql import SparkSession
import corpus_pipeline
from tessera.llm import ngram_join
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.python.worker.reuse", "false").getOrCreate()
rows = [(2, "a b c d e f"), (1, "a b c d e  f"), (3, "other words"), (4, None)]
docs = spark.createDataFrame(rows, "doc_id long, text string")
print("found", sorted(map(tuple, {call}.collect())))
"""
    run = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[2], capture_output=True, text=True)
    assert f"found {known}" in run.stdout, run.stderr[-3000:]


def test_pipeline_in_new_workers_gives_what_the_sql_of_its_stages_gives(spark, tmp_path):
    import duckdb
    import pandas as pd
    from tokenizers import Tokenizer

    from tessera.llm import queries

    code = f"""
from pyspark.sql import SparkSession
import corpus_pipeline
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.python.worker.reuse", "false").getOrCreate()
corpus_pipeline.run(spark, {SF!r}).write.parquet("{tmp_path}/out")
"""
    run = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[2], capture_output=True, text=True)
    assert run.returncode == 0, run.stderr[-3000:]
    known = [r["doc_id"] for r in queries.op4_language_id(spark, SF).collect() if r["lang_pred"] != "und" and r["score"] >= corpus_pipeline.MIN_SCORE]
    con = duckdb.connect()
    con.execute(f"create view benchmark as select * from '{SF}/benchmark.parquet'")

    def keep(ids):
        con.register("kept", pd.DataFrame({"doc_id": list(ids)}, dtype="int64"))
        con.execute(f"create or replace table documents as select * from '{SF}/documents.parquet' semi join kept using (doc_id)")

    keep(known)
    keep(d for d, n, c in con.execute(queries.OP9_SQL).fetchall() if n == 0 or d == c)
    keep(r[0] for r in con.execute(queries.OP3_SQL).fetchall() if not r[5])
    times = {d: taken // size for d, size, _, _, taken in con.execute(queries.OP2_SQL).fetchall() if taken}
    tokenizer, want, start = Tokenizer.from_file(queries.tokenizer_path()), [], 0
    for d, text in con.execute("select doc_id, text from documents order by doc_id").fetchall():
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4") if d in times else []
        for _ in range(times.get(d, 0)):
            want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
    got = spark.read.parquet(f"{tmp_path}/out").select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert want and sorted(map(tuple, got)) == want
