"""The pipeline on planted documents, each stage held against a brute-force version on its own input."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from storeyline.llm import common, pii, tokens
from test_operators import brute_components, check_packing, prose


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    folder, r = str(tmp_path_factory.mktemp("pipeline")), random.Random(11)
    items = [(i, prose(r, 25)) for i in range(5)]
    rows, labels = [], []
    for i in range(400):
        words = prose(r, r.randrange(20, 90)).split()
        if i % 5 == 0:
            words[r.randrange(len(words))] = r.choice(["blarg", "Grizzle,"])
        labels.append((i, 1, int(i % 5 == 0)))
        if i % 40 == 3:
            words += items[i % 5][1].upper().split()
        if i % 10 == 7:
            words += ["mail", f"x{i}@mail.example.com", "end"]
        rows.append((i, " ".join(words), "en", f"s{i % 3}", 1))
    copies = [rows[i][1] for i in (1, 2, 4, 6, 8, 9)]
    rows += [(1000 + i, t + " extra" * (i % 2), "en", "s0", 1) for i, t in enumerate(copies)]
    rows += [(2000, None, None, None, None), (2001, "", "en", None, 0), (None, "no id at all", "en", "s1", 12), (None, None, None, None, None), (2002, "twice the same row is one in the end", "en", "s1", 1), (2002, "twice the same row is one in the end", "en", "s1", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([*items, (9, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    stages, docs = {}, spark.read.parquet(f"{folder}/documents.parquet")
    for name, f in corpus_pipeline.STAGES:
        before = docs
        f(spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        stages[name] = (before.collect(), docs.collect())
    return folder, items, stages


def test_columns(planted):
    for name, (before, after) in planted[2].items():
        if name != "packing":
            assert after[0].asDict().keys() == before[0].asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars"}


def test_toxic_documents_go_and_clean_ones_stay(planted):
    before, after = planted[2]["toxicity"]
    kept = {r.doc_id for r in after}
    toxic = {r.doc_id for r in before if re.search("blarg|Grizzle", r.text or "")}
    assert len(toxic & kept) <= len(toxic) // 50 and len({r.doc_id for r in before} - toxic - kept) <= 5
    assert sum(r.doc_id is None for r in after) == 2 and {2000, 2001} <= kept


def test_one_of_each_group_stays(planted):
    before, after = planted[2]["near_duplicates"]
    rows = sorted({(r.doc_id, r.text) for r in before if r.doc_id is not None})
    want = [rows[i][0] for i, (_, c) in enumerate(brute_components([t for _, t in rows], 80)) if c == i]
    assert sorted(r.doc_id for r in after if r.doc_id is not None) == want
    assert sum(r.doc_id is None for r in after) == 2


def test_rows_that_share_an_id_count_by_their_texts(spark):
    r = random.Random(4)
    a, b, c, d = (prose(r, 40) for _ in range(4))
    rows = [(1, a), (5, b), (5, c), (5, a), (6, b + " x"), (7, c), (8, d), (8, d), (8, None), (8, None), (8, ""), (9, "")]
    docs = spark.createDataFrame([(*x, "en", "s", 1) for x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(x.doc_id, x.text) for x in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    assert sorted(kept, key=str) == sorted([(1, a), (5, b), (5, c), (8, d), (8, None), (8, ""), (9, "")], key=str)


def test_clashing_and_map_columns_pass_through(spark, planted):
    folder = planted[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 30 or doc_id >= 2000 or doc_id is null")
    names = ["score", "spans", "redacted", "__text", "row", "n", "kind", "rep"]
    docs = docs.select("*", *(F.lit(i).alias(c) for i, c in enumerate(names)), F.create_map(F.lit("k"), F.lit(1)).alias("m"))
    for name, f in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = common.written(f(spark, docs, folder))
        assert set(names) | {"m"} < set(docs.columns), name
        rows = docs.collect()
        assert 0 < len(rows) <= before and all(r[c] == i for r in rows for i, c in enumerate(names)) and all(r.m == {"k": 1} for r in rows)


def test_leaks_go(planted):
    _, items, stages = planted
    before, after = stages["decontamination"]
    leaked = {r.doc_id for r in before if any(t in (r.text or "").lower() for _, t in items)}
    assert leaked and {r.doc_id for r in after} == {r.doc_id for r in before} - leaked and len(after) == len(before) - len(leaked)


def test_personal_data_is_replaced(planted):
    before, after = planted[2]["pii"]
    assert sorted(str((r.doc_id, pii.redacted(r.text, pii.find_spans(r.text)))) for r in before) == sorted(str((r.doc_id, r.text)) for r in after)
    assert not any("@" in (r.text or "") for r in after) and any("[EMAIL]" in (r.text or "") for r in after)
    assert all(r.n_chars == len(r.text) for r in after if r.text is not None)


def test_pieces(planted):
    from tokenizers import Tokenizer

    before, after = planted[2]["packing"]
    library = Tokenizer.from_file(tokens.tokenizer_path(corpus_pipeline.VOCABULARY))
    known = [(r.doc_id, r.text) for r in before if r.doc_id is not None]
    by_id = [p for p in after if p.doc_id is not None]
    others = sum(p.length for p in after if p.doc_id is None)
    assert others == sum(len(library.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in before if r.doc_id is None)
    total = sum(p.length for p in after)
    assert max(p.sequence_id for p in after) == (total - 1) // 4096
    assert {p.doc_id for p in by_id} == {i for i, _ in known}
    if not others:
        check_packing(after, known, library, 4096)


def test_run(spark, planted):
    folder, _, stages = planted
    rows = corpus_pipeline.run(spark, folder).select("doc_id", "start", "length", "ids_crc32").collect()
    want = stages["packing"][1]
    assert sum(r.length for r in rows) == sum(p.length for p in want) and {r.doc_id for r in rows} == {p.doc_id for p in want}
