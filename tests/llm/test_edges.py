"""Nulls, empty and long texts, repeated rows, empty tables and clashing names, for every operator."""

import collections
import random
import re
import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from veilsift.llm import op01_secrets
from veilsift.llm import op09_toxicity as tox
from veilsift.llm.op01_secrets import find_secrets
from veilsift.llm.op02_line_dedup import dedup_lines
from veilsift.llm.op03_chat_format import format_conversations, read_back
from veilsift.llm.op04_packing import pack
from veilsift.llm.op05_token_counts import apply_edits, attach_edits, build_trees
from veilsift.llm.op06_jaccard_join import jaccard_components, one_of_each
from veilsift.llm.op07_neighbours import nearest
from veilsift.llm.op08_pii import find_personal_data
from veilsift.llm.op10_decontaminate import decontaminate, find_contamination

LONG = "wort " * 60_000 + "x" * 100_000
#: Extra columns bear the names that operators add or use inside.
CLASHING = "doc_id long, text string, spans string, n_lines string, tree string, toxicity string, node string, _id string, n_chars long"
ROWS = [
    (1, "one two three four five six seven eight"),
    (1, "one two three four five six seven eight"),
    (2, "one two three four five six seven eight"),
    (3, None),
    (4, ""),
    (None, "one two three four five six seven eight"),
    (None, None),
    (5, LONG),
    (6, " \n\t\n "),
    (-7, "password = abcdef123 mail me@example.org \U0001f600 +1 555 123 4567"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "s", "l", "t", "x", "n", "i", 7) for i, t in ROWS]
    return spark.createDataFrame(rows, CLASHING)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, None), (None, "a b"), (2, ""), (3, "one two three four five six seven")], "item_id long, text string")


@pytest.fixture(scope="module")
def model(spark, odd):
    labels = spark.createDataFrame([(1, None), (None, 1), (1, 1), (1, 0), (2, 0), (4, 1)], "doc_id long, toxic int")
    return tox.fit(odd, labels)


def doc_operators(bench, model):
    return {
        "secrets": find_secrets,
        "lines": dedup_lines,
        "lines by join": lambda d: dedup_lines(d, most_confirmed=-1),
        "trees": build_trees,
        "pack": lambda d: pack(d.sparkSession, d),
        "jaccard": jaccard_components,
        "pii": find_personal_data,
        "score": lambda d: tox.score(d, model),
        "tiling": lambda d: find_contamination(d, bench),
    }


def test_every_row_has_its_result(odd, bench, model):
    for name, operator in doc_operators(bench, model).items():
        rows = operator(odd).collect()
        if name == "pack":
            assert sum(r["start"] == 0 for r in rows) == len(ROWS)
        elif name == "tiling":
            assert sorted((r["doc_id"] or 0, r["item_id"]) for r in rows) == [(0, 3), (1, 3), (1, 3), (2, 3)]
        else:
            assert sorted((r["doc_id"] or 0) for r in rows) == sorted((i or 0) for i, _ in ROWS), name


def test_empty_tables(odd, bench, model):
    none = odd.where("false")
    for name, operator in doc_operators(bench, model).items():
        assert operator(none).count() == 0, name
    assert one_of_each(none).count() == decontaminate(none, bench).count() == 0
    assert find_contamination(odd, bench.where("false")).count() == 0
    assert decontaminate(odd, bench.where("false")).count() == len(ROWS)


def test_extra_columns_pass(odd, bench, model):
    assert dedup_lines(odd).select("spans", "tree").distinct().collect() == [("s", "t")]
    assert build_trees(odd).select("spans", "n_lines").distinct().collect() == [("s", "l")]
    assert find_secrets(odd).columns[-1] == "spans" and find_secrets(odd).columns.count("spans") == 1
    assert tox.reject_toxic(odd, model).columns == odd.columns
    assert decontaminate(odd, bench).columns == odd.columns
    assert one_of_each(odd).columns == odd.columns


def test_near_duplicates_keep_one_row_of_a_document(odd):
    kept = [(r["doc_id"], r["text"]) for r in one_of_each(odd).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [ROWS[0], *ROWS[3:]]))


def test_stages_run_on_odd_and_empty_documents(spark, odd, tmp_path):
    docs = odd.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), "n_chars")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for table in (docs, docs.where("false")):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, str(tmp_path))
            assert out.columns == docs.columns, name
            assert out.count() <= table.count()
        assert (corpus_pipeline.STAGES[-1][1](spark, table, str(tmp_path)).count() > 0) == (table.count() > 0)


def test_edits_that_do_not_count(spark):
    docs = spark.createDataFrame([(1, "abc def"), (2, None)], "doc_id long, text string")
    edits = [(1, 4, 7, "x y"), (1, 0, 99, "no"), (1, None, 2, "no"), (1, 5, 6, "overlaps"), (2, 0, 0, "new text"), (9, 0, 0, "nobody")]
    table = spark.createDataFrame(edits, "doc_id long, start int, end int, replacement string")
    rows = apply_edits(attach_edits(build_trees(docs), table)).orderBy("doc_id").collect()
    assert [(r["text"], r["n_edits"]) for r in rows] == [("abc x y", 1), ("new text", 1)]
    assert apply_edits(attach_edits(build_trees(docs), table.where("false"))).select(F.sum("n_edits")).first()[0] == 0


def test_conversations(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None), (None, 1, "assistant", "b<s>"), (2, 3, "system", ""), (3, 0, "assistant", LONG)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit("w"))
    back = read_back(format_conversations(table)).collect()
    turns = sorted((str(r["conv_id"]), t["role"], t["text"]) for r in back for t in r["turns"])
    assert turns == sorted((str(c), role or "", text or "") for c, _, role, text in rows)
    assert sorted(t for r in back for t in r["targets"]) == sorted(["b<s>", LONG])
    assert format_conversations(table.where("false")).count() == 0


def test_vectors(spark):
    rows = [
        (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, None]), (6, [float("nan"), 1.0]),
        (7, [float("inf"), 1.0]), (8, []), (None, [1.0, 1.0]), (9, [1.0, 2.0, 3.0]), (1, [0.0, 1.0]), (1, [1.0, 0.0]),
    ]
    table = spark.createDataFrame([(i, v, "r") for i, v in rows], "vec_id long, embedding array<float>, rank string")
    found = nearest(table, F.col("vec_id") < 10, k=3).collect()
    got = sorted({(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in found})
    assert got == [(1, 1, 2, 0.0), (1, 1, 2, 1.414214), (2, 1, 1, 0.0), (2, 2, 1, 1.414214)]
    assert nearest(table.where("false"), F.col("vec_id") < 10).count() == 0


# ------------------------------------------------------- texts made to hurt

MANY = 200_000
#: Each of these ended the JVM, or grew with the square of its length, under a plain form of some rule.
HOSTILE = {
    "labels": ("x@y" + ".ab" * MANY, 0, {"email": 1}),
    "words": ("-----BEGIN " + "AB " * MANY + "PRIVATE KEY-----", 1, {}),
    "letters": ("x" * MANY + " a@b.de", 0, {"email": 1}),
    "local": ("x" * MANY + "@b.de", 0, {"email": 1}),
    "digits": ("7" * MANY, 1, {}),
    "addresses": ("1.2.3.4 " * MANY, 0, {"ip": MANY}),
    "mails": ("ab@c.de " * MANY, 0, {"email": MANY}),
    "tokens": ("eyJ" * MANY + ".eyJaaaaaaaaaa", 0, {}),
    "signs": ("a@" * MANY, 0, {}),
    "dots": ("1." * MANY, 0, {"ip": MANY // 4}),
    "plus": ("+1" * MANY, 0, {}),
    "keys": (("0123456789abcdef" * 2 + " ") * MANY, MANY, {}),
    "assigns": ("password " * MANY, 0, {}),
    "blanks": ("secret" + " " * MANY, 0, {}),
}


def test_hostile_texts_take_linear_time(spark):
    names = sorted(HOSTILE)
    rows = [(i, HOSTILE[name][0]) for i, name in enumerate(names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(len(rows), "doc_id")
    began = time.time()
    secrets = {r["doc_id"]: r["n"] for r in find_secrets(docs).select("doc_id", F.size("spans").alias("n")).collect()}
    kinds = F.transform("spans", lambda s: s["kind"])
    found = find_personal_data(docs).select("doc_id", kinds.alias("kinds")).collect()
    personal = {r["doc_id"]: collections.Counter(k for k in r["kinds"] if not k.startswith("found_")) for r in found}
    for i, name in enumerate(names):
        assert (secrets[i], dict(personal[i])) == HOSTILE[name][1:], name
    assert time.time() - began < 240  # the plain forms do not end


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
}


def test_safe_forms_find_what_the_plain_rules_find(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choices(["a", "@", ".", "-", "_", "b.c", "1", "12", "255.", "7.3.", "256.1.", "é", " ", "%", "x@y.z"], k=rng.randint(1, 14))) for _ in range(4000)]
    heads = ["-----BEGIN " + "".join(rng.choices(["RSA ", "A1 ", " ", "a ", "KEY ", "PRIVATE ", "-"], k=rng.randint(0, 4))) + "PRIVATE KEY-----" for _ in range(500)]
    parts = ["eyJ", "abcdefgh", "eyJabcdefgh", ".", ".eyJabcdefgh", "x", " ", "."]
    tokens = ["".join(rng.choices(parts, k=rng.randint(2, 9))) for _ in range(3000)]
    docs = spark.createDataFrame(list(enumerate(texts + heads + tokens)), "doc_id long, text string")
    rules = {r.kind: r.pattern for r in op01_secrets.ISSUED if r.safe}
    assert set(rules) == {"pem", "bearer"}
    both = find_secrets(find_personal_data(docs.withColumn("own", F.col("text"))).withColumnsRenamed({"own": "text", "spans": "personal"}))
    every = texts + heads + tokens
    hits = collections.Counter()
    for r in both.select("doc_id", "personal", "spans").collect():
        text = every[r["doc_id"]]
        for kind, rule in {**PLAIN, **rules}.items():
            told = [m.span() for m in re.finditer(rule, text) if kind != "ip" or all(int(x) < 256 for x in m.group().split("."))]
            found = [(s["start"], s["end"]) for s in r["personal" if kind in PLAIN else "spans"] if s["kind"] == kind]
            assert found == told, (kind, text)
            hits[kind] += len(told)
    assert min(hits[k] for k in (*PLAIN, *rules)) > 20, hits
