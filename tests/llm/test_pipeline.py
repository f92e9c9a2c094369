import corpus_pipeline as pipeline
from pyspark.sql import functions as F

from quillstone.llm import quality

DATA = "/root/testdata/sf0.01"


def shingles(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({65 + k: 97 + k for k in range(26)}))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def test_stages_match_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    (_, good), (_, distinct), (_, unlike), (_, clean), (_, mix) = pipeline.STAGES
    first = good(spark, docs, DATA).cache()
    model = quality.train(docs, spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", F.col("quality").alias("label")))
    want = {r["doc_id"] for r in quality.judged(docs, model, "doc_id").filter("score >= 0.7").collect()}
    rows = {r["doc_id"]: r for r in first.collect()}
    assert set(rows) == want and first.columns == docs.columns

    second = distinct(spark, first, DATA).cache()
    last = {}
    for i in sorted(rows):
        last[rows[i]["text"] or ""] = i
    assert {r["doc_id"] for r in second.collect()} == set(last.values()) and second.columns == docs.columns

    third = unlike(spark, second, DATA).cache()
    sets = {i: shingles(rows[i]["text"]) for i in last.values()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    owners = {}
    for i, s in sets.items():
        for g in s:
            owners.setdefault(g, []).append(i)
    pairs = {(a, b) for ids in owners.values() for a in ids for b in ids if a < b}
    for a, b in pairs:
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            p, q = sorted((find(a), find(b)))
            root[q] = p
    kept = {i for i in root if find(i) == i}
    assert {r["doc_id"] for r in third.collect()} == kept and third.columns == docs.columns

    fourth = clean(spark, third, DATA).cache()
    items = [shingles(r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    leaked = {i for i in kept if any(s and 100 * len(s & sets[i]) >= 80 * len(s) for s in items)}
    assert leaked and {r["doc_id"] for r in fourth.collect()} == kept - leaked and fourth.columns == docs.columns

    assert {r["doc_id"] for r in mix(spark, fourth, DATA).collect()} <= kept - leaked


def test_run_on_the_smallest_tables(spark):
    out = pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and set(out.columns) == {*pipeline.COLUMNS, "copy", "place"}


def test_rows_without_an_id_of_their_own(spark):
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").filter("text is not null").orderBy("item_id").first()["text"]
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    near = b + " more"
    rows = [(None, a), (None, a), (1, b), (1, b), (2, c), (2, "x " + item), (None, item + " y"), (3, b), (None, near), (None, near), (7, "alone")]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    _, (_, distinct), (_, unlike), (_, clean), _ = pipeline.STAGES
    told = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    want = [(None, a), (3, b), (2, c), (2, "x " + item), (None, item + " y"), (None, near), (7, "alone")]
    second = distinct(spark, docs, DATA).cache()
    assert told(second) == sorted(want, key=str) and second.columns == docs.columns
    left = [(i, t) for i, t in want if (i, t) != (None, near)]
    third = unlike(spark, docs, DATA)
    texts = sorted(r["text"] for r in third.collect())
    assert len([t for t in texts if t in (b, near)]) == 1 and texts.count(a) == 1 and texts.count(c) == 1
    third = unlike(spark, second, DATA).cache()
    got = told(third)
    assert (None, near) not in got and set(got) <= set(left) and {(None, a), (3, b), (2, c), (7, "alone")} <= set(got)
    assert told(clean(spark, third, DATA)) == sorted([(None, a), (3, b), (2, c), (7, "alone")], key=str)
    assert told(clean(spark, docs, DATA)) == sorted([r for r in rows if item not in r[1]], key=str)


ODD = ["row_id", "document", "shared_id", "kept", "score", "label", "n"]


def test_stages_keep_columns_of_any_name_and_take_odd_rows(spark):
    long = " ".join(f"w{k % 997}" for k in range(60_000))
    rows = [(1, None), (2, ""), (3, " \t"), (4, "one two"), (5, long), (6, long), (7, long + " end"), (None, None), (None, "x y"), (8, "a b c d e f"), (8, "a b c d e f")]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select("*", *(F.lit(c).alias(c) for c in ODD))
    (_, good), (_, distinct), (_, unlike), (_, clean), (_, mix) = pipeline.STAGES
    told = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    model = quality.train(docs, spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", F.col("quality").alias("label")))
    scores = [r["score"] for r in quality.judged(docs, model, "doc_id").collect()]
    assert good(spark, docs, DATA).count() == sum(x >= 0.7 for x in scores)
    assert told(distinct(spark, docs, DATA)) == sorted([(2, ""), (3, " \t"), (4, "one two"), (6, long), (7, long + " end"), (None, "x y"), (8, "a b c d e f")], key=str)
    assert told(unlike(spark, docs, DATA)) == sorted([(1, None), (2, ""), (3, " \t"), (4, "one two"), (5, long), (None, None), (None, "x y"), (8, "a b c d e f")], key=str)
    assert told(clean(spark, docs, DATA)) == sorted(rows, key=str)
    for _, stage in pipeline.STAGES:
        for table in (docs, docs.limit(0)):
            found = stage(spark, table, DATA)
            assert found.columns == docs.columns + ["copy", "place"] * (stage is mix)
            assert all(r[c] == c for r in found.collect() for c in ODD)
        assert stage(spark, docs.limit(0), DATA).count() == 0
