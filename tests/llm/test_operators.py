"""Each operator against brute force, and on nulls, empty and repeated rows, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from oracle import DATA, same
from pyspark.sql import functions as F

from quillstone.llm import chat_format, decontaminate, exact_dedup, language_id, mixing, near_dedup, quality, queries, secret_scan, suffix_tree
from quillstone.llm.components import components
from quillstone.llm.token_rollup import TOKENIZERS, TokenRollup, signed, tokenizer

ODD = "doc_id long, text string, lang string, source string, n_chars long, label int, score double, copy int, node long, digest string, bucket string, place string"


def odd_rows(spark, rows):
    """Rows (doc_id, text) with further columns whose names clash with what operators use inside."""
    return spark.createDataFrame([(i, t, None, None, None, 1, 0.5, 7, 3, "d", "b", "p") for i, t in rows], ODD)


def words(text):
    low = (text or "").translate({65 + k: 97 + k for k in range(26)})
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def shingles(text):
    w = words(text)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


LONG = " ".join(f"w{k % 997}" for k in range(60_000))
CASES = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "One  TWO"), (6, LONG), (7, LONG + " end"), (8, "a b c d e f"), (8, "a b c d e f"), (None, "x y"), (None, None), (9, "日本語 ß é 🙂 text ok")]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_gives_the_rows_of_its_sql(spark, name):
    same(queries.QUERIES[name](spark, DATA), queries.SQL[name])


# Chat formatting


def test_chat_edges(spark):
    rows = [(1, 1, "assistant", None), (1, 0, "user", "a\\<|im_end|>\n|"), (1, 0, "user", "a\\<|im_end|>\n|"), (None, None, None, None), (2, 5, "as\nsistant", "\\n"), (2, 6, "assistant", "<|im_end|>")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("x"))
    got = {r["conv_id"]: r for r in chat_format.formatted(df).collect()}
    for conv in (1, 2, None):
        turns = sorted(((-1 if t is None else t, r or "", x or "") for c, t, r, x in rows if c == conv))
        assert chat_format.parsed(got[conv]["formatted"]) == [(r, x) for _, r, x in turns]
    assert "".join(chat_format.unescape(got[2]["formatted"][a:b]) for a, b in got[2]["loss_spans"]) == "<|im_end|>"
    assert chat_format.formatted(df.limit(0)).count() == 0 and chat_format.digest(chat_format.formatted(df)).count() == 3


def test_templates_that_rewrite_history_are_told():
    turns = [("user", "a"), ("assistant", "b"), ("user", "c")]
    last_only = lambda ts: "".join(f"[{r}:{t if k == len(ts) - 1 or r == 'user' else ''}]" for k, (r, t) in enumerate(ts))
    found = chat_format.rendered(turns, last_only)
    assert found.rewritten_at == 2 and found.loss(["user", "assistant", "user"]) is None
    fine = chat_format.rendered(turns)
    assert [fine.text[a:b] for a, b in fine.loss([r for r, _ in turns])] == ["b"]


def test_chat_of_many_turns_and_of_very_long_texts(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", f"turn {k} \x00 {'<|im_end|>' * (k % 3)}") for k in range(400)] + [(2, 0, "user", LONG * 3), (2, 1, "assistant", LONG)]
    got = {r["conv_id"]: r for r in chat_format.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    for conv, r in got.items():
        assert chat_format.parsed(r["formatted"]) == [(role, t) for c, _, role, t in rows if c == conv]
        assert [chat_format.unescape(r["formatted"][a:b]) for a, b in r["loss_spans"]] == [t for c, _, role, t in rows if c == conv and role == "assistant"]


def test_a_template_that_drops_the_probe():
    plain = lambda turns: "".join(f"[{r}|{t.strip(chr(0))}]" for r, t in turns)
    found = chat_format.rendered([("user", "a"), ("assistant", "bc")], plain)
    assert found.rewritten_at is None and len(found.texts) == 2


# Token counts


def test_rollup(spark, tmp_path):
    rollup = TokenRollup(spark, f"file://{tmp_path}/totals")
    assert rollup.totals().count() == 0
    row = lambda s, l, t: (s, l, t)  # noqa: E731, E741
    df = lambda rows: spark.createDataFrame(rows, "source string, lang string, text string").withColumn("sign", F.lit(9))
    old = [row("a", "en", "hello there"), row("a", "en", None), row(None, None, "x"), row("b", "de", "eins zwei")]
    assert rollup.apply("1", signed(inserts=df(old))) and not rollup.apply("1", signed(inserts=df(old)))
    assert rollup.apply("2", signed(inserts=df([row("b", "de", "eins zwei drei")]), deletes=df([old[3], old[2]])))
    assert rollup.apply("3", signed(inserts=df([]).limit(0)))
    encode = tokenizer(TOKENIZERS["byte_bpe_50k"]).encode_ordinary
    told = lambda: {(r["source"], r["lang"]): (r["n_docs"], r["n_tokens"], r["n_bytes"]) for r in TokenRollup(spark, rollup.folder).totals().filter("tokenizer = 'byte_bpe_50k'").collect()}
    got = told()
    assert rollup.compact() and not rollup.compact() and told() == got and len(rollup.deltas()) == 1
    for name in ("", "n" * 300):
        assert not rollup.committed(name) and rollup.apply(name, signed(inserts=df([row("z", "en", name)]))) and not rollup.apply(name, signed(inserts=df(old)))
    assert not rollup.apply("1", signed(inserts=df(old))) and len(rollup.deltas()) == 3
    assert rollup.compact() and rollup.apply("gone", signed(deletes=df([row("z", "en", ""), row("z", "en", "n" * 300)]))) and rollup.compact() and told() == got
    assert got == {("a", "en"): (2, len(encode("hello there")), 11), ("b", "de"): (1, len(encode("eins zwei drei")), 14)}


def test_token_query_counts_all_documents(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("source", "lang", "text").collect()
    want = {}
    for version, path in TOKENIZERS.items():
        encode = tokenizer(path).encode_ordinary
        for r in rows:
            text = r["text"] or ""
            old = want.get((r["source"], r["lang"], version), (0, 0, 0))
            want[r["source"], r["lang"], version] = tuple(a + b for a, b in zip(old, (1, len(encode(text)), len(text.encode()))))
    got = queries.op2_token_counts(spark, DATA).collect()
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got} == want and len(got) == len(want)


def test_rollup_of_a_very_long_text(spark, tmp_path):
    rollup = TokenRollup(spark, f"file://{tmp_path}/totals")
    assert rollup.apply("1", signed(inserts=odd_rows(spark, [(1, "word " * 400_000), (1, LONG)])))
    encode = tokenizer(TOKENIZERS["byte_bpe_50k"]).encode_ordinary
    assert rollup.totals().filter("tokenizer = 'byte_bpe_50k'").first()["n_tokens"] == len(encode("word " * 400_000)) + len(encode(LONG))


# Decontamination


def test_leaks_match_brute_force(spark):
    draw = random.Random(2)
    items = [(k, " ".join(f"i{draw.randrange(40)}" for _ in range(draw.choice([3, 5, 8, 30])))) for k in range(30)] + [(90, None), (91, " "), (92, "one TWO"), (None, "a b c d e")]
    docs = list(CASES)
    for k in range(40):
        w = items[draw.randrange(30)][1].split()
        if draw.random() < 0.5:
            w[draw.randrange(len(w))] = "changed"
        docs.append((100 + k, " ".join(["pre"] * draw.randrange(20) + w + ["post"] * draw.randrange(2000))))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    def runs(w, n):
        return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}

    want = []
    for i, t in items:
        n = min(len(words(t)), 5)
        for d, x in docs if n else []:
            item, common = runs(words(t), n), runs(words(t), n) & runs(words(x), n)
            if 100 * len(common) >= 80 * len(item):
                want.append((d, i, len(item), len(common)))
    want = sorted(want, key=str)
    assert any(n == 1 and d != 5 and d is not None and d >= 100 for d, _, n, _ in want)  # short items inside longer documents
    for block in (decontaminate.BLOCK_SHINGLES, 40):
        got = sorted((tuple(r) for r in decontaminate.leaks(odd_rows(spark, docs), bench, block_shingles=block).collect()), key=str)
        assert got == want and len(want) > 10
    assert decontaminate.leaks(odd_rows(spark, []), bench).count() == 0 and decontaminate.leaks(odd_rows(spark, docs), bench.limit(0)).count() == 0


# Language-model scores


def brute_base(rows, held):
    counts = Counter(w for i, t in rows if not held(i) for w in [*words(t), None])
    n, v = sum(counts.values()), len(counts)
    return {i: (len(words(t)) + 1, sum(counts[w] > 0 for w in [*words(t), None]), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in [*words(t), None])) for i, t in rows}


def test_scores(spark):
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    want = brute_base([tuple(r) for r in rows], held)
    got = queries.op4_lm_scores(spark, DATA).collect()
    assert len(got) == len(rows)
    for r in got:
        n, known, total, base = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (n, known, total, held(r["doc_id"]))
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and -1e9 < r["score"] < 0
    out = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_scores_edges(spark):
    got = suffix_tree.scored(odd_rows(spark, CASES)).collect()
    assert len(got) == len(CASES) and sum(r["doc_id"] == 8 for r in got) == 2
    want = brute_base(CASES, lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["n_tokens"] == 1 and by[6]["n_tokens"] == 60_001
    assert all(by[i]["base_score"] == pytest.approx(want[i][3], rel=1e-9) for i in (1, 2, 4, 6, 8, 9))
    assert suffix_tree.scored(odd_rows(spark, [])).count() == 0


def learnt(df, *args):
    return suffix_tree.Model(df.select("doc_id", "text", F.lit(True).alias("learnt")), *args)


def test_every_state_sums_to_one(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    model = learnt(spark.createDataFrame(rows, "doc_id long, text string"), 1)
    counts = sorted(c for c in Counter(w for _, t in rows for w in [*words(t), None]).values() if c > 1)
    root = 1 - sum((c + 1) / model.scale for c in counts)
    told = model.told().collect()
    terms, weights = {}, {r["w1"]: r["gain"] for r in told if not r["w2"]}
    for r in told:
        if r["w2"]:
            terms.setdefault(r["w1"], {})[r["w2"]] = r["gain"]
    assert len(weights) > 10 and set(terms) == set(weights)
    # The words' own root probabilities: a state's probability of w is root(w) times 10 ** (weight + term).
    shares = {r["id"]: (r["count"] + 1) / model.scale for r in numbers_of(model, rows)}
    for state, weight in sorted(weights.items())[:20]:
        inside = sum(p * 10 ** (weight + terms[state].get(w, 0)) for w, p in shares.items())
        assert inside + root * 10**weight == pytest.approx(1, abs=1e-9)


def numbers_of(model, rows):
    """(id, count) of the kept words, read off the coded texts."""
    found = {}
    for r in model.coded.collect():
        kept, often, _ = suffix_tree.unpacked(bytes(r["a"]))
        found |= dict(zip(kept.tolist(), often.tolist()))
    return [{"id": k, "count": c} for k, c in found.items()]


def test_packed_columns_come_back():
    import numpy as np

    columns = [np.array([0, 5, 255]), np.array([1 << 40, 3]), np.array([], np.int64), np.array([-1.5, 2.25])]
    assert all((a == b).all() for a, b in zip(suffix_tree.unpacked(suffix_tree.packed(*columns)), columns))


def brute_scores(texts, depth, least):
    """log10 probability of each text under a tree learnt from all of them, word by word."""
    rows = [[None, *words(t), None] for t in texts]
    single = Counter(w for r in rows for w in r[1:])
    n, v = sum(single.values()), len(single)
    grams = Counter(tuple(r[i : i + k]) for r in rows for k in range(2, depth + 2) for i in range(len(r) - k + 1))
    after, whole = {}, Counter()
    for g, c in grams.items():
        whole[g[:-1]] += c
        if c >= least:
            after.setdefault(g[:-1], {})[g[-1]] = c
    states = {}

    def p(context, w):
        if not context:
            return (single[w] + 1) / (n + v + 1)
        if context not in states:
            return p(context[1:], w)
        entries, weight = states[context]
        return entries[w] if w in entries else weight * p(context[1:], w)

    for context in sorted(after, key=len):
        follow, total = after[context], whole[context]
        shorter = {w: p(context[1:], w) for w in follow}
        rest, other = max(1 - sum(shorter.values()), 1e-12), total - sum(follow.values())
        gain = sum(c * math.log(c / total / shorter[w]) for w, c in follow.items()) + (other * math.log(other / total / rest) if other else 0)
        k = len(follow)
        if gain >= k * (1 - 2 / (9 * k) + 1.6448536269514722 * math.sqrt(2 / (9 * k))) ** 3 / 2:
            states[context] = {w: c / (total + len(follow)) for w, c in follow.items()}, (other + len(follow)) / (total + len(follow)) / rest
    return [sum(math.log10(p(tuple(r[max(0, i - depth) : i]), r[i])) for i in range(1, len(r))) for r in rows], states


def passages(draw):
    """Texts of many words, half of which hold one of a few passages of rare words."""
    fixed = [" ".join(f"p{k}x{j}" for j in range(6)) for k in range(12)]
    texts = []
    for _ in range(150):
        w = [f"c{int(draw.random() ** 3 * 60)}" if draw.random() < 0.7 else f"r{draw.randrange(4000)}" for _ in range(draw.randrange(5, 60))]
        if draw.random() < 0.5:
            w.insert(draw.randrange(len(w)), draw.choice(fixed))
        texts.append(" ".join(w))
    return texts


@pytest.mark.parametrize("depth, hot", [(2, 4), (3, 4), (2, 10**9)])
def test_scores_match_brute_force_with_every_sequence(spark, monkeypatch, depth, hot):
    monkeypatch.setattr(suffix_tree, "_HOT", hot)  # with the last, every word is hot
    texts = passages(random.Random(4)) + ["", "c1 " * 30]
    want, states = brute_scores(texts, depth, 2)
    assert sum(len(s) == depth for s in states) > 0 and any(s[-1] and s[-1].startswith("p") for s in states)
    got = {r["doc_id"]: r["score"] for r in suffix_tree.scored(odd_rows(spark, list(enumerate(texts))), "true", depth=depth).collect()}
    assert [got[k] for k in range(len(texts))] == pytest.approx(want, rel=1e-9)


def test_triples_of_uncommon_words_are_kept(spark):
    """Each word of the passage has a share of 4e-5, under the 4.6e-4 that a triple's words once needed."""
    rows = [(k, "one rare passage") for k in range(20)] + [(100 + k, " ".join(f"w{(k * 7919 + j * j) % 211}" for j in range(10_000))) for k in range(50)]
    assert learnt(odd_rows(spark, rows)).told().filter("w3 > 0").count() >= 1
    with_it, without = (suffix_tree.scored(odd_rows(spark, rows[k:]), "true").filter("doc_id = 19").first()["score"] for k in (0, 19))
    assert with_it > without + 1


def test_a_sequence_is_kept_at_any_size(spark):
    """Two occurrences beside 12 million tokens: a share of 1.7e-7, under the 2e-7 that was once needed."""
    filler = spark.range(1200).select((F.col("id") + 10).alias("doc_id"), F.lit("a b " * 5000).alias("text"))
    rows = spark.createDataFrame([(1, "one rare passage"), (2, "one rare passage")], "doc_id long, text string")
    model = learnt(rows.unionByName(filler))
    assert model.tokens > 12_000_000 and model.told().filter("w2 > 0").count() >= 4
    got = {r["doc_id"]: r for r in suffix_tree.scored(rows.unionByName(filler), "true").filter("doc_id < 3").collect()}
    assert got[1]["score"] == got[2]["score"] > got[1]["base_score"] + 10


def test_scores_match_brute_force_with_many_buckets(spark):
    """Most buckets of most chunks are empty."""
    texts = passages(random.Random(7)) + ["", "c1 " * 30]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        got = {r["doc_id"]: r["score"] for r in suffix_tree.scored(odd_rows(spark, list(enumerate(texts))), "true", depth=3).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [got[k] for k in range(len(texts))] == pytest.approx(brute_scores(texts, 3, 2)[0], rel=1e-9)


@pytest.mark.parametrize("learn", [True, False])
def test_a_packet_costs_a_few_calls(learn):
    """Packets grow as the square of the corpus: each must cost little beside what is done once a chunk."""
    import sys

    import numpy as np
    import pyarrow as pa

    draw, rows = np.random.default_rng(5), pa.BufferOutputStream()
    table = pa.table({"n_tokens": pa.array([49_999]), "held_out": pa.array([False])})
    with pa.ipc.new_stream(rows, table.schema) as out:
        out.write_table(table)
    kept = np.arange(1, 20_001)
    chunk = (0, 4, 0, 0, suffix_tree.packed(kept, kept, draw.integers(1, 20_001, 50_000)), rows.getvalue().to_pybytes())

    def made(buckets):
        calls = 0

        def counted(frame, event, arg):
            nonlocal calls
            calls += event in ("call", "c_call")

        batches = list(suffix_tree._packets([chunk]))
        sys.setprofile(counted)
        try:
            packets = sum(b.num_rows for b in suffix_tree._runs(buckets, 3, 1e9, learn)(iter(batches)))
        finally:
            sys.setprofile(None)
        return calls, packets

    (few, _), (many, packets) = made(10), made(1000)
    assert packets <= 1000 and (many - few) / 990 < 40


def test_words_that_collide_without_a_key_are_told_apart(spark):
    """A Thue-Morse word and its complement, equal under any polynomial modulo a power of two."""
    a = "".join("ab"[bin(k).count("1") & 1] for k in range(1024))
    b = a.translate(str.maketrans("ab", "ba"))
    rows = odd_rows(spark, [(1, a), (2, b)])
    assert learnt(rows).distinct == 3
    assert {r["component_id"] for r in near_dedup.near_duplicates(rows).collect()} == {1, 2}
    item = spark.createDataFrame([(1, a)], "item_id long, text string")
    assert [r["doc_id"] for r in decontaminate.leaks(rows, item).collect()] == [1]


# Near duplicates


def brute_classes(rows, percent):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, x in sets:
        for b, y in sets:
            if x and y and a < b and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: find(i) for i in root}


@pytest.fixture
def crowded(monkeypatch):
    """Limits so low that a few rows make a hot key, a salted document and a bucket of many blocks."""
    from quillstone.llm import spread

    monkeypatch.setattr(spread, "HOT_ROWS", 4)
    monkeypatch.setattr(near_dedup, "HOT_ROWS", 2)
    monkeypatch.setattr(near_dedup, "_MEMBERS", 3)


def test_hot_keys_change_nothing(spark, crowded):
    base = [f"v{k}" for k in range(60)]
    rows = [(k, " ".join(base)) for k in range(1, 30)]
    draw = random.Random(6)
    for k in range(40):
        copy = list(base)
        for at in draw.sample(range(60), draw.randrange(1, 6)):
            copy[at] = f"n{k}x{at}"
        rows.append((100 + k, " ".join(copy)))
    rows += [(200 + k, "same short text") for k in range(12)]
    want = brute_classes(rows, 80)
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(odd_rows(spark, rows), 80).collect()} == want
    got = exact_dedup.exact_duplicates(odd_rows(spark, rows)).collect()
    assert {r["doc_id"]: r["keep_id"] for r in got if r["doc_id"] < 30 or r["doc_id"] >= 200} == {k: 29 for k in range(1, 30)} | {200 + k: 211 for k in range(12)}
    star = spark.createDataFrame([(0, k) for k in range(1, 40)], "a long, b long")
    assert {r["component"] for r in components(star).collect()} == {0}


def test_near_duplicates_match_brute_force(spark):
    draw = random.Random(3)
    rows = list(CASES)
    for family in range(12):
        base = [f"f{family}v{draw.randrange(500)}" for _ in range(draw.choice([6, 40, 120]))]
        for k in range(10):
            copy = list(base)
            for _ in range(draw.randrange(4)):
                copy[draw.randrange(len(copy))] = f"new{draw.randrange(10**6)}"
            rows.append((100 + family * 10 + k, " ".join(copy)))
    for percent in (80, 85):
        want = brute_classes(rows, percent)
        got = near_dedup.near_duplicates(odd_rows(spark, rows), percent).collect()
        assert len(got) == len(rows)
        for r in got:
            assert r["component_id"] == (want[r["doc_id"]] if r["doc_id"] is not None else None)
            assert r["kept"] == (r["doc_id"] is None or r["component_id"] == r["doc_id"])
        assert {r["doc_id"]: r["n_shingles"] for r in got if r["doc_id"]} == {i: len(shingles(t)) for i, t in rows if i}
    assert near_dedup.near_duplicates(odd_rows(spark, [])).count() == 0


def test_components_of_a_chain_and_a_hot_star(spark):
    chain = [(k, k + 1) for k in range(40)]
    star = [(1000, 1001 + k) for k in range(50)]
    edges = spark.createDataFrame([*chain, *star, (None, 3), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 1000 for k in range(1000, 1051)}
    assert components(edges.limit(0)).count() == 0


# Secrets


ASSIGN = re.compile(r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def brute_spans(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


def brute_model(samples):
    """Ratios by pair and the threshold, from (value, label, held_out)."""
    alphabet = secret_scan.ALPHABET
    seen = {0: Counter(), 1: Counter()}
    for value, label, held in samples:
        if not held:
            seen[label].update(value[k : k + 2] for k in range(len(value) - 1))
    after = {k: Counter() for k in seen}
    for k, c in seen.items():
        for pair, n in c.items():
            if set(pair) <= set(alphabet):
                after[k][pair[0]] += n
    p = lambda k, pair: (seen[k][pair] + 0.5) / (after[k][pair[0]] + 0.5 * len(alphabet))
    ratio = lambda v: sum(math.log(p(1, v[k : k + 2]) / p(0, v[k : k + 2])) for k in range(len(v) - 1))
    plain = sorted(ratio(v) for v, label, held in samples if held and label == 0 and len(v) >= secret_scan.LEAST and set(v) <= set(alphabet))
    at = (1 - secret_scan.WRONG) * (len(plain) - 1)
    low = plain[int(at)]
    return ratio, max(0.0, low + (plain[min(int(at) + 1, len(plain) - 1)] - low) * (at - int(at)))


def brute_secrets(text, ratio, least):
    base = brute_spans(text)
    tokens = [(m.start(), 3, m.end()) for m in re.finditer(secret_scan.TOKEN, text or "") if ratio(m[0]) > least]
    return sorted(base + [t for t in tokens if not any(a < t[2] and t[0] < b for a, _, b in base)])


def test_secret_query_matches_a_transcription(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    samples = [tuple(r) for r in secret_scan.labelled_samples(docs).collect()]
    ratio, least = brute_model(samples)
    model, found = secret_scan.fitted(docs)
    assert found == pytest.approx(least, rel=1e-9)
    held = [(ratio(v) > least, label) for v, label, h in samples if h and len(v) >= 12]
    right = [x for x, label in held if label]
    assert sum(right) / len(right) > 0.95 and sum(x for x, label in held if not label) / sum(not label for _, label in held) < 0.005
    strings = [r["value"] for r in secret_scan.random_strings(spark, 12).collect()]
    planted = [(10**6 + k, f"we wrote {s[: 12 + 2 * k // 2]} down, and {s.lower()}") for k, s in enumerate(strings)]
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()] + planted
    got = {r["doc_id"]: r["spans"] for r in secret_scan.digest(secret_scan.secrets(spark.createDataFrame(rows, "doc_id long, text string"), (model, found))).collect()}
    for i, t in rows:
        assert got[i] == ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in brute_secrets(t, ratio, least))
    assert sum("random" in got[i] for i, _ in planted) >= 11
    assert {r["doc_id"]: r["spans"] for r in queries.op6_secret_scan(spark, DATA).collect()} == {i: got[i] for i, _ in rows if i < 10**6}


def test_secrets(spark):
    random_token = "Zx9QpL2mKv8RtYw3BnHs7Jd0"
    rows = [*CASES, (20, "🙂 PassWord = 'abcdefgh' token:short password: token =\"abcdefgh1\""), (21, "AKIA" + "B2" * 8 + " AKIAshort " + "ab" * 20 + " secret=" + "0f" * 16), (22, "see the_ordinary_identifier_name and " + random_token + " ok"), (23, "api_key==12345678")]
    model = secret_scan.fitted(spark.read.parquet(f"{DATA}/documents.parquet"))
    got = secret_scan.digest(secret_scan.secrets(odd_rows(spark, rows), model)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    for i, t in rows:
        if i is None:
            continue
        want = brute_spans(t)
        text = ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert by[i]["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert [by[i][f"n_{k}"] for k in secret_scan.KINDS[:3]] == [sum(s[1] == n for s in want) for n in range(3)]
    start = rows[-2][1].index(random_token)
    assert by[22]["spans"] == f"random:{start}:{start + len(random_token)}"
    assert secret_scan.secrets(odd_rows(spark, []), model).count() == 0
    assert secret_scan.secrets(odd_rows(spark, [])).count() == 0
    tried = secret_scan.random_strings(spark, 300).select(secret_scan.ratio(F.col("value"), model[0]).alias("r"))
    assert tried.filter(F.col("r") > model[1]).count() >= 297


# Quality, language


def test_quality(spark):
    got = queries.op7_quality(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", F.col("quality").alias("q"))
    rows = got.join(labels, "doc_id").filter("held_out").collect()
    good = [r["predicted"] for r in rows if r["q"] == 1]
    assert sum(good) / len(good) > 0.97
    assert sum(r["predicted"] == r["q"] for r in rows) / len(rows) > 0.88
    docs = odd_rows(spark, CASES)
    for labelled in (docs.select("doc_id", "label"), docs.select("doc_id", "label").limit(0)):
        scores = quality.judged(docs, quality.train(docs, labelled), "doc_id", "label").collect()
        assert len(scores) == len(CASES) and all(0 <= r["score"] <= 1 for r in scores)
    assert quality.judged(docs.limit(0), quality.Model([b"", b""]), "doc_id").count() == 0


def test_quality_matches_brute_force(spark):
    import zstandard

    texts = ["plain words that say something " * 300, "aaa aaa aaa zzz", "", "x"]
    model = quality.Model([b"aaa zzz " * 40, b"plain words that say something " * 20], [0.3, 5.0, -2.0, 0.5, 0.1, 4.0])
    want = []
    for t in texts:
        data, sizes = t.encode(), []
        for d in model.dictionaries:
            c = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes.append(sum(len(c.compress(data[k : k + 2048])) for k in range(0, len(data), 2048)))
        n, (bad, good) = len(data), sizes
        x = [1, (bad - good) / n, (bad - good) / (bad + good), good / n, 1 / (1 + n / 100), (bad - good) / n / (1 + n / 100)] if n else [1, 0, 0, 0, 0, 0]
        want.append(1 / (1 + math.exp(-sum(a * b for a, b in zip(x, model.weights)))))
    got = {r["doc_id"]: r["score"] for r in quality.judged(odd_rows(spark, list(enumerate(texts))), model, "doc_id").collect()}
    assert [got[k] for k in range(4)] == pytest.approx(want, rel=1e-12)


def test_quality_reads_the_whole_of_a_labelled_text(spark):
    """What tells good from bad stands once, in the middle of long texts, between the blocks that were once drawn."""
    draw = random.Random(8)
    rows = [(k, " ".join(f"n{draw.randrange(10**6)}" for _ in range(4000)) + f" {'fine prose indeed ' * 60 if k % 2 else 'spam spam buy now ' * 60} " + " ".join(f"n{draw.randrange(10**6)}" for _ in range(3000))) for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = quality.train(docs, docs.select("doc_id", (F.col("doc_id") % 2).alias("label")))
    assert b"spam spam buy" in found.dictionaries[0] and b"fine prose" in found.dictionaries[1]


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", F.col("lang").alias("true"))
    rows = queries.op9_language_id(spark, "/root/testdata/sf0.01").join(docs, "doc_id").filter("held_out").collect()
    assert sum(r["lang_pred"] == r["true"] for r in rows) / len(rows) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_edges(spark):
    train = spark.createDataFrame([("der die das und nicht", "de"), ("the and of that with", "en"), (None, "xx"), ("none", None)] * 5, "text string, lang string")
    model = language_id.train(train)
    got = language_id.identified(odd_rows(spark, [*CASES, (50, "12 !!"), (51, "und nicht die")]), model, "doc_id", "score" if False else "lang").collect()
    by = {r["doc_id"]: r["lang_pred"] for r in got}
    assert len(got) == len(CASES) + 2 and by[1] == by[2] == by[50] == "und" and by[51] == "de" and by[6] in ("de", "en", "xx")
    assert {r["lang_pred"] for r in language_id.identified(odd_rows(spark, CASES), language_id.train(train.filter("lang is null"))).collect()} == {"und"}
    assert all(r["lang_pred"] == "und" for r in language_id.identified(odd_rows(spark, CASES), model, reject=1.1).collect())


def brute_kneser_ney(texts, size, order=language_id.ORDER):
    """A function of (context, symbol) to its probability under interpolated Kneser-Ney learnt from texts of letters and spaces."""
    counts = [Counter() for _ in range(order + 1)]
    for t in texts:
        row = (" " + t).replace("  ", " ")
        for i in range(len(row)):
            counts[order][tuple((" " * order + row)[i + 1 : i + 1 + order])] += 1
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])

    def p(context, symbol):
        k = len(context) + 1
        c = counts[k]
        inside = {g[-1]: n for g, n in c.items() if g[:-1] == tuple(context)}
        shorter = p(context[1:], symbol) if k > 1 else 1 / size
        if not inside:
            return shorter
        ones, twos = sum(n == 1 for n in c.values()), sum(n == 2 for n in c.values())
        d = ones / (ones + 2 * twos) if ones and twos else 0.75
        return (max(inside.get(symbol, 0) - d, 0) + d * len(inside) * shorter) / sum(inside.values())

    return p


def test_kneser_ney_matches_brute_force_and_sums_to_one():
    import numpy as np
    import pyarrow as pa

    texts, tried = ["abcabcaabbc cab", "bca", "aab ccb"], "abca bxb caab "
    grams = language_id.Grams(*language_id.decoded(pa.array(texts)))
    model = language_id.Model({"x": grams.distinct()})
    p = brute_kneser_ney(texts, 5)  # a, b, c, the border, and all others
    want = sum(-math.log10(p(tuple((" " * 5 + " " + tried)[i + 1 : i + 5]), c)) for i, c in enumerate(" " + tried)) / (len(tried) + 1)
    assert model.entropies(pa.array([tried]))[0][0, 0] == pytest.approx(want, rel=1e-12)
    for context in (" abc", "bcab", "zzzz"):
        assert sum(p(tuple(context), c) for c in "abc x") == pytest.approx(1)
    assert [float(x) for x in model.values[0]] == pytest.approx([float(x) for x in model._all(*np.split(grams.distinct()[0].T, 2))[0]])


def test_letters_beyond_any_table_and_languages_of_one_row(spark):
    """Eleven thousand kinds of letters in one language, and a language with one row alone."""
    syllables = "".join(chr(0xAC00 + k) for k in range(11_000))
    rows = [(f"und {k} ist nicht das", "de") for k in range(30)] + [("unus solus textus", "la"), (syllables, "ko")]
    model = language_id.train(spark.createDataFrame(rows, "text string, lang string"))
    assert model.languages == ["de", "ko", "la"]
    asked = odd_rows(spark, [(1, "".join(reversed(syllables[-40:]))), (2, "solus textus"), (3, "das ist")])
    assert {r["doc_id"]: r["lang_pred"] for r in language_id.identified(asked, model, "doc_id").collect()} == {1: "ko", 2: "la", 3: "de"}
    assert language_id.identified(odd_rows(spark, []), model, "doc_id").count() == 0
    twins = language_id.train(spark.createDataFrame([("same words", "b"), ("same words", "a")], "text string, lang string"))
    assert language_id.identified(odd_rows(spark, [(1, "same")]), twins).first()["lang_pred"] == "a"


# Mixing


def test_mix_keeps_columns_of_any_name(spark):
    names = ["key", "_key", "_of", "_parts", "_steps", "_copies", "_name", "of", "name", "document", "rated", "rate", "copies", "a.b"]
    docs = odd_rows(spark, CASES).select("doc_id", "text", "source", *(F.lit(n).alias(n) for n in names))
    got = mixing.mixed(docs, mean_rate=3.0)
    rows = got.collect()
    assert got.columns == [*docs.columns, "copy", "place"] and len(rows) > 10 and all(r[n] == n for r in rows for n in names)


def test_mix(spark):
    docs = odd_rows(spark, CASES)
    weights = spark.createDataFrame([(None, 1.0), ("x", 5.0)], "source string, weight double")
    got = mixing.mixed(docs, weights, mean_rate=200.0).collect()
    per = Counter((r["doc_id"], r["text"]) for r in got)
    assert abs(len(got) - 200 * len(CASES)) < 6 * math.sqrt(200 * len(CASES)) + 400
    assert all(130 < n < 280 for k, n in per.items() if k[0] != 8) and [r["place"] for r in got] == sorted(r["place"] for r in got)
    again = mixing.mixed(docs.repartition(3), weights, mean_rate=200.0)
    assert Counter((r["doc_id"], r["copy"]) for r in again.collect()) == Counter((r["doc_id"], r["copy"]) for r in got)
    assert mixing.mixed(docs, weights.filter("source = 'x'")).count() == 0 and mixing.mixed(docs.limit(0)).count() == 0


# Exact duplicates


def test_exact_duplicates_with_colliding_hashes(spark):
    draw = random.Random(4)
    base = ["".join(draw.choice("abcdef \n") for _ in range(draw.choice([0, 10, 5000, 40_000]))) for _ in range(15)]
    rows = [*CASES, *((100 + k, draw.choice(base)) for k in range(60)), (300, base[2] + "x" * 3000), (301, base[2] + "y" * 3000)]
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    for bits in (64, 3):
        got = exact_dedup.exact_duplicates(odd_rows(spark, rows), bits).collect()
        assert len(got) == len(rows)
        digests = {hashlib.sha256(t.encode()).hexdigest(): t for t in groups}
        for r in got:
            ids = groups[digests[r["text_sha256"]]]
            keep = max((i for i in ids if i is not None), default=None)
            assert (r["keep_id"], r["group_size"], r["kept"]) == (keep, len(ids), r["doc_id"] == keep)
    assert exact_dedup.exact_duplicates(odd_rows(spark, [])).count() == 0


def test_two_drivers_with_one_batch_count_it_once(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/totals"
    one, other = TokenRollup(spark, folder), TokenRollup(spark, folder)
    rows = signed(inserts=spark.createDataFrame([("a", "en", "hello")], "source string, lang string, text string"))
    monkeypatch.setattr(other, "committed", lambda batch: False)  # it looked before the first had committed
    assert one.apply("1", rows) and not other.apply("1", rows)
    assert one.totals().first()["n_docs"] == 1 and len(one.deltas()) == 1
