"""Secrets in texts, with DataFrame functions alone: patterns, and character Markov models for strings without one.

Two first-order Markov models over characters, one of random strings and one of ordinary identifiers, are trained from
labelled samples. A token is reported where the log-likelihood ratio of its transitions adds up to more than a
threshold, which is set on labelled samples that trained neither model, so that a share WRONG of ordinary ones passes.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .spread import written

ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run below the least length fails, and so does all that is left of it, so the length can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: What the models judge: tokens of the characters of encoded keys. With fewer characters two models of transitions can't
#: part a random string from a rare word: at 8, words of four or five rare transitions passed in 37 of 10,000 documents.
LEAST = 12
TOKEN = rf"[A-Za-z0-9+/_-]{{{LEAST},}}={{0,2}}"
KINDS = ("assign", "access", "hex", "random")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
#: Documents whose findings and words serve as labelled samples, about; and random strings made for each alphabet.
SAMPLE_DOCUMENTS, MADE_STRINGS = 2_000, 4_000
#: Share of ordinary samples that the threshold lets pass.
WRONG = 0.0005


def found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def placed(text: Column, matches: Column, pattern: str, kind: int, wanted: Callable[[Column], Column] = lambda match: F.lit(True)) -> Column:
    """Structs (start, kind, end, match) of those leftmost non-overlapping matches that are wanted, in code points.

    The pieces between the matches give the starts: a match begins where the pieces and matches before it end.
    """
    pieces = F.split(text, pattern, -1)

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + F.length(x["piece"])
        end = start + F.length(x["match"])
        more = F.array_append(s["all"], F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["match"].alias("match")))
        return F.struct(end.alias("at"), F.when(wanted(x["match"]), more).otherwise(s["all"]).alias("all"))

    none = F.array().cast("array<struct<start:int,kind:int,end:int,match:string>>")
    zipped = F.arrays_zip(F.slice(pieces, F.lit(1), F.size(matches)).alias("piece"), matches.alias("match"))
    all_ = F.aggregate(zipped, F.struct(F.lit(0).alias("at"), none.alias("all")), step, lambda s: s["all"])
    return F.when(~F.exists(matches, wanted), none).otherwise(all_)


def base_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text, assign, access, hex): the spans of each pattern; null texts are empty."""
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    lists = texts.select("doc_id", "text", *(found(F.col("text"), p).alias(f"m_{k}") for k, p in zip(KINDS, (ASSIGN, ACCESS, HEX))))
    spans = lists.select("doc_id", "text", *(placed(F.col("text"), F.col(f"m_{k}"), p, n).alias(k) for n, (k, p) in enumerate(zip(KINDS, (ASSIGN, ACCESS, HEX)))))
    long_enough = lambda s: F.length(F.regexp_extract(s["match"], ASSIGN, 2)) >= 8
    return spans.withColumn("assign", F.filter("assign", long_enough))


def labelled_samples(docs: DataFrame, documents: int = SAMPLE_DOCUMENTS, made: int = MADE_STRINGS) -> DataFrame:
    """(value, label, held_out) from about `documents` documents, chosen by hash, and `made` strings for each of five alphabets.

    Label 1: values that the patterns found, and digests as encoded in hexadecimal, base 64, letters of both cases and
    digits, lower-case ones and digits, and capitals and digits, 8 to 43 characters of each. Label 0: words of
    letters, alone, joined and numbered as identifiers are, and dates and numbers with parts. held_out marks a quarter.
    """
    spark = docs.sparkSession
    rest = max(1, docs.count() // max(documents, 1))
    some = base_spans(docs.filter(F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("secrets")), F.lit(rest)) == 0))
    values = some.select(F.explode(F.concat(F.transform("assign", lambda s: F.regexp_extract(s["match"], ASSIGN, 2)), F.transform("access", lambda s: s["match"]), F.transform("hex", lambda s: s["match"]))).alias("value"))
    keys = spark.range(made).select("id", F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    coded = F.regexp_replace(F.base64(F.unhex("digest")), "=+$", "")
    plain = F.regexp_replace(coded, "[+/]", "")
    length = (F.col("id") % 36 + 8).cast("int")
    strings = keys.select(F.explode(F.array(F.col("digest"), coded, plain, F.lower(plain), F.upper(plain))).alias("value"), length.alias("n")).select(F.substring("value", F.lit(1), F.col("n")).alias("value"))
    words = some.select(F.regexp_extract_all("text", F.lit(r"\b[A-Za-z]{4,}\b"), F.lit(0)).alias("w")).filter("size(w) > 1")
    pairs = F.zip_with(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    number = F.pmod(F.xxhash64("p.b", "p.a"), F.lit(10_000)).cast("string")
    day = F.date_format(F.date_add(F.lit("1990-01-01").cast("date"), F.pmod(F.xxhash64("p.a"), F.lit(16_000)).cast("int")), "yyyy-MM-dd")
    shapes = F.array(
        *("p.a", F.concat_ws("_", "p.a", "p.b"), F.concat_ws("-", "p.a", "p.b"), F.concat_ws("/", "p.a", "p.b"), F.concat(F.col("p.a"), F.initcap("p.b"))),
        *(F.concat(F.upper("p.a"), F.lit("_"), F.upper("p.b")), F.concat(F.col("p.a"), number), F.concat_ws("_", "p.a", number), day, F.translate(day, "-", "/"), F.concat_ws("-", number, number)),
    )
    names = words.select(F.explode(pairs).alias("p")).select(F.element_at(shapes, (F.pmod(F.xxhash64("p.a", "p.b"), F.lit(11)) + 1).cast("int")).alias("value"))
    every = values.select("value", F.lit(1).alias("label")).unionByName(strings.select("value", F.lit(1).alias("label"))).unionByName(names.select("value", F.lit(0).alias("label")))
    return every.select("value", "label", (F.pmod(F.xxhash64("value", F.lit("held out")), F.lit(4)) == 0).alias("held_out"))


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios (random over ordinary) of each transition between two characters of ALPHABET, row by row.

    samples has value and label (1: random). Values shorter than two characters and null ones teach nothing; characters
    outside ALPHABET are passed over. At most len(ALPHABET) ** 2 counts a label reach the driver.
    """
    steps = F.transform(F.sequence(F.lit(1), F.length("value") - 1), lambda i: F.substring("value", i, F.lit(2)))
    counts = samples.filter("length(value) > 1").select("label", F.explode(steps).alias("pair")).groupBy("label", "pair").count()
    counts = counts.filter(F.col("pair").rlike(f"^[{ALPHABET[:-4]}/_=+-]{{2}}$")).collect()
    table: dict[int, dict[str, int]] = {0: {}, 1: {}}
    for row in counts:
        if row["label"] in table:
            table[row["label"]][row["pair"]] = row["count"]
    out = []
    size = len(ALPHABET)
    totals = {k: {a: sum(t.get(a + b, 0) for b in ALPHABET) for a in ALPHABET} for k, t in table.items()}
    for a in ALPHABET:
        for b in ALPHABET:
            p, q = ((table[k].get(a + b, 0) + 0.5) / (totals[k][a] + 0.5 * size) for k in (1, 0))
            out.append(math.log(p / q))
    return out


def ratio(value: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of the transitions of a token of ALPHABET, added up."""
    size = len(ALPHABET)
    table = F.array(*(F.lit(x) for x in model))
    codes = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    pairs = F.zip_with(F.slice(codes, F.lit(1), F.size(codes) - 1), F.slice(codes, F.lit(2), F.size(codes) - 1), lambda a, b: F.get(table, (a - 1) * size + b - 1))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def threshold(samples: DataFrame, model: list[float], wrong: float = WRONG) -> float:
    """The ratio, 0 at least, that a share `wrong` of the ordinary samples (value, label) exceeds."""
    found_ = samples.filter(f"label = 0 and length(value) >= {LEAST}").agg(F.percentile(ratio(F.col("value"), model), F.lit(1 - wrong)).alias("t")).first()["t"]
    return max(found_ or 0.0, 0.0)


def fitted(docs: DataFrame) -> tuple[list[float], float]:
    """A model trained on labelled samples of docs, and the threshold set on those held out."""
    samples = written(labelled_samples(docs), "samples")
    model = train(samples.filter("not held_out"))
    return model, threshold(samples.filter("held_out"), model)


def secrets(docs: DataFrame, model: tuple[list[float], float] | None = None) -> DataFrame:
    """(doc_id, base, added) for each row of docs (doc_id, text; others ignored): arrays of spans (start, kind, end, match).

    base: the spans of the three patterns by start, then kind; kinds count as in KINDS. added: tokens that overlap none
    of those and whose log-likelihood ratio exceeds the threshold. model: as `fitted` gives it, by default on docs. Positions are code points, ends exclusive. A
    null text counts as empty; null ids and repeated rows are carried along, each row judged by itself. Whole texts are
    read. An empty table gives an empty result.
    """
    ratios, least = fitted(docs) if model is None else model
    spans = base_spans(docs)
    base = F.array_sort(F.concat("assign", "access", "hex"))
    spans = spans.select("doc_id", "text", base.alias("base"), found(F.col("text"), TOKEN).alias("m"))
    random = lambda match: ratio(match, ratios) > least
    spans = spans.select("doc_id", "base", placed(F.col("text"), F.col("m"), TOKEN, 3, random).alias("tokens"))
    apart = lambda t: ~F.exists("base", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"]))
    return spans.select("doc_id", "base", F.filter("tokens", apart).alias("added"))


def digest(found_: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of a result of `secrets`."""
    name = lambda s: F.concat_ws(":", F.element_at(F.array(*(F.lit(k) for k in KINDS)), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found_.select(
        "doc_id",
        *(count(k).alias(f"n_{KINDS[k]}") for k in range(3)),
        F.sha2(F.concat_ws(",", F.transform("base", name)), 256).alias("base_sha256"),
        F.concat_ws(",", F.transform(F.array_sort(F.concat("base", "added")), name)).alias("spans"),
    )


def random_strings(spark: SparkSession, n: int) -> DataFrame:
    """n random-looking strings, for trying a model."""
    return spark.range(n).select(F.substring(F.base64(F.unhex(F.sha2(F.concat(F.lit("try"), F.col("id").cast("string")), 256))), 1, 32).alias("value"))
