import pytest
from pyspark.sql import functions as F

from quillstone.functions import codec, packed
from quillstone.sources.store import Store
from quillstone.tables import FILE, TREE

PERSON = ("Test Name", "test@example.com", 2272247100, 180)
EMPTY = "4b825dc642cb6eb9a060e54bf8d69288fbee4904"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def files(spark, rows):
    return spark.createDataFrame([(p, m, None if b is None else bytearray(b), h) for p, m, b, h in rows], "path string, mode int, body binary, hash string")


def test_golden_hashes(spark):
    store = Store(spark)
    empty = store.save_tree(files(spark, []))
    assert empty == EMPTY
    first = store.create_commit(empty, [], PERSON, "Initial commit")
    assert first == "eaef5b6f452335fad4dd280a113d81e82a3acaca"
    tree = store.save_tree(files(spark, [("a.txt", FILE, b"a", None)]))
    assert tree == "1a602d9bd07ce5272ddaa64e21da12dbca2b8c9f"
    assert store.has("2e65efe2a145dda7ee51d1741299f848e5bf752e")
    assert store.create_commit(tree, [first], PERSON, "Added a.txt") == "9254379c365d23429f0fff266834bdc853c35fe1"
    root = store.save_tree(files(spark, [("a.txt", FILE, b"aa", None), ("b/c.txt", FILE, b"cc", None)]))
    assert {"7ec9a4b774e2472d8e38bc18a3aa1912bacf483e", "2652f5f42c003f125212dd61f95a3a8a37cb45d5", "bc3aa3eb92286b2ddaab0bef7564f25098f8fbdc"} <= {r["hash"] for r in store.objects.collect()}
    assert store.save_tree(files(spark, [("a", TREE, None, EMPTY)])) == "0a8a87dd80eda4132d290a67b0676cde6ec1cb29"
    entries = {(r["tree_hash"], r["name"], r["mode"]) for r in store.entries().collect()}
    assert {(root, "a.txt", FILE), (root, "b", TREE)} <= entries


def test_directories_sort_as_if_they_ended_in_a_slash(spark):
    entries = spark.createDataFrame([([("a", TREE, EMPTY), ("a.txt", FILE, EMPTY), ("a0", FILE, EMPTY)],)], "e array<struct<name:string,mode:int,child_hash:string>>")
    body = bytes(entries.select(codec.tree_body(F.col("e")).alias("b")).first()["b"])
    assert [e[1] for e in packed.cut_tree(body)] == ["a.txt", "a", "a0"]


@pytest.mark.parametrize("offset, zone", [(180, "-0300"), (0, "+0000"), (-330, "+0530"), (-60, "+0100")])
def test_person_round_trip(spark, offset, zone):
    person = F.struct(F.lit("N").alias("name"), F.lit("n@x.org").alias("email"), F.lit(2272247100).alias("seconds"), F.lit(offset).alias("offset"))
    line = one(spark, codec.person_line(person))
    assert line == f"N <n@x.org> 2272247100 {zone}"
    assert tuple(one(spark, codec.parsed_person(F.lit(line)))) == ("N", "n@x.org", 2272247100, offset)


def test_malformed_person(spark):
    assert one(spark, codec.parsed_person(F.lit("nobody"), strict=False)) is None
    with pytest.raises(Exception, match="not a person"):
        one(spark, codec.parsed_person(F.lit("nobody")))


@pytest.mark.parametrize("hash_, fine", [("a" * 40, True), ("0123456789" * 4, True), ("A" * 40, False), ("a" * 39, False), ("a" * 41, False), ("g" * 40, False), ("", False), (None, False), ("a" * 40 + "\n", False)])
def test_hashes(spark, hash_, fine):
    assert one(spark, codec.valid_hash(F.lit(hash_).cast("string"))) is fine


@pytest.mark.parametrize("ref, found", [("refs/remotes/c/main", ("c", "main")), ("refs/remotes/c", None), ("refs/heads/main", None), ("Refs/remotes/c/main", None), ("refs/remotes/c/a/b", None), ("", None), ("refs/remotes//main", None)])
def test_branch_refs(spark, ref, found):
    got = one(spark, codec.parsed_branch(F.lit(ref)))
    assert (tuple(got) if got else None) == found


def test_journal_round_trip(spark):
    rows = [(0, None, "a" * 40, PERSON, "first\nmore"), (1, "a" * 40, "b" * 40, PERSON, "second")]
    df = spark.createDataFrame(rows, "seq long, previous string, new string, person struct<name:string,email:string,seconds:bigint,offset:int>, description string")
    text = "".join(r["x"] for r in df.orderBy("seq").select(codec.journal_line(*(F.col(c) for c in ("previous", "new", "person", "description"))).alias("x")).collect())
    got = one(spark, codec.parsed_journal(F.lit(text)))
    assert [(e["seq"], e["previous"], e["new"], tuple(e["person"]), e["description"]) for e in got] == [(0, None, "a" * 40, PERSON, "first"), rows[1]]
    assert one(spark, codec.parsed_journal(F.lit(""))) == []


def test_paths(spark):
    assert one(spark, codec.parsed_path(F.lit("/a/b/"))) == "a/b"
    for bad in ("a//b", "a/./b", "..", "a/\n"):
        assert one(spark, codec.parsed_path(F.lit(bad))) is None
    assert one(spark, codec.parent(F.lit("a"))) == "" and one(spark, codec.parent(F.lit(""))) is None
    assert one(spark, codec.leaf(F.lit("a/b"))) == "b" and one(spark, codec.num_segments(F.lit(""))) == 0
    assert one(spark, codec.is_parent_of(F.lit("a"), F.lit("a/b"))) and not one(spark, codec.is_parent_of(F.lit("a"), F.lit("ab")))
    assert one(spark, codec.is_immediate_parent_of(F.lit(""), F.lit("a"))) and not one(spark, codec.is_immediate_parent_of(F.lit(""), F.lit("a/b")))


def test_config():
    text = '# c\n[core]\n\tbare\n\tname = "a ; b" # note\n[remote "x \\"y"] url = one\nurl = two\n'
    assert packed.parse_config(text) == {"core.bare": ["true"], "core.name": ["a ; b"], 'remote.x "y.url': ["one", "two"]}
    for bad in ("a = 1", "[a]\nb = \"x", "[a]\nb = x\\\ny", "[include]\npath = x", "[a]\n1b = 2"):
        with pytest.raises(ValueError):
            packed.parse_config(bad)


def test_config_values(spark):
    df = spark.createDataFrame([({"a.n": ["1", "2"]},)], "c map<string,array<string>>")
    assert df.select(packed.config_string(F.col("c"), "a.n")).first()[0] == "2"
    assert df.select(packed.config_string(F.col("c"), "a.m")).first()[0] is None
    assert df.select(packed.config_number(F.col("c"), "a.n")).first()[0] == 2
    with pytest.raises(Exception, match="not a number"):
        df.select(packed.config_number(F.col("c"), "a.m")).collect()


def test_container_settings(spark):
    bodies = [b'{"type":"t","typeVersion":"1"}', b"{}", b"nonsense", b'{"type":"t"}', None]
    df = spark.createDataFrame([(None if b is None else bytearray(b),) for b in bodies], "b binary")
    assert [r["c"]["error"] for r in df.select(codec.container_config(F.col("b")).alias("c")).collect()] == [None, "no type", "not json", "no version", "missing"]


COMMIT = f"tree {'a' * 40}\nparent {'b' * 40}\nparent {'c' * 40}\nauthor Ä <a@x.org> 5 -0300\ncommitter N <n@x.org> 7 +0530\nencoding UTF-8"
AUTHOR, COMMITTER = ("Ä", "a@x.org", 5, 180), ("N", "n@x.org", 7, -330)


@pytest.mark.parametrize("rest, message", [("", ""), ("\n\n", ""), ("\n\nä\n\nparent x\n", "ä\n\nparent x\n"), ("\n\n\nm", "\nm")])
def test_commit_bodies(spark, rest, message):
    got = one(spark, codec.parsed_commit(F.lit(bytearray((COMMIT + rest).encode()))))
    assert (got["tree"], got["parents"], tuple(got["author"]), tuple(got["committer"]), got["message"]) == ("a" * 40, ["b" * 40, "c" * 40], AUTHOR, COMMITTER, message)


def test_commit_bodies_that_are_null_or_malformed(spark):
    assert one(spark, codec.parsed_commit(F.lit(None).cast("binary"))) is None
    body = F.lit(bytearray(COMMIT.replace("author", "writer").encode()))
    with pytest.raises(Exception, match="not a person: null"):
        one(spark, codec.parsed_commit(body)["tree"])


@pytest.mark.parametrize("parse", [codec.parsed_commit, codec.parsed_tag])
def test_bodies_are_decoded_once(spark, parse):
    rows = spark.range(1).select(F.encode(F.col("id").cast("string"), "utf-8").alias("b"))
    plan = rows.select(parse(F.col("b")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("StringDecode.decode(") == 1
