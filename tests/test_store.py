import pytest
from pyspark.sql import functions as F

from quillstone.operators import diff, log, reconcile, sync, trees
from quillstone.operators.tree_files import TreeFiles
from quillstone.sources.files import FileError, FileTable, copied
from quillstone.sources.store import Store, StoreError
from quillstone.tables import FILE

PERSON = ("Test Name", "test@example.com", 2272247100, 180)


def files(spark, rows):
    return spark.createDataFrame([(p, FILE, bytearray(b), None) for p, b in rows], "path string, mode int, body binary, hash string")


def history(spark, store, shape, ref=None):
    ids = {}
    for k, (name, parents) in enumerate(shape.items()):
        tree = store.save_tree(files(spark, [("someFile.txt", name.encode())]))
        ids[name] = store.create_commit(tree, [ids[p] for p in parents], (PERSON[0], PERSON[1], PERSON[2] + k, 180), name)
        if ref:
            store.update_ref(ref, ids[name], PERSON, name)
    return ids


REF = "refs/remotes/client1/main"
FIVE = {"A": "", "B": "A", "C": "A", "D": "C", "E": "C"}


@pytest.fixture(scope="module")
def remote(spark):
    store = Store(spark)
    return store, history(spark, store, FIVE, REF)


def clone(store):
    return Store(store.spark, store.objects, store.refs, store.journal)


def blob(store, commit):
    tree = store.commits().filter(F.col("hash") == commit).first()["tree"]
    return store.entries().filter(F.col("tree_hash") == tree).first()["child_hash"]


def there(store, ids):
    hashes = {r["hash"] for r in store.objects.select("hash").collect()}
    return "".join(n for n, h in ids.items() if h in hashes)


def test_sync_copies_what_a_commit_reaches(spark, remote):
    store, ids = remote
    local = Store(spark)
    sync.sync_commits(store, local, ids["E"], 1, 1)
    assert there(local, ids) == "ACE"


def test_levels_decide_whether_a_gap_is_filled(spark, remote):
    store, ids = remote
    local = Store(spark)
    sync.sync_commits(store, local, ids["E"], 1, 1)
    local.delete(ids["A"])
    sync.sync_commits(store, local, ids["E"], 1, 1)
    assert there(local, ids) == "CE"
    sync.sync_commits(store, local, ids["E"], 3, 3)
    assert there(local, ids) == "ACE"


def test_shallow(spark, remote):
    store, ids = remote
    broken, local = clone(store), Store(spark)
    broken.delete(ids["A"])
    assert sync.sync_commits(broken, local, ids["E"], 1, 1).cut == [ids["A"]]
    assert there(local, ids) == "CE"
    broken, local = clone(store), Store(spark)
    broken.delete(blob(store, ids["C"]))
    sync.sync_commits(broken, local, ids["E"], 2, 2)
    assert there(local, ids) == "E"
    sync.sync_commits(store, local, ids["E"], 2, 2)
    assert there(local, ids) == "ACE"
    with pytest.raises(sync.MissingObject):
        sync.sync_commits(broken, Store(spark), ids["E"], 1, 1, allow_shallow=False)
    with pytest.raises(ValueError):
        sync.sync_commits(store, local, ids["E"], 1, 3)


def test_fetch(spark, remote):
    store, ids = remote
    local = Store(spark)
    assert sync.fetch_refs(local, store, "client1") == []
    assert sync.fetch_refs(local, store, "client2", "main") == [REF]
    assert sync.fetch_refs(local, store, "client2") == [REF]
    assert local.get_ref(REF) == ids["E"] and local.get_journal(REF).count() == 1
    broken, local = clone(store), Store(spark)
    broken.delete(ids["E"])
    sync.fetch_refs(local, broken, "client2")
    assert local.get_ref(REF) == ids["D"]
    with pytest.raises(sync.SyncError, match="RefNotFound"):
        sync.push_ref(Store(spark), local, REF)


def test_layout_round_trip(spark, remote, tmp_path):
    store, ids = remote
    store = clone(store)
    assert (store.init(), store.init()) == ("init", "reInit")
    store.write_layout(str(tmp_path / "repo"))
    back = Store.read_layout(spark, str(tmp_path / "repo"))
    assert there(back, ids) == "ABCDE" and back.get_ref(REF) == ids["E"] and back.journal.count() == 5
    assert back.init() == "reInit" and [r["message"] for r in back.log(REF).collect()] == ["E", "C", "A"]
    assert [(r["path"], bytes(r["body"])) for r in back.checkout(REF).collect()] == [("someFile.txt", b"E")]
    assert [r["found"] for r in back.show_refs().collect()] == [True]
    del back.files["HEAD"]
    with pytest.raises(StoreError, match="BadRepo"):
        back.init()


ALL = {"A": "", "B": "A", "C": "B", "D": "A", "E": "D", "F": "E", "G": "CF", "H": "F", "I": "D", "J": "FI", "K": "J"}


@pytest.mark.parametrize("heads, merges", [("ABC", []), ("BDE", [("B", "E")]), ("BEI", [("B", "E"), ("*", "I")])])
def test_reconcile(spark, heads, merges):
    store = Store(spark)
    ids = history(spark, store, ALL)
    names = {v: k for k, v in ids.items()}
    for k, head in enumerate(heads):
        store.set_ref(f"refs/remotes/c{k}/main", ids[head])
    done = []

    def merge(base, a, b, message):
        done.append((names.get(a, "*"), names[b]))
        return store.create_commit(store.commits().filter(F.col("hash") == a).first()["tree"], [a, b], PERSON, message)

    got = reconcile.reconcile(store, "c1", "main", PERSON, merge=merge)
    assert done == merges and store.get_ref("refs/remotes/c1/main") == got
    if not merges:
        assert got == ids["C"]


def test_reconcile_containers(spark):
    store = Store(spark)
    at = lambda rows: store.save_tree(files(spark, rows))
    config = b'{"type":"filesystem","typeVersion":"1"}'
    common = [("containers/x/config.json", config), ("containers/x/f", b"0"), ("containers/gone/config.json", config)]
    base = store.create_commit(at(common), [], PERSON, "base")
    a = store.create_commit(at([common[0], ("containers/x/f", b"1"), common[2]]), [base], PERSON, "a")
    b = store.create_commit(at([common[0], ("containers/x/f", b"2"), ("containers/new/config.json", config)]), [base], PERSON, "b")
    made = reconcile.merge_commits(store, base, a, b, reconcile.default_mergers(), PERSON, "m")
    kept = {r["container"]: r["hash"] for r in reconcile.snapshot(store, made).collect()}
    assert set(kept) == {"x", "new"} and kept["x"] == {r["container"]: r["hash"] for r in reconcile.snapshot(store, a).collect()}["x"]
    with pytest.raises(ValueError):
        reconcile.default_mergers().merge(diff.Container(store, "x", "t", "1", ""), diff.Container(store, "x", "t", "2", ""), diff.Container(store, "x", "t", "1", ""))


def test_tree_files(spark):
    store = Store(spark)
    fs = TreeFiles(store)
    fs.write("a.txt", b"a")
    fs.write("b/c.txt", b"c")
    fs.write("b/e/f.txt", b"f")
    with pytest.raises(RuntimeError):
        fs.hash
    fs = TreeFiles(store, fs.save())
    assert fs.list() == [("a.txt", "file"), ("b", "directory")] and fs.list("b") == [("b/c.txt", "file"), ("b/e", "directory")]
    assert fs.read("b/e/f.txt") == b"f" and fs.file_exists("a.txt") and not fs.file_exists("x") and fs.directory_exists("b")
    for call, code in ((lambda: fs.file_exists("b"), "EISDIR"), (lambda: fs.directory_exists("a.txt"), "ENOTDIR"), (lambda: fs.read("x"), "ENOENT"), (lambda: fs.create_directory("b"), "EEXIST"), (lambda: fs.write("b", b""), "EISDIR"), (lambda: fs.write("a.txt/x", b""), "ENOTDIR")):
        with pytest.raises(FileError) as error:
            call()
        assert error.value.code == code
    before = fs.hash
    view = fs.chroot("b")
    view.write("c.txt", b"C")
    view.delete_directory("e")
    assert fs.modified and fs.read("b/c.txt") == b"C" and view.list() == [("c.txt", "file")]
    assert fs.save() != before
    fs.delete_file("b/c.txt")
    assert TreeFiles(store, fs.save()).list("b") == []


def test_file_table(spark, tmp_path):
    fs = FileTable(spark)
    fs.write("a/b/c", b"1")
    fs.create_directory("e")
    assert [r["path"] for r in fs.list(recursive=True).collect()] == ["a", "a/b", "a/b/c", "e"]
    assert [(r["path"], r["kind"]) for r in fs.list("a").collect()] == [("a/b", "directory")]
    view = fs.chroot("a")
    view.write("d", b"2")
    assert fs.read("a/d") == b"2" and view.read("b/c") == b"1"
    other = FileTable(spark)
    copied(fs, other)
    assert other.kind("e") is None and other.read("a/d") == b"2"
    fs.delete_directory("a")
    assert not fs.exists("a/b/c")
    for call, code in ((lambda: fs.read("e"), "EISDIR"), (lambda: fs.list("x"), "ENOENT"), (lambda: fs.create_directory("e"), "EEXIST"), (lambda: fs.delete_file("x"), "ENOENT")):
        with pytest.raises(FileError) as error:
            call()
        assert error.value.code == code


@pytest.mark.parametrize("n, last", [(1, "00"), (256, "ff"), (257, "01/00"), (65536, "ff/ff"), (65537, "01/00/00")])
def test_log_addresses(spark, n, last):
    rows = spark.range(n).select(log.address(F.col("id"), log.width(n)).alias("path"))
    assert rows.orderBy(F.desc("path")).first()["path"] == last and log.count(rows) == n


def test_log_append_and_check(spark):
    start = spark.createDataFrame([(0, None)], "idx long, payload binary")
    grown = log.appended(start, spark.range(300).select(F.col("id").alias("ord"), F.lit(bytearray(b"x")).alias("payload")))
    assert [r["idx"] for r in grown.orderBy("idx").collect()] == list(range(301))
    nodes = spark.createDataFrame([("a", 0, "00", FILE, ""), ("a", 1, "02", FILE, ""), ("b", 0, "00", FILE, "")], "tree_hash string, ord int, name string, mode int, child_hash string")
    assert [(r["tree_hash"], r["problem"]) for r in log.problems(nodes).collect()] == [("a", "names")]
    writer = log.SingleWriter()
    with writer, pytest.raises(RuntimeError), writer:
        pass


def test_traverse_and_reduce(spark):
    side = lambda rows: spark.createDataFrame([(p, "directory" if p[-1] == "/" else "file", p) for p in rows], "path string, kind string, hash string").withColumn("path", F.rtrim(F.regexp_replace("path", "/$", "")))
    one = ["emptyFolder/", "a/", "a/b/", "a/b/c", "a/b/d", "a/e", "b"]
    two = ["a/", "a/b/", "a/b/d", "a/e/", "a/e/f", "d"]
    merged = trees.traverse([side(one), side(two)])
    rows = merged.collect()
    assert [r["path"] for r in rows] == ["a", "a/b", "a/b/c", "a/b/d", "a/e", "a/e/f", "b", "d", "emptyFolder"]
    clash = next(r for r in rows if r["path"] == "a/e")
    assert (clash["at_0"]["kind"], clash["at_1"]["kind"]) == ("file", "directory")
    sums = trees.reduce_up(merged, F.lit(1), lambda own, values: own + F.aggregate(values, F.lit(0), lambda s, x: s + x))
    assert {r["path"]: r["value"] for r in sums.collect()}["a"] == 6


def test_streamed_rows_come_once(spark, tmp_path):
    from quillstone.streaming.journal import ingest

    spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "seq long, new string").write.parquet(str(tmp_path / "in"))
    for run in range(2):
        stream = spark.readStream.schema("seq long, new string").parquet(str(tmp_path / "in"))
        ingest(stream, str(tmp_path / "out"), str(tmp_path / f"check{run}"), ("seq",)).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_paths_below_a_missing_tree(spark):
    store = Store(spark)
    rows = spark.createDataFrame([("a.txt", FILE, bytearray(b"a"), None), ("b/bad", 0o040000, None, "00" * 19 + "02")], "path string, mode int, body binary, hash string")
    fs = TreeFiles(store, store.save_tree(rows))
    for path, code in (("b/bad/x", "EIO"), ("b/x", "ENOENT"), ("c", "ENOENT")):
        with pytest.raises(FileError) as error:
            fs.read(path)
        assert error.value.code == code


def test_a_store_grows_by_what_is_added(spark, monkeypatch):
    from quillstone.sources import store as module

    sizes = []
    monkeypatch.setattr(module, "written", lambda df, name: (sizes.append(df.count()), df)[1])
    store = Store(spark, spark.range(1000).selectExpr("sha1(cast(id as string)) hash", "'blob' type", "cast('x' as binary) body"))
    made = store.add_body("blob", b"one")
    store.set_ref("refs/heads/main", made)
    store.update_ref("refs/heads/main", made, PERSON, "again")
    assert sizes == [1] and store.has(made) and store.objects.count() == 1001 and store.journal.count() == 1


def test_commands(spark, tmp_path, capsys, monkeypatch):
    from quillstone import cli

    monkeypatch.setattr(cli, "local_session", lambda: spark)
    repo, work, out = (str(tmp_path / n) for n in ("repo", "work", "out"))
    (tmp_path / "work").mkdir()
    (tmp_path / "work" / "run.sh").write_bytes(b"#!")
    (tmp_path / "work" / "run.sh").chmod(0o755)
    (tmp_path / "work" / "plain").write_bytes(b"text")
    cli.main(["init", "-r", repo])
    config = (tmp_path / "repo" / "config").read_text() + "[mine]\n\tkept = yes\n"
    (tmp_path / "repo" / "config").write_text(config)
    cli.main(["init", "-r", repo])
    assert (tmp_path / "repo" / "config").read_text() == config and capsys.readouterr().out.split() == ["init", "reInit"]
    cli.main(["commit", "-r", repo, work, "-m", "first", "-c", "me"])
    with pytest.raises(ValueError):
        cli.main(["commit", "-r", repo, work, "-m", "again", "-c", "me"])
    cli.main(["checkout", "-r", repo, "refs/remotes/me/main", out])
    assert (tmp_path / "out" / "run.sh").stat().st_mode & 0o100 and not (tmp_path / "out" / "plain").stat().st_mode & 0o100
    assert (tmp_path / "out" / "plain").read_bytes() == b"text"
    with pytest.raises(StoreError, match="MissingObject"):
        cli.main(["checkout", "-r", repo, "refs/remotes/me/other", out])
    cli.main(["show-ref", "-r", repo])
    assert "refs/remotes/me/main" in capsys.readouterr().out


def test_one_writer_appends(spark):
    rows = log.Log(spark.createDataFrame([], "idx long, payload binary"))
    rows.append(spark.range(20).select(F.col("id").alias("ord"), F.lit(bytearray(b"x")).alias("payload")))
    assert [r["idx"] for r in rows.rows.orderBy("idx").collect()] == list(range(20))
    with rows._writer, pytest.raises(RuntimeError):
        rows.append(rows.rows.select(F.col("idx").alias("ord"), "payload"))
    with pytest.raises(Exception, match="levels"):
        spark.range(256, 257).select(log.address(F.col("id"), 1)).collect()
