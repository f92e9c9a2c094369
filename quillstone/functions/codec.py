"""Object encodings as column expressions: everything but inflating and cutting packed trees stays in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..tables import EXEC, FILE, SYM, TREE

ZEROS = "0" * 40
HASH = r"^[0-9a-f]{40}\z"
#: Characters at either end of a name that a person line cannot hold.
_EDGES = r"[\x00-\x20.,:;<>\"'\\]+"


def utf8(text: Column) -> Column:
    return F.encode(text, "utf-8")


def raw(kind: Column, body: Column) -> Column:
    """The bytes that are hashed and stored: kind, length in bytes, NUL, body."""
    return F.concat(utf8(F.concat(kind, F.lit(" "), F.octet_length(body).cast("string"))), F.lit(bytearray(1)), body)


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once a row; a plain column is computed again wherever f names it."""
    return F.get(F.transform(F.array(value), lambda x: f(x)), F.lit(0))


def object_id(kind: Column, body: Column) -> Column:
    return F.sha1(raw(kind, body))


def object_path(hash_: Column) -> Column:
    return F.concat(F.lit("objects/"), F.substring(hash_, 1, 2), F.lit("/"), F.substring(hash_, 3, 38))


def valid_hash(hash_: Column) -> Column:
    return F.coalesce(F.length(hash_) == 40, F.lit(False)) & F.coalesce(hash_.rlike(HASH), F.lit(False))


def packed(hash_: Column) -> Column:
    return F.unhex(hash_)


def unpacked(data: Column) -> Column:
    return F.lower(F.hex(data))


def checked_hash(hash_: Column) -> Column:
    return F.when(valid_hash(hash_), hash_).otherwise(F.raise_error(F.concat(F.lit("not an object id: "), F.coalesce(hash_, F.lit("null")))))


def octal(mode: Column) -> Column:
    return F.conv(mode.cast("string"), 10, 8)


def from_octal(text: Column) -> Column:
    return F.conv(text, 8, 10).cast("int")


def decimal(text: Column) -> Column:
    return F.try_to_number(text, F.lit("9" * 18)).cast("long")


def tree_key(name: Column, mode: Column) -> Column:
    """Entries sort by this: a directory's name as if it ended in a slash."""
    return F.when(mode == TREE, F.concat(name, F.lit("/"))).otherwise(name)


def tree_body(entries: Column) -> Column:
    """Bytes of a tree from an array of structs (name, mode, child_hash)."""
    keyed = F.array_sort(F.transform(entries, lambda e: F.struct(utf8(tree_key(e["name"], e["mode"])).alias("key"), e["name"].alias("name"), e["mode"].alias("mode"), e["child_hash"].alias("child_hash"))))
    one = lambda e: F.concat(utf8(F.concat(octal(e["mode"]), F.lit(" "), e["name"])), F.lit(bytearray(1)), packed(e["child_hash"]))
    return F.aggregate(keyed, F.lit(bytearray()), lambda s, e: F.concat(s, one(e)))


def sanitised(text: Column) -> Column:
    """A name without runs of punctuation at its ends, and without control and angle characters."""
    ends = F.regexp_replace(F.regexp_replace(text, f"^{_EDGES}", ""), f"{_EDGES}$", "")
    return F.regexp_replace(ends, r"[\x00-\x1F<>]+", "")


def zone(offset: Column) -> Column:
    """Minutes west of Greenwich as a signed hour and minute: 180 is -0300, 0 is +0000."""
    minutes = F.abs(offset)
    return F.format_string("%s%02d%02d", F.when(offset > 0, "-").otherwise("+"), F.floor(minutes / 60).cast("int"), F.pmod(minutes, F.lit(60)))


def person_line(person: Column) -> Column:
    return F.concat(sanitised(person["name"]), F.lit(" <"), sanitised(person["email"]), F.lit("> "), person["seconds"].cast("string"), F.lit(" "), zone(person["offset"]))


_PERSON = r"^(.*) <([^>]*)> ([0-9]+) ([+-])([0-9]{2})([0-9]{2})$"


def parsed_person(line: Column, strict: bool = True) -> Column:
    """A struct (name, email, seconds, offset). A malformed line raises, or is null where not strict."""

    def person(line: Column) -> Column:
        part = lambda k: F.regexp_extract(line, _PERSON, k)
        minutes = part(5).cast("int") * 60 + part(6).cast("int")
        made = F.struct(part(1).alias("name"), part(2).alias("email"), part(3).cast("long").alias("seconds"), F.when(part(4) == "+", -minutes).otherwise(minutes).alias("offset"))
        other = F.raise_error(F.concat(F.lit("not a person: "), F.coalesce(line, F.lit("null")))) if strict else F.lit(None)
        return F.when(F.coalesce(line.rlike(_PERSON), F.lit(False)), made).otherwise(other)

    return once(line, person)


def commit_body(tree: Column, parents: Column, author: Column, committer: Column, message: Column) -> Column:
    lines = F.concat(
        F.array(F.concat(F.lit("tree "), checked_hash(tree))),
        F.transform(parents, lambda p: F.concat(F.lit("parent "), checked_hash(p))),
        F.array(F.concat(F.lit("author "), person_line(author)), F.concat(F.lit("committer "), person_line(committer)), F.lit(""), message),
    )
    return utf8(F.concat_ws("\n", lines))


def tag_body(target: Column, kind: Column, tag: Column, tagger: Column, message: Column) -> Column:
    return utf8(F.concat_ws("\n", F.concat(F.lit("object "), checked_hash(target)), F.concat(F.lit("type "), kind), F.concat(F.lit("tag "), tag), F.concat(F.lit("tagger "), person_line(tagger)), F.lit(""), message))


def _from_headers(body: Column, made: Callable[[Column, Column], Column]) -> Column:
    """What is made of a body's lines of headers and its message; the body is decoded and split once."""

    def parts(text: Column) -> Column:
        head = F.substring_index(text, "\n\n", 1)
        message = F.substring(text, F.length(head) + 3, F.length(text))
        return once(F.struct(F.split(head, "\n").alias("lines"), message.alias("message")), lambda x: made(x["lines"], x["message"]))

    return once(F.decode(body, "utf-8"), parts)


def _values(lines: Column, key: str) -> Column:
    return F.transform(F.filter(lines, lambda x: x.startswith(f"{key} ")), lambda x: F.substring(x, F.lit(len(key) + 2), F.length(x)))


def parsed_commit(body: Column) -> Column:
    """A struct (tree, parents, author, committer, message), null for a null body; parents in order, headers of other kinds dropped."""

    def commit(lines: Column, message: Column) -> Column:
        one = lambda key: F.get(_values(lines, key), F.lit(0))
        return F.struct(one("tree").alias("tree"), _values(lines, "parent").alias("parents"), parsed_person(one("author")).alias("author"), parsed_person(one("committer")).alias("committer"), message.alias("message"))

    return F.when(body.isNotNull(), _from_headers(body, commit))


def parsed_tag(body: Column) -> Column:
    def tag(lines: Column, message: Column) -> Column:
        one = lambda key: F.get(_values(lines, key), F.lit(0))
        return F.struct(one("object").alias("object"), one("type").alias("type"), one("tag").alias("tag"), parsed_person(one("tagger")).alias("tagger"), message.alias("message"))

    return _from_headers(body, tag)


def ref_line(hash_: Column) -> Column:
    return F.concat(hash_, F.lit("\n"))


def parsed_ref_line(text: Column) -> Column:
    return checked_hash(F.trim(F.regexp_replace(text, r"^\s+|\s+$", "")))


def journal_line(previous: Column, new: Column, person: Column, description: Column) -> Column:
    return F.concat(F.coalesce(previous, F.lit(ZEROS)), F.lit(" "), new, F.lit(" "), person_line(person), F.lit("\t"), F.substring_index(description, "\n", 1), F.lit("\n"))


_JOURNAL = r"^([0-9a-f]{40}) ([0-9a-f]{40}) ([^\t]*)\t(.*)$"


def parsed_journal(text: Column) -> Column:
    """An array of structs (seq, previous, new, person, description) in the order of the lines."""
    lines = F.filter(F.split(text, "\n"), lambda x: x != "")

    def entry(line: Column, k: Column) -> Column:
        previous = F.regexp_extract(line, _JOURNAL, 1)
        return F.struct(k.cast("long").alias("seq"), F.when(previous == ZEROS, None).otherwise(previous).alias("previous"), F.regexp_extract(line, _JOURNAL, 2).alias("new"), parsed_person(F.regexp_extract(line, _JOURNAL, 3)).alias("person"), F.regexp_extract(line, _JOURNAL, 4).alias("description"))

    return F.transform(lines, entry)


_REF = r"^refs/remotes/([^/]+)/([^/]+)\z"


def branch_ref(client: Column, branch: Column) -> Column:
    return F.concat_ws("/", F.lit("refs/remotes"), client, branch)


def parsed_branch(ref: Column) -> Column:
    """A struct (client, branch), null unless the ref has exactly that form."""
    fits = F.coalesce(ref.rlike(_REF), F.lit(False))
    return F.when(fits, F.struct(F.regexp_extract(ref, _REF, 1).alias("client"), F.regexp_extract(ref, _REF, 2).alias("branch")))


def is_blob(mode: Column) -> Column:
    return mode.bitwiseAND(F.lit(0o100000)) == 0o100000


def is_file(mode: Column) -> Column:
    """Ordinary and executable files; a symbolic link is a blob but no file, a submodule neither."""
    return mode.bitwiseAND(F.lit(0o170000)) == 0o100000


def mode_type(mode: Column) -> Column:
    return F.when(mode == TREE, "tree").when(mode.bitwiseAND(F.lit(0o170000)) == 0o160000, "commit").when(is_file(mode) | (mode == SYM), "blob").otherwise("unknown")


def mode_of(kind: Column) -> Column:
    return F.when(kind == "tree", TREE).when(kind == "exec", EXEC).when(kind == "symlink", SYM).otherwise(FILE)


_SEGMENT = r"[A-Za-z0-9 ._@=+,~^(){}\[\]!#$%&'`;-]+"


def parsed_path(path: Column) -> Column:
    """The path without one slash at each end; null where a segment is empty, `.`, `..` or has other characters."""
    bare = F.regexp_replace(F.regexp_replace(path, "^/", ""), "/$", "")
    parts = F.split(bare, "/")
    fine = (bare == "") | (F.forall(parts, lambda s: s.rlike(rf"^{_SEGMENT}\z") & ~s.isin(".", "..")))
    return F.when(fine, bare)


def segments(path: Column) -> Column:
    return F.when(path == "", F.array().cast("array<string>")).otherwise(F.split(path, "/"))


def num_segments(path: Column) -> Column:
    return F.size(segments(path))


def segment_at(path: Column, k: int) -> Column:
    return F.get(segments(path), F.lit(k))


def is_root(path: Column) -> Column:
    return path == ""


def leaf(path: Column) -> Column:
    return F.when(path != "", F.element_at(F.split(path, "/"), -1))


def parent(path: Column) -> Column:
    """The path above, the empty path being the root; null for the root."""
    parts = F.split(path, "/")
    return F.when(path != "", F.concat_ws("/", F.slice(parts, F.lit(1), F.size(parts) - 1)))


def joined_path(left: Column, right: Column) -> Column:
    return F.when(left == "", right).when(right == "", left).otherwise(F.concat(left, F.lit("/"), right))


def starts_with(path: Column, prefix: Column) -> Column:
    """By whole segments: `ab` is not under `a`."""
    return (prefix == "") | (path == prefix) | path.startswith(F.concat(prefix, F.lit("/")))


def is_parent_of(path: Column, other: Column) -> Column:
    return starts_with(other, path) & (other != path)


def is_immediate_parent_of(path: Column, other: Column) -> Column:
    return F.coalesce(parent(other) == path, F.lit(False))


def client_person(client: Column, seconds: Column, offset: Column, domain: str = "client.invalid") -> Column:
    """The committer that a client writes as; the time is given, never read from a clock here."""
    return F.struct(client.alias("name"), F.concat(client, F.lit(f"@{domain}")).alias("email"), seconds.cast("long").alias("seconds"), offset.cast("int").alias("offset"))


def entry_name(number: Column) -> Column:
    """Two hexadecimal digits of a number from 0 to 255."""
    return F.lpad(F.lower(F.hex(number)), 2, "0")


def entry_number(name: Column) -> Column:
    return F.when(name.rlike("^[0-9a-f]{2}$"), F.conv(name, 16, 10).cast("int"))


def container_config(body: Column) -> Column:
    """A struct (type, version, error) from the JSON of a container's settings."""
    text = F.decode(body, "utf-8")
    data = F.from_json(text, "type string, typeVersion string, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    error = F.when(body.isNull(), "missing").when(data["_corrupt"].isNotNull() | data.isNull(), "not json").when(F.coalesce(data["type"], F.lit("")) == "", "no type").when(F.coalesce(data["typeVersion"], F.lit("")) == "", "no version")
    return F.struct(data["type"].alias("type"), data["typeVersion"].alias("version"), error.alias("error"))
