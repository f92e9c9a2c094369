"""The three decodings that no built-in expresses: inflating, cutting packed trees, and reading settings files."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..tables import ENTRIES


@F.pandas_udf(T.BinaryType())
def inflated(data: pd.Series) -> pd.Series:
    return data.map(lambda x: None if x is None else zlib.decompress(bytes(x)))


@F.pandas_udf(T.BinaryType())
def deflated(data: pd.Series) -> pd.Series:
    return data.map(lambda x: None if x is None else zlib.compress(bytes(x)))


def decoded(raw: Column) -> Column:
    """A struct (type, body, error) of an object's stored bytes: error tells a missing mark, a wrong size or an unknown type."""
    head = F.substring_index(F.decode(F.substring(raw, 1, 32), "iso-8859-1"), "\x00", 1)
    body = raw.substr(F.length(head) + 2, F.octet_length(raw))
    kind, size = F.substring_index(head, " ", 1), F.substring_index(head, " ", -1)
    error = (
        F.when((F.length(head) >= 32) | ~F.contains(head, F.lit(" ")), "no header")
        .when(F.coalesce(size.try_cast("long"), F.lit(-1)) != F.octet_length(body), "wrong size")
        .when(~kind.isin("blob", "tree", "commit", "tag"), "unknown type")
    )
    return F.struct(kind.alias("type"), body.alias("body"), error.alias("error"))


def cut_tree(body: bytes) -> Iterator[tuple[int, str, int, str]]:
    """(ord, name, mode, child_hash) of each entry of a tree's bytes, in their stored order."""
    at = k = 0
    while at < len(body):
        space = body.index(b" ", at)
        end = body.index(b"\x00", space)
        yield k, body[space + 1 : end].decode(), int(body[at:space], 8), body[end + 1 : end + 21].hex()
        at, k = end + 21, k + 1


def tree_entries(trees: DataFrame) -> DataFrame:
    """Entries of all trees of (hash, body)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(h, *e) for h, b in zip(frame["hash"], frame["body"]) for e in cut_tree(bytes(b))]
            yield pd.DataFrame(rows, columns=["tree_hash", "ord", "name", "mode", "child_hash"])

    return trees.select("hash", "body").mapInPandas(run, ENTRIES)


_SECTION = re.compile(r'^\s*\[\s*([A-Za-z0-9.-]+)(?:\s+"((?:[^"\\\n]|\\.)*)")?\s*\]\s*(.*)$')
_NAME = re.compile(r"^\s*([A-Za-z][A-Za-z0-9-]*)\s*(?:=\s*(.*))?$")


def _value(text: str) -> str:
    out, quoted, k, kept = [], False, 0, 0
    while k < len(text):
        c = text[k]
        if c == "\\":
            if k + 1 >= len(text):
                raise ValueError("a line cannot be continued")
            more = {"n": "\n", "t": "\t", "b": "\b", '"': '"', "\\": "\\"}.get(text[k + 1])
            if more is None:
                raise ValueError(f"unknown escape \\{text[k + 1]}")
            out.append(more)
            k, kept = k + 2, len(out)
            continue
        if c == '"':
            quoted, kept = not quoted, len(out)
        elif c in "#;" and not quoted:
            break
        else:
            out.append(c)
            if quoted or not c.isspace():
                kept = len(out)
        k += 1
    if quoted:
        raise ValueError("a quotation does not end")
    return "".join(out[:kept])


def parse_config(text: str) -> dict[str, list[str]]:
    """Values by `section[.subsection].name`, in order. A bare name is `true`; included files and continued lines are refused."""
    out: dict[str, list[str]] = {}
    section: str | None = None
    for line in text.split("\n"):
        rest = line.rstrip("\r")
        if found := _SECTION.match(rest):
            name, sub, rest = found.groups()
            if name.lower() in ("include", "includeif"):
                raise ValueError("included files are not supported")
            section = name if sub is None else name + "." + re.sub(r"\\(.)", r"\1", sub)
        bare = rest.strip()
        if not bare or bare[0] in "#;":
            continue
        plain = re.sub(r"\s*[#;].*$", "", bare) if "=" not in bare else bare
        found = _NAME.match(plain)
        if section is None or not found:
            raise ValueError(f"not a setting: {bare}")
        out.setdefault(f"{section}.{found[1]}", []).append("true" if found[2] is None else _value(found[2]))
    return out


@F.pandas_udf(T.MapType(T.StringType(), T.ArrayType(T.StringType())))
def parsed_config(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else parse_config(t))


def config_string(config: Column, key: str) -> Column:
    """The last value of a key, null where there is none."""
    return F.element_at(F.try_element_at(config, F.lit(key)), -1)


def config_number(config: Column, key: str) -> Column:
    """The last value as a number; a missing key or another text raises."""
    value = config_string(config, key).try_cast("double")
    return F.coalesce(value, F.raise_error(F.lit(f"not a number: {key}")).cast("double"))
