"""Six commands over a repository folder: init, commit, checkout, fetch, log, show-ref."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import functions as F

from .operators import sync
from .session import local_session, ship
from .sources.files import executable, folder_exists, read_folder, write_folder
from .sources.store import Store
from .tables import EXEC, FILE


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="quillstone", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("init", "commit", "checkout", "fetch", "log", "show-ref"):
        command = commands.add_parser(name)
        command.add_argument("--repository", "-r", default=".")
        if name in ("commit", "checkout"):
            command.add_argument("ref" if name == "checkout" else "directory")
        if name == "checkout":
            command.add_argument("directory")
        if name == "commit":
            command.add_argument("--message", "-m", required=True)
            command.add_argument("--branch", "-b", default="main")
            command.add_argument("--allow-duplicate", action="store_true")
        if name in ("commit", "fetch"):
            command.add_argument("--client", "-c", required=True)
        if name == "fetch":
            command.add_argument("remote")
        if name == "log":
            command.add_argument("ref")
    run(parser.parse_args(arguments))


def run(options: argparse.Namespace) -> None:
    spark = ship(local_session())
    there = options.command != "init" or folder_exists(spark, options.repository)
    store = Store.read_layout(spark, options.repository) if there else Store(spark)
    if options.command == "init":
        print(found := store.init())
        if found == "init":
            store.write_layout(options.repository)
    elif options.command == "commit":
        print(commit(store, options.directory, options.client, options.branch, options.message, int(time.time()), options.allow_duplicate))
        store.write_layout(options.repository)
    elif options.command == "checkout":
        write_folder(store.checkout(options.ref), options.directory)
    elif options.command == "fetch":
        for ref in sync.fetch_refs(store, Store.read_layout(spark, options.remote), options.client):
            print(ref)
        store.write_layout(options.repository)
    elif options.command == "log":
        for row in store.log(options.ref).toLocalIterator():
            print(f"commit {row['hash']}\nAuthor: {row['name']} <{row['email']}>\nDate:   {row['date']}\n\n    {row['message']}\n")
    else:
        for row in store.show_refs().toLocalIterator():
            print(f"{row['hash']} {row['ref']}{'' if row['found'] else ' (not found)'}")


def commit(store: Store, directory: str, client: str, branch: str, message: str, seconds: int, allow_duplicate: bool = False) -> str:
    """Commits a folder's files to a client's branch. The same tree as the head's is refused unless allowed."""
    mode = F.when(executable(store.spark, directory)(F.col("path")), EXEC).otherwise(FILE)
    files = read_folder(store.spark, directory).select("path", mode.alias("mode"), "body", F.lit(None).cast("string").alias("hash"))
    tree = store.save_tree(files)
    ref = f"refs/remotes/{client}/{branch}"
    head = store.get_ref(ref)
    if head and not allow_duplicate and store.commits().filter(F.col("hash") == head).first()["tree"] == tree:
        raise ValueError("nothing has changed")
    return store.commit(ref, tree, (client, f"{client}@client.invalid", seconds, 0), message)


if __name__ == "__main__":
    main()
