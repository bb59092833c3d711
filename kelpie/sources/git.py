"""Git repositories as a Spark data source: branches, commits, trees and differences, one task a repository."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMAS = {
    "branches": "repo string, branch string, commit string, committed_at string",
    "files": "repo string, branch string, file string, hash string",
    "changes": "repo string, file string, status string",
}


class GitSource(DataSource):
    """``format("git")`` with ``table`` (branches, files or changes), ``paths`` (comma-separated), ``branch``, ``base``, ``compare``."""

    @classmethod
    def name(cls) -> str:
        return "git"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "branches")]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p.strip()) for p in self.options["paths"].split(",") if p.strip()]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        path, o = partition.value, self.options
        repo = path.rstrip("/").rsplit("/", 1)[-1]

        def git(*args: str) -> list[str]:
            return subprocess.run(["git", "-C", path, *args], capture_output=True, text=True, timeout=300, check=True).stdout.splitlines()

        table = o.get("table", "branches")
        if table == "branches":
            for line in git("for-each-ref", "--format=%(refname:short)%09%(objectname)%09%(committerdate:iso)", "refs/heads"):
                yield (repo, *line.split("\t"))
        elif table == "files":
            branch = o.get("branch", "HEAD")
            for line in git("ls-tree", "-r", branch):
                head, file = line.split("\t", 1)
                yield repo, branch, file, head.split()[2]
        else:
            for line in git("diff", "--name-status", "--no-renames", f"{o['base']}..{o['compare']}"):
                status, file = line.split("\t", 1)
                yield repo, file, status if status in "AD" else "M"


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GitSource)
