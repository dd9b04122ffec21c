"""Sources of captured service pages and Git histories.

Services that are asked by primary key, page token, offset or cursor are captured as page files named
<keyword>__<n>.json, each with a list of documents. A filter on `keyword` or a range of `page` chooses files before
anything is read; filters on doc_id, severity, ecosystem and a window of `published` choose documents before they
leave the reader. Any folder that driver and executors see will do.
"""

from __future__ import annotations

import glob
import json
import os
import subprocess

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import plugins


class CapturedPages(plugins.Collector):
    name = "captured_pages"
    schema = "keyword string, page int, ordinal int, doc_id string, published string, severity string, ecosystem string, document string"
    pushed = ("keyword", "page", "doc_id", "published", "severity", "ecosystem")

    def partitions(self, wanted):
        out = []
        for path in sorted(glob.glob(os.path.join(self.options["path"], "*__*.json"))):
            keyword, _, n = os.path.basename(path)[:-5].rpartition("__")
            if n.isdigit():
                row = {"keyword": keyword, "page": int(n)}
                files_only = plugins.Wanted(*({c: v for c, v in part.items() if c in row} for part in (wanted.equal, wanted.least, wanted.most)))
                if files_only.admits(row):
                    out.append((path, keyword, int(n)))
        return sorted(out, key=lambda p: (p[1], p[2]))

    def rows(self, partition, wanted):
        path, keyword, n = partition
        with open(path, encoding="utf-8") as f:
            for i, doc in enumerate(json.load(f)):
                fields = doc if isinstance(doc, dict) else {}
                text = lambda *names: next((str(fields[k]) for k in names if fields.get(k) is not None), None)
                yield {"keyword": keyword, "page": n, "ordinal": i, "doc_id": text("id", "ghsaId", "cve_id"), "published": text("published", "publishedAt", "published_at"), "severity": text("severity"), "ecosystem": text("ecosystem"), "document": json.dumps(doc, ensure_ascii=False)}


class GitHistory(DataSource):
    """Commits of local repositories since a date: option repos (comma separated) and since. One partition per repository."""

    @classmethod
    def name(cls):
        return "git_history"

    def schema(self):
        return "repository string, commit_sha string, committed_date string, commit_message string"

    def reader(self, schema):
        return _GitReader(self.options)


class _GitReader(DataSourceReader):
    def __init__(self, options):
        self.repos = [r for r in options.get("repos", "").split(",") if r]
        self.since = options.get("since", "")

    def partitions(self):
        return [InputPartition(r) for r in self.repos]

    def read(self, partition):
        repo = partition.value
        cmd = ["git", "-c", "safe.directory=*", "-C", repo, "log", "--format=%H%x1f%cI%x1f%B%x1e", *([f"--since={self.since}"] if self.since else [])]
        # the log is read as it comes, never as a whole
        with subprocess.Popen(cmd, stdout=subprocess.PIPE, text=True, encoding="utf-8", errors="replace") as git:
            held = ""
            for chunk in iter(lambda: git.stdout.read(1 << 16), ""):
                *records, held = (held + chunk).split("\x1e")
                for rec in records:
                    parts = rec.strip("\n").split("\x1f")
                    if len(parts) == 3:
                        yield repo, parts[0], parts[1], parts[2].strip()
        if git.returncode:
            raise RuntimeError(f"git log failed in {repo}")


def register(spark: SparkSession) -> None:
    plugins.register(spark, CapturedPages)
    spark.dataSource.register(GitHistory)
