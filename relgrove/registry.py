"""Which model is installed: a registry table with a row for each install, and differences between models."""

from __future__ import annotations

import hashlib
import json
from datetime import UTC, datetime

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from relgrove import __version__
from relgrove.plans.analysis import validate
from relgrove.plans.dsl import parse
from relgrove.plans.model import Model, to_dsl

SCHEMA = "version long, schema_checksum string, engine_version string, relations array<string>, relation_checksums map<string,string>, schema string, migrated_at timestamp"


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Registry:
    """Installs in a Parquet table at ``path``, append only; two at a time get two numbers."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    checksum = staticmethod(_digest)

    def rows(self):
        try:
            return self.spark.read.schema(SCHEMA).parquet(self.path)
        except AnalysisException:  # no table yet
            return self.spark.createDataFrame([], SCHEMA)

    def last(self) -> dict | None:
        row = self.rows().orderBy(F.desc("version")).limit(1).collect()
        return row[0].asDict() if row else None

    def migrate(self, schema_text: str, force: bool = False, dry_run: bool = False) -> dict:
        """Installs a schema; skips it if the last install has the same text and engine. Returns what changed."""
        model = validate(parse(schema_text)).model
        last = self.last()
        relations = {f"{t}.{r}": _digest(to_dsl(model.expr(t, r))) for t, r in model.nodes()}
        before = last["relation_checksums"] if last else {}
        changes = {
            "added": sorted(set(relations) - set(before)),
            "removed": sorted(set(before) - set(relations)),
            "changed": sorted(k for k in relations if k in before and before[k] != relations[k]),
        }
        same = last is not None and last["schema_checksum"] == _digest(schema_text) and last["engine_version"] == __version__
        if same and not force:
            return changes | {"skipped": True, "version": last["version"]}
        version = (last["version"] if last else 0) + 1
        if not dry_run:
            version = self._claim(version)
            row = (version, _digest(schema_text), __version__, sorted(relations), relations, schema_text, datetime.now(UTC).replace(tzinfo=None))
            self.spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").parquet(self.path)
        return changes | {"skipped": False, "version": version}

    def _claim(self, version: int) -> int:
        """The first number from ``version`` on that no other install has taken: a file of that name is made, which only one can do."""
        jvm = self.spark._jvm
        while True:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/_versions/{version}")
            files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
            files.mkdirs(path.getParent())
            try:
                files.create(path, False).close()
            except Py4JJavaError as e:
                if not files.exists(path):
                    raise e
                version += 1
            else:
                return version

    def status(self, schema_text: str | None = None) -> dict:
        last = self.last()
        if last is None:
            return {"installed": False}
        return {"installed": True, "version": last["version"], "engine_version": last["engine_version"], "relations": len(last["relations"]), "current": schema_text is not None and last["schema_checksum"] == _digest(schema_text)}


def difference(old: Model, new: Model) -> str:
    """What changes from one model to the other, as lines with + and -."""
    a = {f"{t}.{r}": to_dsl(old.expr(t, r)) for t, r in old.nodes()}
    b = {f"{t}.{r}": to_dsl(new.expr(t, r)) for t, r in new.nodes()}
    lines = []
    for k in sorted(a.keys() | b.keys()):
        if a.get(k) != b.get(k):
            lines += [f"{sign} {k}: {side[k]}" for sign, side in (("-", a), ("+", b)) if k in side]
    return "\n".join(lines)


def as_json(x) -> str:
    return json.dumps(x, sort_keys=True, default=str, indent=2)
