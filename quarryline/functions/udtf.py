"""Table functions for SQL: rows that a document holds, beside the document's own row."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from quarryline.functions.kernels import parse_manifest, redact


@udtf(returnType="declared string, name string, version string, indirect boolean")
class ManifestRows:
    """The dependencies of a manifest, one row each."""

    def eval(self, path: str, text: str) -> Iterator[tuple]:
        declared, deps = parse_manifest(path, text)
        for name, version, indirect in deps:
            yield declared, name, version, indirect


@udtf(returnType="class string")
class SecretRows:
    """The classes of secrets in a text, one row for each place."""

    def eval(self, text: str) -> Iterator[tuple]:
        for name in redact(text or "")[1]:
            yield (name,)


def register(spark: SparkSession) -> None:
    """manifest_rows(path, text) and secret_rows(text) for SQL of this session."""
    spark.udtf.register("manifest_rows", ManifestRows)
    spark.udtf.register("secret_rows", SecretRows)
