"""The key of a file: repository and path, or the path where a table has no repository."""

from __future__ import annotations

from pyspark.sql import DataFrame


def file_key(*frames: DataFrame) -> list[str]:
    """``repo`` and ``file_path`` if all frames have both, else ``file_path`` (absolute paths are unique)."""
    return ["repo", "file_path"] if all("repo" in f.columns for f in frames) else ["file_path"]
