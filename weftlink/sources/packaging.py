"""Putting validated results into one archive, on the driver."""

from __future__ import annotations

import zipfile
from pathlib import Path

from pyspark.sql import DataFrame


def package(report: DataFrame, files: dict[str, str], target: str) -> bool:
    """Zip ``files`` (name in the archive -> local path) unless the report has an error. The report has one row per rule."""
    if report.where("severity = 'error' AND n > 0").head(1):
        return False
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for name, path in sorted(files.items()):
            p = Path(path)
            for part in sorted(p.rglob("*")) if p.is_dir() else [p]:
                if part.is_file() and not part.name.startswith((".", "_")):
                    z.write(part, f"{name}/{part.relative_to(p)}" if p.is_dir() else name)
    return True
