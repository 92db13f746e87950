"""Makes the library importable on executors, and deals rows over their cores."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the library's source to the Python workers, once for each application.

    A submission with --py-files needs no such call; a session that was made elsewhere does.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    handle, path = tempfile.mkstemp(prefix="scholium-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(path)  # the driver serves it to the executors
    _shipped.add(context.applicationId)


def dealt(rows: DataFrame) -> DataFrame:
    """rows over three tasks for each core, evenly, however few or uneven the pieces they are stored in.

    Small compressed files are one piece each, or one for each group of rows, while Python
    takes far longer for their rows than reading does. Tasks stream, so their size doesn't matter.
    """
    return rows.repartition(3 * rows.sparkSession.sparkContext.defaultParallelism)
