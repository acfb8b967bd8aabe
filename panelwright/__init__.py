"""Panel analytics on Spark: relational, temporal and training-data operators as DataFrame functions."""

from __future__ import annotations


def ship(spark) -> None:
    """Sends this package to the executors of a session on which it isn't installed, as functions that run there in
    Arrow workers are imported by name."""
    import shutil
    import tempfile
    from pathlib import Path

    home = Path(__file__).resolve().parent
    spark.sparkContext.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp()}/{home.name}", "zip", home.parent, home.name))
