"""A prompt for commands: python -m tarnfold FOLDER"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession

from .plans import CommandError
from .table import Session


def main(folder: str) -> None:
    spark = SparkSession.builder.appName("tarnfold").getOrCreate()
    session = Session(spark, folder)
    for line in sys.stdin:
        if not line.strip():
            continue
        try:
            out = session.run(line)
        except (CommandError, ValueError) as e:
            print(f"ERR {e}")
            continue
        for x in out if isinstance(out, list) else [out]:
            if isinstance(x, DataFrame):
                x.show(1000, truncate=False)
            else:
                print(x)
        if line.strip().upper() in ("QUIT", "EXIT"):
            break


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "tarnfold-data")
