"""Tables kept as numbered versions: readers see the newest complete one.

A version is a folder ``v=N``. Writing version N again replaces it, which makes a replayed
micro-batch harmless, and a reader never sees a folder that is being written, because only
folders with a success marker count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


#: First and last version that a folder holds.
Piece = tuple[int, int]


def _file_system(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())


def complete_pieces(spark: SparkSession, path: str) -> set[Piece]:
    """The finished folders as (first, last) version: ``v=N`` holds one, ``range=A-B`` several. Lists folder names only."""
    fs = _file_system(spark, path)
    make_path = spark._jvm.org.apache.hadoop.fs.Path
    if not fs.exists(make_path(path)):
        return set()
    found = set()
    for status in fs.listStatus(make_path(path)):
        name = status.getPath().getName()
        kind, _, numbers = name.partition("=")
        if kind in ("v", "range") and fs.exists(make_path(f"{path}/{name}/_SUCCESS")):
            first, _, last = numbers.partition("-")
            found.add((int(first), int(last or first)))
    return found


def complete_versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the finished single versions, ascending."""
    return sorted(first for first, last in complete_pieces(spark, path) if first == last)


def cover(pieces: set[Piece]) -> set[Piece]:
    """The pieces that lie in no other; ranges are nested or apart."""
    return {p for p in pieces if not any(q != p and q[0] <= p[0] and p[1] <= q[1] for q in pieces)}


def piece_path(path: str, piece: Piece) -> str:
    first, last = piece
    return f"{path}/v={first}" if first == last else f"{path}/range={first}-{last}"


def read_pieces(spark: SparkSession, path: str, schema: T.StructType, pieces: set[Piece]) -> DataFrame:
    if not pieces:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(piece_path(path, piece) for piece in sorted(pieces)))


def write_piece(df: DataFrame, path: str, piece: Piece) -> None:
    df.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(piece_path(path, piece))


def delete_piece(spark: SparkSession, path: str, piece: Piece) -> None:
    _file_system(spark, path).delete(spark._jvm.org.apache.hadoop.fs.Path(piece_path(path, piece)), True)


def piece_bytes(spark: SparkSession, path: str, piece: Piece) -> int:
    return _file_system(spark, path).getContentSummary(spark._jvm.org.apache.hadoop.fs.Path(piece_path(path, piece))).getLength()


def write_version(df: DataFrame, path: str, version: int, keep: int | None = None) -> None:
    write_piece(df, path, (version, version))
    if keep is not None:
        drop_old_versions(df.sparkSession, path, keep)


def drop_old_versions(spark: SparkSession, path: str, keep: int) -> None:
    """Forget all but the newest versions; the newest two are enough to replay a batch."""
    for version in complete_versions(spark, path)[:-keep]:
        delete_piece(spark, path, (version, version))


def read_version(spark: SparkSession, path: str, schema: T.StructType, before: int | None = None) -> DataFrame:
    """The newest complete version, or the newest below ``before``; no rows when there is none."""
    versions = [v for v in complete_versions(spark, path) if before is None or v < before]
    if not versions:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/v={versions[-1]}")


def replace_table(df: DataFrame, path: str) -> int:
    """Write the whole table as its next version and return the number; the current one stays readable."""
    spark = df.sparkSession
    version = max(complete_versions(spark, path), default=-1) + 1
    write_version(df, path, version)
    return version
