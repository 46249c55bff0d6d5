"""Helpers shared by the operators: row identity and kept columns; durable cuts of the lineage come from the library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from babelshelf.storage import clear, cut, drop_cut, shared_dir, shared_path

__all__ = ["BLANKS", "DOCUMENT_COLUMNS", "beside", "carried", "clear", "cut", "drop_cut", "identified", "keep_rows", "restored", "shared_dir", "shared_path"]

#: The characters that separate words in every contract: space, tab, LF, VT, FF, CR.
BLANKS = " \t\n\x0b\x0c\r"
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def beside(own: tuple[str, ...], keep: tuple[str, ...]) -> dict[str, str]:
    """The names under which ``keep`` stands beside the columns ``own``: as it is, with ``_in`` added while that is taken."""
    taken, names = {x.lower() for x in own}, {}
    for column in keep:
        name = column
        while name.lower() in taken:
            name += "_in"
        taken.add(name.lower())
        names[column] = name
    return names


def carried(keep: tuple[str, ...]) -> list[Column]:
    """``keep`` as one column, so that no name in it meets an operator's own; ``restored`` undoes it."""
    return [F.struct(*(F.col(f"`{c}`") for c in keep)).alias("__keep")] if keep else []


def restored(own: tuple[str, ...], keep: tuple[str, ...]) -> list[Column]:
    return [F.col("__keep").getField(c).alias(name) for c, name in beside(own, keep).items()]


def identified(docs: DataFrame, column: str = "__row", columns: tuple[str, ...] = DOCUMENT_COLUMNS) -> DataFrame:
    """``columns`` and a unique id, which is the same whenever the rows are read again.

    It is the file (as a 64-bit hash of its path) and the row's place in it. Anything but a plain scan of files is
    written first.
    """
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        docs = cut(docs.select(*columns), "rows")
    place = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return docs.select(*columns, place.alias(column))


def keep_rows(docs: DataFrame, keepers: DataFrame, column: str = "__row") -> DataFrame:
    """The rows of ``docs`` whose ``column`` is in ``keepers``; ids alone are held in memory, texts aren't sorted.

    A task holds the ids of its shuffle partition, so the number of these must grow with the input.
    """
    return docs.join(keepers.select(column).hint("shuffle_hash"), column, "left_semi")
