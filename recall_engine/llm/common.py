"""Helpers shared by the text-preparation operators."""

from __future__ import annotations

import functools
import gc
import os
import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The characters that contracts call white space: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\f\r"



def _sure(c: str, folded: bool) -> bool:
    """Characters whose class has been the same since Unicode 3.2 and is a letter, mark, decimal digit, punctuation or symbol: Python's
    ``re`` and the tokenizers' own engine agree about them. Folded: those too that lower-casing one by one and composition
    leave alone but for one other such character."""
    old, new = unicodedata.ucd_3_2_0.category(c), unicodedata.category(c)
    if old[0] != new[0] or not (old[0] in "LMPS" or old == "Nd" == new):
        return False
    return not folded or old[0] != "M" and unicodedata.normalize("NFC", c) == c and len(c.lower()) == 1 and c != "\u03a3" and not "\u1100" <= c <= "\u11ff"


@functools.lru_cache(maxsize=2)
def unsure(folded: bool) -> re.Pattern:
    """Finds a character that is not sure."""
    runs: list[list[int]] = []
    for c in range(0x80, 0x30000):
        if _sure(chr(c), folded):
            if runs and runs[-1][1] == c - 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
    return re.compile("[^\t\n\r\x20-\x7e" + "".join(f"{chr(a)}-{chr(b)}" for a, b in runs) + "]")


def plain(text: str, folded: bool = False) -> bool:
    """True if the fast splitters give the same pieces as the library; any other text goes to the library as a whole."""
    return text.isascii() and not _CONTROL.search(text) or unsure(folded).search(text) is None


_CONTROL = re.compile("[^\t\n\r\x20-\x7e]")


class ByteChars(dict):
    """How the library's byte-level splitter writes characters: for ``str.translate``."""

    def __missing__(self, c: int) -> str:
        from tokenizers import pre_tokenizers

        ((shown, _),) = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(c))
        self[c] = shown
        return shown


BYTE_CHARS = ByteChars()


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only. For texts of ASCII alone the built-in ``lower`` does just that and is much faster."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


_held: dict[str, Callable[[], object]] = {}


def hold(operator: str, clear: Callable[[], object] = lambda: None) -> None:
    """Says in a worker that this operator's caches are in use; another operator's, left by earlier tasks, go."""
    for other in [n for n in _held if n != operator]:
        _held.pop(other)()
    _held[operator] = clear


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a scale directory; where it comes in fewer splits than there are cores, dealt out evenly."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def set_aside(docs: DataFrame, *named: str) -> tuple[DataFrame, list[str]]:
    """The rows under neutral column names, which no operator's own columns clash with, and the neutral names of the
    columns named. ``restored`` gives the old names back."""
    inner = docs.toDF(*[f"given_{i}" for i in range(len(docs.columns))])
    return inner, [f"given_{docs.columns.index(n)}" for n in named]


def restored(inner: DataFrame, docs: DataFrame, **own: Column) -> DataFrame:
    """The columns of docs from those set aside, with further columns of ours, which replace any of the same name."""
    low = {n.lower() for n in own}
    old = [F.col(f"given_{i}").alias(c) for i, c in enumerate(docs.columns) if c.lower() not in low]
    return inner.select(*old, *[c.alias(n) for n, c in own.items()])


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's, or one in the warehouse only where none is set."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", "")
    if not named and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/recall_engine_checkpoints")
    return named or sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder, without the plan that made them."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Lets the shuffle files of finished steps go: Spark removes them once no plan refers to them, which only a collection of
    garbage on the driver finds out."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies; RECALL_TOKENIZERS overrides the installed folder."""
    folder = os.environ.get("RECALL_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))
