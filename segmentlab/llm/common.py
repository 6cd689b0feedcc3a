"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, an absent one as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def row_key(*parts: Column) -> Column:
    """A name of a row made of its ``parts``, for rows whose doc_id is absent or repeated; never absent itself."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("-")) for p in parts)), 256)


def keep_keys(docs: DataFrame, key: Column, keep: DataFrame, once: bool = True) -> DataFrame:
    """The rows of ``docs`` whose ``key`` is in the one column of ``keep``; of rows of one key any one, if ``once``."""
    wanted = keep.select(F.col(keep.columns[0]).alias("_row_key")).distinct()
    kept = docs.withColumn("_row_key", key).join(wanted, "_row_key", "left_semi")
    return (kept.dropDuplicates(["_row_key"]) if once else kept).select(*docs.columns)


def per_text(docs: DataFrame, columns: str, maker: Callable[[], Callable[[list[str | None]], list]],
             key: str = "doc_id", text: str = "text", rows: int = 1000) -> DataFrame:
    """The key of each row, and ``columns`` (a schema) computed from its whole text.

    ``maker`` runs once per task and gives a function from a list of texts to one list or
    array per column. Texts go through in Arrow batches, ``rows`` at a time.
    """
    schema = f"{key} long, {columns}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = maker()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                found = compute(part.column(1).to_pylist())
                arrays = [part.column(0), *(pa.array(v, t) for v, t in zip(found, types))]
                yield pa.RecordBatch.from_arrays(arrays, names)

    wanted = to_arrow_schema(_parse_datatype_string(schema))
    names, types = wanted.names, list(wanted.types)[1:]
    return docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text)).mapInArrow(run, schema)


#: Words of 64 bits in one row of a bitmap on its way to the driver.
_WORDS = 4096


def bitmap(found: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of 2**bits bits with those set that the first ``bits`` bits of the column ``h`` name.

    It comes to the driver as blocks of 32 KiB, so its size is fixed whatever the input.
    """
    bit = f"shiftrightunsigned(h, {64 - bits})"
    words = found.groupBy(F.expr(f"cast(shiftright({bit}, 6) as int)").alias("w")).agg(
        F.expr(f"bit_or(shiftleft(1L, cast({bit} & 63 as int)))").alias("b"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            w, b = (batch.column(i).to_numpy(zero_copy_only=False).astype("int64") for i in (0, 1))
            for k in np.unique(w // _WORDS).tolist():
                own = w // _WORDS == k
                blocks.setdefault(k, np.zeros(_WORDS, "int64"))[w[own] % _WORDS] = b[own]
        if blocks:
            yield pa.RecordBatch.from_arrays([pa.array([*blocks], pa.int32()), pa.array([v.tobytes() for v in blocks.values()], pa.binary())], ["k", "block"])

    packed = words.repartition(F.expr(f"w div {_WORDS}")).mapInArrow(pack, "k int, block binary")
    out = np.zeros(max(1 << (bits - 6), _WORDS), "int64")
    for row in packed.collect():
        out[row.k * _WORDS:(row.k + 1) * _WORDS] = np.frombuffer(row.block, "int64")
    return out.view("uint64")


def marked(words: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    """Which of the hashes have their bit set."""
    at = (hashes >> np.uint64(64 - bits)).astype("int64")
    return (words[at >> 6] >> (at & 63).astype("uint64")) & np.uint64(1) != 0
