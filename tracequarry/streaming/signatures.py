"""Error signatures on a stream: each is told once, when it is first seen."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state of keys is kept by this provider, which transformWithState needs.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: What differs from one occurrence to the next, and what stands for it, in this order.
_PLAIN = (
    (r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "<id>"),
    (r"\b0x[0-9a-fA-F]+\b", "<hex>"),
    (r"(?<![\w<])/(?:[\w.+-]+/)*[\w.+-]+", "<path>"),
    (r'"[^"\n]*"|\'[^\'\n]*\'', "<text>"),
    (r"\d+(?:\.\d+)?", "<n>"),
    (r"\s+", " "),
)


def signature(message: Column) -> Column:
    """An error message without the ids, addresses, paths, quoted texts and numbers of one occurrence."""
    for pattern, instead in _PLAIN:
        message = F.regexp_replace(message, pattern, instead)
    return F.substring(F.trim(message), 1, 300)


class _Seen(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", T.StructType([T.StructField("n", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, first = 0, None
        for part in rows:
            n += int(part["n"].sum())
            first = part["at"].min() if first is None else min(first, part["at"].min())
        if not self.seen.exists():
            yield pd.DataFrame({"signature": [key[0]], "first_at": [first], "n_sampled": [n]})
            self.seen.update((n,))

    def close(self) -> None:
        pass


def told_once(errors: DataFrame, known: DataFrame | None = None, key: str = "signature", at: str = "at") -> DataFrame:
    """signature, first_at, n_sampled: a row for each signature in the batch in which the stream first has it, with its count there, and never again.

    known: signatures that are not told at all. What has been seen is kept by key, so each key's rows meet in one task; state is one number a signature, and a restart from the
    checkpoint goes on with it. Set spark.sql.streaming.stateStore.providerClass to PROVIDER.
    """
    rows = errors.select(F.col(key).alias("signature"), F.col(at).cast("timestamp").alias("at"), F.lit(1).cast("long").alias("n")).filter("signature is not null")
    if known is not None:
        rows = rows.join(F.broadcast(known.select(F.col(key).alias("signature")).distinct()), "signature", "left_anti")
    return rows.groupBy("signature").transformWithStateInPandas(statefulProcessor=_Seen(), outputStructType="signature string, first_at timestamp, n_sampled long", outputMode="Append", timeMode="None")
