"""The one operator that keeps state: a moving average of a stream, for each key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What keeps the state, and the rows of a batch that goes out at once.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SENT_ROWS = 10_000


class Average(StatefulProcessor):
    """The state of a key is its average, null before the first value."""

    def __init__(self, decay: float):
        self.decay = decay

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("average", "now double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        steps, x = [], []
        for part in rows:  # two numbers a row; the source's trigger bounds them
            steps.append(part["step"].to_numpy(np.int64))
            x.append(part["x"].to_numpy(float, na_value=np.nan))
        steps, x = np.concatenate(steps), np.concatenate(x)
        order = np.argsort(steps, kind="stable")
        now = self.now.get()[0] if self.now.exists() else None
        for k in range(0, len(order), SENT_ROWS):
            out = []
            for value in x[order[k : k + SENT_ROWS]].tolist():
                if value == value:
                    now = value if now is None else now * self.decay + value * (1 - self.decay)
                out.append(now)
            yield pd.DataFrame({"key": key[0], "step": steps[order[k : k + SENT_ROWS]], "ema": pd.array(out, "Float64")})
        if now is not None:
            self.now.update((now,))

    def close(self) -> None:
        pass


def ema(stream: DataFrame, decay: float = 0.99) -> DataFrame:
    """A stream of (key string, step long, x double) -> key, step, ema, as fidelity.ema gives it for a table: the first value, then decay * before +
    (1 - decay) * x. A null x, or one that is not a number, changes nothing; before the first value the average is null. Rows of a trigger are taken in
    order of step; steps that come in a later trigger count after all earlier ones. The state survives restarts from the query's checkpoint.

    The state store must be RocksDB; where the session names none, this sets it.
    """
    spark = stream.sparkSession
    name = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(name, ""):
        spark.conf.set(name, PROVIDER)
    return stream.groupBy("key").transformWithStateInPandas(Average(decay), "key string, step long, ema double", "append", "None")
