"""Streams: models that learn from micro-batches, streaming prediction, keyed drift detection.

What a model has learnt is written after each micro-batch into a folder beside the stream's offsets, one sub-folder for each
batch id. A batch starts from the newest state before it, so that a restart goes on where the offsets do, and a batch that is run
again after a failure gives the same state.
"""

from __future__ import annotations

import copy
import uuid
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..errors import EmptyDataError
from ..frame import mapped, shared_dir, shipped
from ..operators.folds import DDM
from ..operators.linear import LinearModel, LinearRegression, moments, normal_matrix


class BatchStates:
    """Tables of state by batch id under a folder; the two newest stay."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def ids(self) -> list[int]:
        """Batches whose state was written to its end."""
        if not self._fs.exists(self._path(self.folder)):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(self.folder))]
        done = [int(n[6:]) for n in names if n.startswith("batch-") and self._fs.exists(self._path(f"{self.folder}/{n}/_SUCCESS"))]
        return sorted(done)

    def read(self, before: int | None = None) -> DataFrame | None:
        """The newest state, or the newest before a batch."""
        able = [i for i in self.ids() if before is None or i < before]
        return self.spark.read.parquet(f"{self.folder}/batch-{able[-1]}") if able else None

    def write(self, state: DataFrame, batch_id: int) -> None:
        state.write.mode("overwrite").parquet(f"{self.folder}/batch-{batch_id}")
        for old in self.ids()[:-2]:
            self._fs.delete(self._path(f"{self.folder}/batch-{old}"), True)


class _Fitted:
    """A model fitted by micro-batches. state: the folder of its states; beside the offsets if a stream is fitted."""

    def __init__(self, state: str | None = None):
        self.folder: str | None = state
        self._states: BatchStates | None = None

    def states(self, spark: SparkSession) -> BatchStates:
        if self._states is None:
            if self.folder is None:
                self.folder = f"{shared_dir(spark).rstrip('/')}/states-{uuid.uuid4().hex}"
            self._states = BatchStates(spark, self.folder)
        return self._states

    def update(self, batch: DataFrame, batch_id: int) -> None:
        raise TypeError("a model of its own kind is needed")

    def fit_stream(self, stream: DataFrame, checkpoint: str):
        """Run over all that is available now; run again with the same checkpoint, go on from there."""
        if self.folder is None:
            self.folder = f"{checkpoint.rstrip('/')}-states"
        self.states(stream.sparkSession)
        stream.writeStream.foreachBatch(self.update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        return self


class StreamingLinearRegression(_Fitted):
    """Exact least squares over everything seen: each micro-batch adds its moments (one aggregate)."""

    def __init__(self, features: Sequence[str], target: str, state: str | None = None):
        super().__init__(state)
        self.features, self.target = tuple(features), target

    def update(self, batch: DataFrame, batch_id: int) -> None:
        states = self.states(batch.sparkSession)
        now = batch.agg(F.count("*").alias("n"), *moments(self.features, self.target))
        old = states.read(before=batch_id)
        if old is not None:
            both = now.unionByName(old)
            now = both.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in both.columns])
        states.write(now, batch_id)

    def _total(self) -> dict:
        state = self._states.read() if self._states else None
        if state is None:
            raise EmptyDataError("StreamingLinearRegression: nothing fitted")
        return state.first().asDict()

    @property
    def rows(self) -> int:
        return int(self._total()["n"])

    def model(self) -> LinearModel:
        return LinearRegression().solve(normal_matrix(self._total(), len(self.features) + 2), self.features)


class StreamingFold(_Fitted):
    """Test, then train: each micro-batch is tried with the state before it, then learnt row by row, by key and in order.

    learner: any of the sequential learners (SGDRegressor, SGDClassifier, PassiveAggressive, OnlineKMeans). Every key has its own
    state, which goes on from batch to batch, so that the result is that of one fold over all batches; one key gives the plain
    sequential rule, which by nature is the work of one task. Rows are sorted outside Python and folded as they come: memory holds
    an Arrow batch and one state. Rows with a null key or a missing number are passed over.
    """

    def __init__(self, learner, features: Sequence[str], target: str | None, key: str, order: str, state: str | None = None):
        super().__init__(state)
        self.learner, self.features, self.target, self.key, self.order = learner, tuple(features), target, key, order

    def update(self, batch: DataFrame, batch_id: int) -> None:
        states, key, learner, width = self.states(batch.sparkSession), self.key, self.learner, len(self.features)
        xs = [f"x{i}" for i in range(width)]
        target = F.col(self.target) if self.target else F.lit(0.0)
        rows = batch.select(F.col(key).alias("k"), F.lit(1).alias("kind"), F.col(self.order).alias("o"), *[F.col(f).cast("double").alias(x) for f, x in zip(self.features, xs, strict=True)], target.cast("double").alias("y"))
        for c in (*xs, "y"):
            rows = rows.where(F.col(c).isNotNull() & ~F.isnan(c))
        rows = rows.where("k is not null").withColumns({"state": F.lit(None).cast("array<double>"), "seen": F.lit(0).cast("long")})
        old = states.read(before=batch_id)
        if old is not None:
            empty = {c: F.lit(None).cast(rows.schema[c].dataType) for c in ("o", *xs, "y")}
            rows = rows.unionByName(old.select("k", F.lit(0).alias("kind"), "state", "seen").withColumns(empty))
        rows = rows.repartition("k").sortWithinPartitions("k", "kind", "o").select("k", "kind", "state", "seen", *xs, "y")

        def run(batches):
            now, state, before, seen, tally = None, None, None, 0, [0, 0, 0.0]
            for part in batches:
                out = []
                for k, kind, packed, n, *values in part.itertuples(index=False, name=None):
                    if state is None or k != now:
                        if state is not None:
                            out.append((now, learner.pack(state), seen + tally[0], *tally))
                        now, seen, tally = k, int(n) if kind == 0 else 0, [0, 0, 0.0]
                        state = learner.unpack(packed, width) if kind == 0 else learner.init(width)
                        before = copy.deepcopy(state)
                        if kind == 0:
                            continue
                    x, y = values[:-1], values[-1]
                    if seen:
                        tally[1] += 1
                        tally[2] += learner.error(before, x, y)
                    learner.learn(state, x, y)
                    tally[0] += 1
                yield pd.DataFrame(out, columns=["k", "state", "seen", "n", "tested", "error"])
            if state is not None:
                yield pd.DataFrame([(now, learner.pack(state), seen + tally[0], *tally)], columns=["k", "state", "seen", "n", "tested", "error"])

        kind = rows.schema["k"].dataType.simpleString()
        states.write(mapped(rows, run, f"k {kind}, state array<double>, seen long, n long, tested long, error double"), batch_id)

    def result(self, spark: SparkSession) -> DataFrame:
        """k (the key), state (see the learner's unpack), seen (rows learnt); n, tested and error (a sum) of the last batch."""
        out = self.states(spark).read()
        if out is None:
            raise EmptyDataError("StreamingFold: nothing fitted")
        return out

    def predictor(self, spark: SparkSession, key: object) -> list:
        """The state of one key."""
        row = self.result(spark).where(F.col("k") == F.lit(key)).first()
        return self.learner.unpack(row["state"], len(self.features)) if row else self.learner.init(len(self.features))

    def test_then_train(self, stream: DataFrame, checkpoint: str) -> list[tuple[int, int, int, float | None]]:
        """Fit the stream; (batch, rows, rows tried, mean error of those) for each micro-batch of this run."""
        out: list[tuple[int, int, int, float | None]] = []
        learn = self.update

        def update(batch: DataFrame, batch_id: int) -> None:
            learn(batch, batch_id)
            n, tested, error = self.result(batch.sparkSession).agg(F.sum("n"), F.sum("tested"), F.sum("error")).first()
            out.append((batch_id, n or 0, tested or 0, error / tested if tested else None))

        self.update = update
        try:
            self.fit_stream(stream, checkpoint)
        finally:
            del self.update
        return out


def predict_stream(stream: DataFrame, model: LinearModel, to: str = "prediction") -> DataFrame:
    """A projection: no state."""
    return model.predict(stream, to)


def collect_stream(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append all that is available now to a Parquet folder."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def ddm_stream(stream: DataFrame, key: str, order: str, correct: str, detector: DDM | None = None) -> DataFrame:
    """key, n, warnings, drifts after each micro-batch that has rows of the key; keyed state across batches."""
    shipped(stream.sparkSession)
    d = detector or DDM()

    def update(keys, parts, state: GroupState):
        s = list(state.get) if state.exists else [0, 0, 9e99, 9e99, 0, 0]
        for pdf in parts:
            for ok in pdf.sort_values(order)[correct]:
                d.update(s, bool(ok))
                s[2], s[3] = min(s[2], 9e99), min(s[3], 9e99)
        state.update(tuple(s))
        yield pd.DataFrame([(*keys, s[0], s[4], s[5])], columns=[key, "n", "warnings", "drifts"])

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, n long, warnings long, drifts long", "n long, errors long, p double, s double, warnings long, drifts long", "update", GroupStateTimeout.NoTimeout)


def windowed(stream: DataFrame, time: str, every: str, late: str, **aggregates: Column) -> DataFrame:
    """Tumbling event-time windows; rows later than `late` are dropped, as state must end somewhere."""
    s = stream.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    return s.groupBy(F.window("__t", every).alias("w")).agg(*[c.alias(n) for n, c in aggregates.items()]).select(F.col("w.start").alias("start"), *aggregates)


def file_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A Parquet folder as a stream."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def staged(df: DataFrame, *stages: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Chained stages, for batch frames and streams alike."""
    for s in stages:
        df = df.transform(s)
    return df
