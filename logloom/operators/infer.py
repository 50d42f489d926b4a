"""Batched calls of a model that the caller supplies."""

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from logloom.operators.skew import hot_keys
from logloom.session import cut_lineage

# Batch size, attempts and first wait of the augmentation step.
BATCH_SIZE = 3
MAX_ATTEMPTS = 3
FIRST_WAIT = 1.0
TASK_ROWS = 100_000  # rows of one key in a task
PART = "_part"


def batch_infer(
    rows: DataFrame,
    prompt: str,
    make_model: Callable[[], Callable[[list[str]], list[str]]],
    batch_size: int = BATCH_SIZE,
    max_attempts: int = MAX_ATTEMPTS,
    first_wait: float = FIRST_WAIT,
    sleep: Callable[[float], None] = time.sleep,
    batch_key: str | None = None,
    accept: Callable[[str], bool] | None = None,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """Add ``response``, ``error`` and ``attempts`` to every row.

    A batch that still fails after ``max_attempts`` leaves its rows with an error; other
    batches go on. With ``batch_key`` a batch also ends where the key changes, which makes batches
    independent of partitioning; rows without a key form batches of their own. The rows of a key (or without one) that are more than ``task_rows``
    are dealt by their content to several tasks. A reply that ``accept`` refuses fails
    its attempt, like an error of the model. The model is made once per task, on the executor, and rows
    travel as Arrow batches, so ids and nulls stay as they are.
    """
    given = rows
    if batch_key is not None:
        rows = _dealt(rows, batch_key, task_rows)
    schema = T.StructType(
        [
            *given.schema.fields,
            T.StructField("response", T.StringType()),
            T.StructField("error", T.StringType()),
            T.StructField("attempts", T.IntegerType()),
        ]
    )

    names, n_given = [*given.columns, "response", "error", "attempts"], len(given.columns)

    def call(model, prompts: list[str]) -> tuple[list, str | None, int]:
        message = None
        for attempt in range(1, max_attempts + 1):
            try:
                found = list(model(prompts))
                if len(found) != len(prompts):
                    raise ValueError(f"{len(found)} replies for {len(prompts)} prompts")
                if accept is not None and not all(map(accept, found)):
                    raise ValueError("a reply is not as asked for")
                return pa.array(found, pa.string()).to_pylist(), None, attempt
            except Exception as error:
                message = str(error)
                if attempt < max_attempts:
                    sleep(first_wait * 2 ** (attempt - 1))
        return [None] * len(prompts), message, attempt

    def answered(model, table: pa.Table, cuts: list[tuple[int, int]]) -> pa.RecordBatch:
        """The rows of whole batches of the model as one Arrow batch."""
        whole = table.slice(0, cuts[-1][1]).combine_chunks()
        prompts = whole[prompt].to_pylist()
        replies, messages, attempts = [], [], []
        for start, end in cuts:
            found, message, attempt = call(model, prompts[start:end])
            replies += found
            messages += [message] * (end - start)
            attempts += [attempt] * (end - start)
        columns = [whole.column(i).chunk(0) for i in range(n_given)]
        added = [pa.array(replies, pa.string()), pa.array(messages, pa.string()), pa.array(attempts, pa.int32())]
        return pa.RecordBatch.from_arrays([*columns, *added], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make_model()
        rest = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table])
            cuts = _cuts(rest, batch_size, [] if batch_key is None else [batch_key, PART])
            # the last one may go on in the next batch
            if len(cuts) > 1:
                yield answered(model, rest, cuts[:-1])
            rest = rest.slice(cuts[-1][0])
        if rest is not None:
            yield answered(model, rest, [(0, rest.num_rows)])

    return rows.mapInArrow(run, schema)


def _dealt(rows: DataFrame, batch_key: str, task_rows: int) -> DataFrame:
    """Rows of one key side by side and in order, with the part of a large key that each belongs to."""
    rows = cut_lineage(rows)
    others = [c for c in rows.columns if c != batch_key]
    none = rows.withColumn(PART, F.lit(0))
    if rows.count() > task_rows:  # else no key can be large
        large = hot_keys(rows, [batch_key], task_rows).select(F.col(batch_key).alias("_large"), "_salts")
        sized = rows.join(large, F.col(batch_key).eqNullSafe(F.col("_large")), "left")
        none = sized.withColumn(PART, F.pmod(F.xxhash64(*others), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_large", "_salts")
    return none.repartition(batch_key, PART).sortWithinPartitions(batch_key, PART, *others)


def _cuts(table: pa.Table, size: int, keys: list[str]) -> list[tuple[int, int]]:
    """(start, end) of batches: a new one where a key changes, a null being a key of its own, or one is full."""
    values = list(zip(*(table[k].to_pylist() for k in keys))) if keys else [None] * table.num_rows
    starts = [0]
    for i in range(1, table.num_rows):
        if values[i] != values[i - 1] or i - starts[-1] == size:
            starts.append(i)
    return list(zip(starts, [*starts[1:], table.num_rows]))


def split_failed(inferred: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with a response, rows whose batch failed)."""
    return inferred.where("error IS NULL"), inferred.where(F.col("error").isNotNull())
