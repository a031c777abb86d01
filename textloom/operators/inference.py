"""Running a caller's function from text to text over a column of prompts.

Calls may cost money, so results are written to the shared folder before
anything reads them: however often they are used, each prompt is called for
once.  Spark may still run a task again after an executor is lost; leave
speculation off.  With a journal, answers are also put down while a task goes
on, so that a repeated task, or a job started again after it failed, makes only
the calls that had not been answered.
"""

import threading
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import partial

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from textloom import fixed
from textloom.operators import breaker
from textloom.session import written

Factory = Callable[[str | None], Callable[[str], str]]

_ADDED = [
    (StructField("result", StringType()), pa.field("result", pa.string())),
    (StructField("call_error", StringType()), pa.field("call_error", pa.string())),
    (StructField("error_type", StringType()), pa.field("error_type", pa.string())),
    (StructField("attempts", IntegerType()), pa.field("attempts", pa.int32())),
    (StructField("elapsed_ms", LongType()), pa.field("elapsed_ms", pa.int64())),
]


OTHER, API, REJECTED = "other", "api", "rejected"
_ANSWER = pa.schema([("_call", pa.string()), *[field for _, field in _ADDED]])


class Journal:
    """Answers of one task's calls, in files of its own below ``folder``, which all executors share.

    A file is complete or not there: it gets its name once it is written.
    """

    def __init__(self, folder: str, job: str):
        self.files, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        context = TaskContext.get()
        self.own = f"{root}/{job}/part-{context.partitionId() if context else 0}"

    def answers(self) -> dict[str, tuple]:
        """What an earlier attempt of this task was answered, by call."""
        place = fs.FileSelector(self.own, allow_not_found=True)
        known: dict[str, tuple] = {}
        for file in self.files.get_file_info(place):
            if file.path.endswith(".parquet"):
                with self.files.open_input_file(file.path) as source:
                    rows = pq.read_table(source).to_pylist()
                known |= {r["_call"]: tuple(r[field.name] for _, field in _ADDED) for r in rows}
        return known

    def put_down(self, answers: list[tuple]) -> None:
        self.files.create_dir(self.own, recursive=True)
        name = uuid.uuid4().hex
        table = pa.table(dict(zip(_ANSWER.names, zip(*answers))), schema=_ANSWER)
        with self.files.open_output_stream(f"{self.own}/.{name}") as out:
            pq.write_table(table, out)
        self.files.move(f"{self.own}/.{name}", f"{self.own}/{name}.parquet")


def journalled(df: DataFrame, journal: str) -> DataFrame:
    """``df`` with ``_known``, what earlier jobs with this journal were answered to a row's ``_call``."""
    spark = df.sparkSession
    schema = StructType([StructField("_call", StringType())] + [f for f, _ in _ADDED])
    spark.createDataFrame([], schema).write.mode("append").parquet(f"{journal}/none")
    seen = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(journal)
    answer = F.struct(*[f.name for f, _ in _ADDED])
    first = seen.groupBy("_call").agg(F.min(answer).alias("_known"))
    return df.join(first, "_call", "left")


class CallFailure(Exception):
    """An error whose type the caller's function knows: processing, model_init, api or quota.

    Any exception with an ``error_type`` attribute will do.
    """

    def __init__(self, message: str, error_type: str = API):
        super().__init__(message)
        self.error_type = error_type


def _attempt(run: Callable[[str], str], prompt: str, attempts: int, pause: float):
    """(result, error, its type, attempts used); the error of the last attempt counts."""
    for used in range(1, attempts + 1):
        try:
            result = run(prompt)
            if not isinstance(result, str):
                raise TypeError(f"the model answered with {type(result).__name__}, not text")
            return result, None, None, used
        except Exception as error:  # a row's failure is data, never the end of the job
            if used == attempts:
                return None, str(error), str(getattr(error, "error_type", OTHER)), used
            time.sleep(pause)


def _call_batches(
    batches: Iterator[pa.RecordBatch],
    factory: Factory,
    prompt: str,
    model: str | None,
    attempts: int,
    pause: float,
    guard: tuple[int, int] | None,
    concurrency: int,
    batch_rows: int,
    journal: tuple[str, str] | None = None,
) -> Iterator[pa.RecordBatch]:
    built: dict = {}
    held: dict = {}
    lock = threading.Lock()
    notes = Journal(*journal) if journal else None
    known = notes.answers() if notes else {}

    def model_of(name: str | None):
        with lock:
            if name not in built:
                try:
                    built[name] = (factory(name), None)
                except Exception as error:
                    message = fixed.MSG_INIT_FAILED.format(key=name, error=error)
                    built[name] = (None, message)
            return built[name]

    def run_one(name: str | None, text: str | None):
        if text is None:
            return None, None, None, 0, 0
        run, broken = model_of(name)
        if broken:
            return None, broken, OTHER, 0, 0
        started = time.time()
        at = int(started * 1e6)
        if guard:
            with lock:
                state = breaker.admit(held.get(name, breaker.START), at, guard[1])
                held[name] = state
            if state[0] == breaker.OPEN:
                return None, fixed.MSG_BREAKER_OPEN.format(key=name), REJECTED, 0, 0
        result, error, kind, used = _attempt(run, text, attempts, pause)
        if guard:
            with lock:
                held[name] = breaker.settle(held[name], at, error is not None, guard[0])
        return result, error, kind, used, int((time.time() - started) * 1000)

    with ThreadPoolExecutor(concurrency) as pool:
        each = pool.map if concurrency > 1 else map
        for whole in batches:
            for start in range(0, whole.num_rows, batch_rows):
                batch = whole.slice(start, batch_rows)
                texts = batch.column(prompt).to_pylist()
                names = batch.column(model).to_pylist() if model else [None] * len(texts)
                if notes is None:
                    rows = list(each(run_one, names, texts))
                else:
                    calls = batch.column("_call").to_pylist()
                    earlier = batch.column("_known").to_pylist()
                    rows = [
                        known.get(c) or (tuple(e[f.name] for _, f in _ADDED) if e else None)
                        for c, e in zip(calls, earlier)
                    ]
                    open_ = [k for k, row in enumerate(rows) if row is None]
                    made = list(each(run_one, [names[k] for k in open_], [texts[k] for k in open_]))
                    for k, row in zip(open_, made):
                        rows[k] = row
                    # Failures are tried again by whoever comes back.
                    answered = [(calls[k], *row) for k, row in zip(open_, made) if row[0] is not None]
                    if answered:
                        notes.put_down(answered)
                    batch = batch.drop_columns(["_call", "_known"])
                for (_, field), values in zip(_ADDED, zip(*rows)):
                    batch = batch.append_column(field, pa.array(values, type=field.type))
                yield batch


def run_callable(
    df: DataFrame,
    factory: Factory,
    prompt: str = "prompt",
    model: str | None = None,
    attempts: int = 1,
    pause: float = fixed.RETRY_PAUSE_SECONDS,
    guard: bool = False,
    threshold: int = fixed.FAILURE_THRESHOLD,
    recovery_seconds: float = fixed.RECOVERY_SECONDS,
    partitions: int | None = None,
    concurrency: int = 1,
    batch_rows: int = 64,
    once: bool = True,
    journal: str | None = None,
    key: Sequence[str] = (),
) -> DataFrame:
    """Add result, call_error, error_type, attempts and elapsed_ms to each row.

    ``factory(model)`` builds the function once per task and model; rows with
    a null prompt are passed on without a call.  An answer that is no text is
    an error, too.  ``partitions`` bounds how many tasks call at once and spreads
    the rows evenly; each has up to ``concurrency`` calls under way, for
    functions that may be called from several threads.  With ``guard`` each
    task keeps a breaker per model; its state is not shared between tasks.
    error_type is what the exception says it is, "other" for one that says
    nothing, "rejected" for calls that the breaker did not let through.

    The calls are made now and their results written to the shared folder;
    with ``once=False`` they are made whenever the result is computed.

    With ``journal``, a folder that all executors share, answers are put down after
    each ``batch_rows`` calls, and a task or a job that comes back with the same
    folder takes them from there instead of calling again.  A call is known by the
    row's ``key`` columns, model and prompt; rows alike in all of these may share an
    answer.  Errors are not answers: such calls are made again.
    """
    columns = df.columns
    if journal:
        call = F.to_json(F.struct(*key, *([model] if model else []), prompt), {"ignoreNullFields": "false"})
        df = journalled(df.withColumn("_call", F.sha2(call, 256)), journal).select(*columns, "_call", "_known")
    if partitions:
        df = df.repartition(partitions)
    fields = [f for f in df.schema.fields if f.name in columns]
    schema = StructType(fields + [spark_field for spark_field, _ in _ADDED])
    work = partial(
        _call_batches,
        factory=factory,
        prompt=prompt,
        model=model,
        attempts=attempts,
        pause=pause,
        guard=(threshold, round(recovery_seconds * 1_000_000)) if guard else None,
        concurrency=concurrency,
        batch_rows=batch_rows,
        journal=(journal, uuid.uuid4().hex) if journal else None,
    )
    called = df.mapInArrow(work, schema)
    return written(called, "calls") if once else called
