"""JSON artifacts, transcript files and folders that are watched."""

from __future__ import annotations

import json
import os
import tempfile
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloq.functions.text import minute_stamp, path_stem

SCHEMA_VERSION = 1
ARTIFACTS = {
    "keywords": "version int, source string, generated_at string, keywords array<struct<word: string, score: double>>",
    "graph": "version int, source string, generated_at string, graph struct<seq: int, nodes: array<struct<id: string, weight: int, last_seen: int>>, edges: array<struct<a: string, b: string, weight: double>>>",
    "structure": "version int, kind string, source string, generated_at string, statements array<struct<id: string, utterance_index: int, speaker: string, text: string, terms: array<string>, topic_id: string>>, relations array<struct<id: string, source: string, target: string, type: string, confidence: double, evidence: map<string, string>>>, topics array<struct<id: string, label: string, summary: string, statement_ids: array<string>>>",
}
PAYLOAD = {"keywords": ("keywords",), "graph": ("graph",), "structure": ("statements", "relations")}


def parse_artifacts(raw: DataFrame, kind: str, value: str = "value") -> DataFrame:
    """Artifacts of one kind from JSON texts. Texts that are no object, of another version or kind, or without their
    payload give no row; other columns stay."""
    schema = ARTIFACTS[kind]
    rows = raw.withColumn("a", F.from_json(value, schema + ", _broken string", {"columnNameOfCorruptRecord": "_broken", "mode": "PERMISSIVE"}))
    ok = F.col("a._broken").isNull() & (F.col("a.version") == SCHEMA_VERSION)
    for field in PAYLOAD[kind]:
        ok = ok & F.col(f"a.{field}").isNotNull()
    if kind == "structure":
        ok = ok & (F.col("a.kind") == "logical_structure")
    return rows.filter(F.coalesce(ok, F.lit(False))).select(*[c for c in raw.columns if c != value], F.col("a").dropFields("_broken").alias(kind))


def load_artifacts(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """``stem`` and the payload of every valid ``*.{kind}.json`` in ``folder``."""
    raw = spark.read.option("wholetext", True).option("pathGlobFilter", f"*.{kind}.json").text(folder)
    raw = raw.select(F.regexp_extract(F.col("_metadata.file_name"), rf"^(.*)\.{kind}\.json$", 1).alias("stem"), "value")
    return parse_artifacts(raw, kind)


def envelope(source: Column, **payload: Column) -> Column:
    """One JSON text per row: version, source and the payload (without a time, which would make runs differ)."""
    return F.to_json(F.struct(F.lit(SCHEMA_VERSION).alias("version"), source.alias("source"), *[c.alias(n) for n, c in payload.items()]))


def fits_request(body: Column, most: int = 64 * 1024) -> Column:
    """Whether a request body is within the limit of edits; the bytes count, not the characters."""
    return F.octet_length(body) <= most


def write_transcripts(lines: DataFrame, folder: str) -> None:
    """A folder of lines for each recording, each written in order of time by one task; recordings without lines get none."""
    ordered = lines.repartition("file_id").sortWithinPartitions("file_id", "start_s")
    ordered.select("file_id", "line").write.partitionBy("file_id").mode("overwrite").text(folder)


def draft_lines(finals: DataFrame) -> DataFrame:
    """``[MM:SS] text`` of each final message that has text, with its ``session`` and ``t0``."""
    kept = finals.filter(F.length("text") > 0)
    t0 = F.coalesce("t0", F.lit(0.0))
    return kept.select("session", t0.alias("t0"), F.concat(minute_stamp(t0), F.lit(" "), F.col("text")).alias("line"))


def server_events(events: DataFrame) -> DataFrame:
    """``frame``: each change as a server-sent event. ``events``: ``event``, ``id`` (may be null), ``data`` (a JSON text)."""
    data = F.array_join(F.transform(F.split("data", "\n"), lambda x: F.concat(F.lit("data: "), x)), "\n")
    head = F.when(F.col("id").isNotNull(), F.concat(F.lit("\nid: "), F.col("id").cast("string"))).otherwise(F.lit(""))
    return events.select("id", F.concat(F.lit("event: "), F.col("event"), head, F.lit("\n"), data, F.lit("\n\n")).alias("frame"))


def tagged_lines(lines: DataFrame, prefix: str, schema: str, value: str = "value") -> DataFrame:
    """JSON objects of the lines that begin with ``prefix``; lines that don't, or hold no such object, are skipped."""
    rows = lines.filter(F.col(value).startswith(prefix)).select(F.from_json(F.substring(value, len(prefix) + 1, 2**31 - 1), schema + ", _broken string", {"columnNameOfCorruptRecord": "_broken"}).alias("o"))
    return rows.filter("o IS NOT NULL AND o._broken IS NULL").select(F.col("o").dropFields("_broken").alias("o")).select("o.*")


def watch_folder(spark: SparkSession, folder: str, extensions: tuple[str, ...] = ("mp3", "wav", "m4a"), *, done: str | None = None, files_per_trigger: int = 100) -> DataFrame:
    """A stream of the files that arrive in ``folder``: ``path``, ``stem``, ``length``, ``content``. With ``done``,
    processed files are moved there by the source (one trigger late). Extensions count in any case. Start it with a
    30-second trigger and :func:`process_files`."""
    either = lambda x: "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in x)
    names = "*.{" + ",".join(sorted({either(x) for x in extensions})) + "}"
    reader = spark.readStream.format("binaryFile").option("pathGlobFilter", names).option("maxFilesPerTrigger", files_per_trigger)
    if done:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", done)
    files = reader.schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    return files.select("path", path_stem(F.col("path")).alias("stem"), "length", "content")


def process_files(process: Callable[[dict], str], *, paused: Callable[[], bool] = lambda: False, on_discover: Callable[[list[str]], None] = lambda stems: None, done: Callable[[DataFrame], None] = lambda outcome: None, wait_s: float = 1.0) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function for :func:`watch_folder`: all files of a trigger are announced, then, while ``paused``
    says so, nothing is begun, then ``process`` is called on each (in the tasks, with path, stem and content). ``done`` is
    given ``path``, ``result`` and ``error``; a file whose processing fails is such a row, and the rest goes on."""

    def apply(batch: DataFrame, number: int) -> None:
        on_discover([r.stem for r in batch.select("stem").collect()])  # as many as a trigger may hold
        while paused():
            time.sleep(wait_s)

        def each(batches: Iterator) -> Iterator:
            import pandas as pd

            for part in batches:
                out = []
                for file in part.to_dict("records"):
                    try:
                        out.append((file["path"], process(file), None))
                    except Exception as error:  # one bad file must not end the others
                        out.append((file["path"], None, f"{type(error).__name__}: {error}"))
                yield pd.DataFrame(out, columns=["path", "result", "error"])

        done(batch.select("path", "stem", "content").mapInPandas(each, "path string, result string, error string"))

    return apply


def write_artifacts(rows: DataFrame, folder: str, kind: str) -> None:
    """Writes each row's ``value`` (a JSON text) to ``{stem}.{kind}.json`` in ``folder``, a folder all tasks share; each
    file is replaced at once, so a task run again leaves the same files."""
    if kind not in ARTIFACTS:
        raise ValueError(f"no artifact is called {kind}")

    def write(part: Iterator) -> None:
        for row in part:
            replace_file(f"{folder}/{row.stem}.{kind}.json", row.value)

    rows.select("stem", "value").foreachPartition(write)


@contextmanager
def _locked(path: str, wait_s: float = 10.0) -> Iterator[None]:
    """One writer of a document at a time, by a file that only one can create."""
    lock, end = f"{path}.lock", time.monotonic() + wait_s
    while True:
        try:
            os.close(os.open(lock, os.O_CREAT | os.O_EXCL))
            break
        except FileExistsError:
            if time.monotonic() > end:
                raise TimeoutError(f"{lock} is held") from None
            time.sleep(0.02)
    try:
        yield
    finally:
        os.unlink(lock)


def update_edits(path: str, expected: int, edits: dict, normal: Callable[[dict, dict], dict]) -> dict:
    """Replaces the ``edits`` of the artifact at ``path`` if their revision is still ``expected``; the rest stays.

    ``normal(edits, artifact)`` gives the normal form of edits or raises ValueError. The stored revision counts up by one;
    an edit made on another revision is refused with ValueError, and nothing is written."""
    from colloq.operators.overlay import next_revision

    if type(expected) is not int or expected < 0:
        raise ValueError("a revision is a whole number from 0")
    with _locked(path):
        artifact = json.loads(Path(path).read_text("utf-8"))
        stored = (artifact.get("edits") or {}).get("revision", 0)
        held = normal({**edits, "revision": next_revision(stored, expected)}, artifact)
        replace_file(path, json.dumps(artifact | {"edits": held}, ensure_ascii=False, indent=2))
    return held


def replace_file(path: str, text: str) -> None:
    """Replaces a small local document at once: readers see the old or the new text, never a part."""
    target = Path(path)
    handle, temporary = tempfile.mkstemp(prefix=f".{target.name}.", suffix=".tmp", dir=target.parent)
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as out:
            out.write(text)
            out.flush()
            os.fsync(out.fileno())
        os.replace(temporary, target)
    except BaseException:
        os.unlink(temporary)
        raise
