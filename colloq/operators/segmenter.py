"""Utterances from frames with a speech probability."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FRAME_MS = 32  # fixed value: 512 samples at 16 kHz
EVENTS = "session {kind}, seq int, kind string, utterance_id int, t0 double, t1 double, first_frame long, last_frame long"


@dataclass
class SegmenterOptions:
    threshold: float = 0.5
    silence_ms: int = 500
    least_ms: int = 300
    longest_s: float = 30.0
    preroll_ms: int = 300

    def frames(self) -> tuple[int, int, int, int]:
        """Silence that ends an utterance, least speech, longest utterance and preroll, in frames."""
        least = max(1, int(self.least_ms / FRAME_MS))
        return max(1, int(self.silence_ms / FRAME_MS)), least, max(least + 1, int(self.longest_s * 1000 / FRAME_MS)), max(0, int(self.preroll_ms / FRAME_MS))


@dataclass
class Segmenter:
    """The state machine of one session. Speech opens an utterance, with the preroll before it; enough silence, or the
    longest length, closes it; one with too little speech is cancelled."""

    options: SegmenterOptions = field(default_factory=SegmenterOptions)
    total: int = 0
    speaking: bool = False
    start: int = 0
    length: int = 0
    speech: int = 0
    quiet: int = 0
    preroll: int = 0
    next_id: int = 1

    STATE = ("total", "speaking", "start", "length", "speech", "quiet", "preroll", "next_id")

    def _event(self, kind: str, closing: bool) -> tuple[str, int, float, float | None, int, int]:
        at = lambda n: round(n * FRAME_MS / 1000, 2)
        return kind, self.next_id, at(self.start), at(self.total) if closing else None, self.start, self.total

    def feed(self, probabilities: list[float]) -> list[tuple[str, int, float, float | None, int, int]]:
        """Events of a batch of frames; a batch in which an open utterance grew ends with an update."""
        silence, least, longest, preroll = self.options.frames()
        out, grew = [], False
        for p in probabilities:
            speech = p is not None and p >= self.options.threshold
            self.total += 1
            if not self.speaking:
                if speech:
                    self.speaking, self.length, self.speech, self.quiet = True, self.preroll + 1, 1, 0
                    self.start = self.total - self.length
                    out.append(self._event("start", False))
                else:
                    self.preroll = min(self.preroll + 1, preroll)
                continue
            self.length, grew = self.length + 1, True
            self.speech, self.quiet = (self.speech + 1, 0) if speech else (self.speech, self.quiet + 1)
            if self.quiet >= silence or self.length >= longest:
                out.append(self._close())
                grew = False
        if grew and self.speaking:
            out.append(self._event("update", False))
        return out

    def _close(self) -> tuple[str, int, float, float | None, int, int]:
        event = self._event("cancel" if self.speech < self.options.frames()[1] else "end", True)
        self.speaking, self.length, self.speech, self.quiet, self.preroll = False, 0, 0, 0, 0
        self.next_id += 1
        return event

    def flush(self) -> list[tuple[str, int, float, float | None, int, int]]:
        return [self._close()] if self.speaking else []

    def state(self) -> tuple:
        return tuple(getattr(self, name) for name in self.STATE)

    def restore(self, state: tuple) -> Segmenter:
        for name, value in zip(self.STATE, state, strict=True):
            setattr(self, name, value)
        return self


def segment_frames(frames: DataFrame, options: SegmenterOptions | None = None, *, flush: bool = True) -> DataFrame:
    """Events of each session (``session``, ``frame_no``, ``probability``), in order of the frames.

    The rows arrive sorted and are streamed through the state machine, so a session is one task's work but never held
    whole. A null or NaN probability is silence. ``flush`` closes what is open at the end.
    """
    options = options or SegmenterOptions()
    kind = frames.schema["session"].dataType.simpleString()
    columns = ["session", "seq", "kind", "utterance_id", "t0", "t1", "first_frame", "last_frame"]

    def run(batches):
        now, machine, seq = None, Segmenter(options), 0

        def rows(events):
            nonlocal seq
            for e in events:
                seq += 1
                yield (now, seq, *e)

        for batch in batches:
            out = []
            for session, part in batch.groupby("session", sort=False):
                if session != now:
                    if now is not None and flush:
                        out.extend(rows(machine.flush()))
                    now, machine, seq = session, Segmenter(options), 0
                probs = [None if p is None or math.isnan(p) else p for p in part["probability"].tolist()]
                out.extend(rows(e for e in machine.feed(probs) if e[0] != "update"))
            yield pd.DataFrame(out, columns=columns)
        if now is not None and flush:
            yield pd.DataFrame(list(rows(machine.flush())), columns=columns)

    rows = frames.select("session", "frame_no", "probability").filter("session IS NOT NULL").repartition("session").sortWithinPartitions("session", "frame_no")
    return rows.mapInPandas(run, EVENTS.format(kind=kind))


def speech_islands(frames: DataFrame, threshold: float = 0.5, silence: int = 15, least: int = 9) -> DataFrame:
    """Utterances without preroll or longest length, as plain SQL: ``session``, ``utterance_id``, ``first_frame``,
    ``close_frame``, ``speech_frames``, ``kind``. Frames count from 1; a new one begins after ``silence`` frames without speech."""
    total = frames.groupBy("session").agg(F.max("frame_no").alias("total"))
    speech = frames.filter((F.col("probability") >= threshold) & ~F.isnan("probability"))
    w = W.partitionBy("session").orderBy("frame_no")
    rows = speech.withColumn("prev", F.lag("frame_no").over(w)).withColumn("u", F.sum(F.when(F.col("prev").isNull() | (F.col("frame_no") - F.col("prev") > silence), 1).otherwise(0)).over(w))
    out = rows.groupBy("session", F.col("u").alias("utterance_id")).agg(F.min("frame_no").alias("first_frame"), F.max("frame_no").alias("last"), F.count("*").alias("speech_frames")).join(total, "session")
    return out.select("session", "utterance_id", "first_frame", F.least(F.col("last") + silence, "total").alias("close_frame"), "speech_frames", F.when(F.col("speech_frames") < least, "cancel").otherwise("end").alias("kind"))


def chunk_spans(df: DataFrame, keys: list[str], length: str, size: int) -> DataFrame:
    """[``span_start``, ``span_end``) pieces of at most ``size`` of each row's length; a length of 0 or null has none."""
    n = F.col(length).cast("bigint")
    starts = F.sequence(F.lit(0).cast("bigint"), n - 1, F.lit(size).cast("bigint"))
    rows = df.filter(n > 0).select(*keys, n.alias("__n"), F.explode(starts).alias("span_start"))
    return rows.withColumn("span_end", F.least(F.col("span_start") + size, "__n")).drop("__n")
