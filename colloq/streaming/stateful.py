"""Keyed state for streams: interval maps, utterance segmentation, term graphs, live messages and session timeouts.

Each operator keeps per key what its batch form keeps while it folds, so a stream that has seen all rows ends where the
batch does. State is one JSON text per key.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from colloq.operators.graph import SNAPSHOT, GraphFold
from colloq.operators.intervals import IntervalMap
from colloq.operators.keywords import keyword_score, top
from colloq.operators.segmenter import Segmenter, SegmenterOptions

_TEXT = "value string"


def _kinds(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


def _load(state: GroupState) -> object | None:
    return json.loads(state.get[0]) if state.exists else None


def interval_stream(df: DataFrame, keys: list[str], start: str, end: str, identity: str, *, horizon: int | None = None) -> DataFrame:
    """After each trigger, the periods and gaps of the entities it touched: the keys, ``kind``, ``from_t``, ``to_t``,
    ``n``. The ordered map of each entity is its state, with the ids it has seen (an id counts once).

    With ``horizon`` the state is bounded: an interval that begins more than that before the latest one is late and left
    out, and periods that ended before leave the state (they came out when they last changed), as do the ids of their
    intervals; the last of them stays, as the next gap begins at it. Without, the state holds all ids.
    """

    def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = _load(state) or {"rows": [], "seen": [], "latest": None}
        m, seen, latest = IntervalMap(), {i: b for i, b in held["seen"]}, held["latest"]
        for a, b, n in held["rows"]:
            m.insert(a, b, n)
        for batch in batches:
            for i, a, b in zip(batch[identity], batch[start], batch[end], strict=True):
                if pd.isna(a) or pd.isna(b) or b < a or int(i) in seen or horizon is not None and latest is not None and a < latest - horizon:
                    continue
                seen[int(i)] = int(b)
                latest = int(a) if latest is None else max(latest, int(a))
                m.insert(int(a), int(b))
        rows = [(*key, "period", a, b, n) for a, b, n in m] + [(*key, "gap", a, b, 0) for a, b in m.gaps()]
        kept = list(m)
        if horizon is not None and latest is not None:
            old = sum(b < latest - horizon for _, b, _ in kept)
            kept = kept[max(0, old - 1) :]
            seen = {i: b for i, b in seen.items() if b >= latest - horizon}
        state.update((json.dumps({"rows": kept, "seen": sorted(seen.items()), "latest": latest}),))
        yield pd.DataFrame(rows, columns=[*keys, "kind", "from_t", "to_t", "n"])

    schema = f"{_kinds(df, keys)}, kind string, from_t long, to_t long, n long"
    return df.groupBy(*keys).applyInPandasWithState(update, schema, _TEXT, "update", GroupStateTimeout.NoTimeout)


def segmenter_stream(frames: DataFrame, options: SegmenterOptions | None = None, *, flush_after_ms: int | None = None) -> DataFrame:
    """Events of each session as its frames (``session``, ``frame_no``, ``probability``) arrive; a trigger in which an
    open utterance grew ends with an update. Frames that come behind those already taken are dropped. With
    ``flush_after_ms``, a session without frames for so long has its open utterance closed."""
    options = options or SegmenterOptions()
    columns = ["session", "kind", "utterance_id", "t0", "t1"]

    def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = _load(state)
        machine = Segmenter(options).restore(tuple(held["machine"])) if held else Segmenter(options)
        if state.hasTimedOut:
            events = machine.flush()
            state.update((json.dumps({"machine": machine.state(), "last": held["last"]}),))
            yield pd.DataFrame([(*key, *e[:4]) for e in events], columns=columns)
            return
        last = held["last"] if held else -math.inf
        rows = pd.concat(list(batches)).sort_values("frame_no")
        rows = rows[rows["frame_no"] > last]
        events = machine.feed([None if pd.isna(p) else p for p in rows["probability"]])
        last = int(rows["frame_no"].iloc[-1]) if len(rows) else last
        state.update((json.dumps({"machine": machine.state(), "last": last if last > -math.inf else -1}),))
        if flush_after_ms is not None and machine.speaking:
            state.setTimeoutDuration(flush_after_ms)
        yield pd.DataFrame([(*key, *e[:4]) for e in events], columns=columns)

    schema = f"{_kinds(frames, ['session'])}, kind string, utterance_id int, t0 double, t1 double"
    timeout = GroupStateTimeout.NoTimeout if flush_after_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return frames.groupBy("session").applyInPandasWithState(update, schema, _TEXT, "append", timeout)


def graph_stream(terms: DataFrame, **parameters) -> DataFrame:
    """A snapshot of each session's graph after every trigger that brought it terms (``session``, ``utt``, ``ord``,
    ``word``, ``score``). Utterances are folded in order. The last one of a trigger may go on in the next, so it is
    folded only when a later one comes; a snapshot shows it all the same. Terms of utterances already folded are late and
    left out."""

    def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = _load(state) or {"graph": None, "utt": None, "open": []}
        graph = GraphFold(**parameters)
        if held["graph"]:
            graph.restored(held["graph"])
        rows = pd.concat(list(batches))
        new = [(int(u), int(o), w, 1.0 if pd.isna(x) else float(x)) for u, o, w, x in zip(rows["utt"], rows["ord"], rows["word"], rows["score"], strict=True) if held["utt"] is None or u >= held["utt"]]
        waiting = sorted({(u, o, w): x for u, o, w, x in [*map(tuple, held["open"]), *new]}.items(), key=lambda r: r[0][:2] + (r[0][2] or "",))
        last = max((k[0] for k, _ in waiting), default=held["utt"])
        for utt, part in groupby(waiting, key=lambda r: r[0][0]):
            if utt != last:
                graph.add((k[2], x) for k, x in part)
        rest = [[*k, x] for k, x in waiting if k[0] == last]
        state.update((json.dumps({"graph": graph.state(), "utt": last, "open": rest}),))
        graph.add((w, x) for _, _, w, x in rest)
        seq, nodes, edges = graph.snapshot()
        yield pd.DataFrame([{"session": key[0], "seq": seq, "nodes": nodes, "edges": edges}])

    return terms.groupBy("session").applyInPandasWithState(update, SNAPSHOT, _TEXT, "update", GroupStateTimeout.NoTimeout)


def running_counts(words: DataFrame, keys: list[str]) -> DataFrame:
    """Counts per key and word so far, as a streaming aggregation; rank them in ``foreachBatch`` or on read."""
    return words.groupBy(*keys, "word").agg(F.count("*").alias("n"))


def ranked_keywords(counts: DataFrame, keys: list[str], most: int = 15) -> DataFrame:
    """The ``most`` best words of each key by score, then word, of running counts: for each batch of
    :func:`running_counts` in ``foreachBatch``."""
    scored = counts.withColumn("score", keyword_score(F.col("n"), F.col("word")))
    return top(scored, keys, [F.desc("score"), F.asc("word")], most)


@dataclass
class LiveTranscript:
    """Messages of one session: partial texts of open utterances, at most one per ``interval`` seconds, and final ones.

    Of a long utterance only what is past the frozen text is recognised again: once the open stretch is longer than
    ``window`` samples, the last partial text is frozen up to where it reached. An error of the engine becomes a message.
    """

    interval: float = 1.0
    window: int = 15 * 16_000
    frozen: dict[int, tuple[str, int]] = field(default_factory=dict)
    covered: dict[int, tuple[int, str]] = field(default_factory=dict)
    asked: dict[int, float] = field(default_factory=dict)
    closed: set[int] = field(default_factory=set)
    closed_upto: int = 0  # all utterances up to this one are closed, so that their numbers need not be kept

    def state(self) -> dict:
        """What :meth:`restored` goes on from; plain enough for JSON."""
        return {"frozen": list(self.frozen.items()), "covered": list(self.covered.items()), "asked": list(self.asked.items()), "closed": sorted(self.closed), "upto": self.closed_upto}

    def restored(self, held: dict) -> LiveTranscript:
        self.frozen, self.covered = ({k: tuple(v) for k, v in held[name]} for name in ("frozen", "covered"))
        self.asked, self.closed, self.closed_upto = dict(held["asked"]), set(held["closed"]), held["upto"]
        return self

    def _is_closed(self, utterance: int) -> bool:
        return utterance in self.closed or 0 < utterance <= self.closed_upto

    def _close(self, utterance: int) -> None:
        self.closed.add(utterance)
        while self.closed_upto + 1 in self.closed:
            self.closed_upto += 1
            self.closed.discard(self.closed_upto)

    def handle(self, kind: str, utterance: int, samples: int, t0: float, t1: float | None, now: float, engine: Callable[[str, int, int, int], str]) -> dict | None:
        """One event; ``engine(mode, utterance, from_sample, to_sample)`` gives a text. Returns a message or nothing."""
        try:
            if kind in ("start", "update"):
                return self._partial(utterance, samples, t0, now, engine)
            if kind in ("end", "cancel") and not self._is_closed(utterance):
                self._close(utterance)
                text = engine("final", utterance, 0, samples) if kind == "end" else ""
                for held in (self.frozen, self.covered, self.asked):
                    held.pop(utterance, None)
                return {"type": "final", "utterance_id": utterance, "text": text, "t0": t0, "t1": t1 if kind == "end" else t0}
        except Exception as error:  # one bad utterance must not end the stream
            return {"type": "error", "utterance_id": utterance, "text": str(error), "t0": t0, "t1": t1}
        return None

    def _partial(self, utterance: int, samples: int, t0: float, now: float, engine) -> dict | None:
        if self._is_closed(utterance) or now - self.asked.get(utterance, -math.inf) < self.interval:
            return None
        self.asked[utterance] = now
        text, upto = self.frozen.get(utterance, ("", 0))
        reached, said = self.covered.get(utterance, (0, ""))
        if samples - upto > self.window and reached > upto:
            text, upto = text + said, reached
            self.frozen[utterance] = (text, upto)
        if samples <= upto:
            return None
        part = engine("partial", utterance, upto, samples)
        self.covered[utterance] = (samples, part)
        return {"type": "partial", "utterance_id": utterance, "text": text + part, "t0": t0, "t1": None}


MESSAGE = "session {kind}, seq long, type string, utterance_id int, text string, t0 double, t1 double"


def transcript_stream(events: DataFrame, engine: Callable[[str, int, int, int], str] | Callable[[str, str, int, int, int], str], *, interval: float = 1.0, window: int = 15 * 16_000, with_session: bool = False) -> DataFrame:
    """Messages of each session as its events arrive: one :class:`LiveTranscript` a session, kept in keyed state.

    ``events``: ``session``, ``seq`` (their order), ``kind`` ('start', 'update', 'end', 'cancel', or 'stop' for the
    session), ``utterance_id``, ``samples`` so far, ``t0``, ``t1`` and ``at`` (seconds, by which partial texts are
    spaced). 'stop' gives a message of that type and ends the session: its open utterances are forgotten, and whatever
    comes for it later is dropped. An error of the engine becomes an 'error' message and the stream goes on. ``engine``
    runs in the tasks; with ``with_session`` it is given the session first.
    """
    columns = ["session", "seq", "type", "utterance_id", "text", "t0", "t1"]

    def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = _load(state) or {"live": None, "ended": False}
        live = LiveTranscript(interval, window)
        if held["live"]:
            live.restored(held["live"])
        ask = (lambda *a: engine(key[0], *a)) if with_session else engine
        out, ended = [], held["ended"]
        for e in pd.concat(list(batches)).sort_values("seq").itertuples(index=False):
            if ended:
                break
            if e.kind == "stop":
                ended, live = True, LiveTranscript(interval, window)
                out.append((key[0], int(e.seq), "stop", None, None, None, None))
                continue
            none = lambda x: None if x is None or pd.isna(x) else float(x)
            message = live.handle(e.kind, int(e.utterance_id), int(e.samples), none(e.t0), none(e.t1), float(e.at), ask)
            if message is not None:
                out.append((key[0], int(e.seq), message["type"], message["utterance_id"], message["text"], message["t0"], message["t1"]))
        state.update((json.dumps({"live": live.state(), "ended": ended}),))
        yield pd.DataFrame(out, columns=columns)

    kind = events.schema["session"].dataType.simpleString()
    return events.groupBy("session").applyInPandasWithState(update, MESSAGE.format(kind=kind), _TEXT, "append", GroupStateTimeout.NoTimeout)


def latest_messages(messages: DataFrame) -> DataFrame:
    """What to show of each utterance: its final message if there is one, else its last partial one (by ``seq``)."""
    rest = [c for c in messages.columns if c not in ("session", "utterance_id")]
    order = F.struct((F.col("type") == "final").alias("f"), F.col("seq").alias("s"))
    kept = messages.filter(F.col("type").isin("partial", "final"))
    return kept.groupBy("session", "utterance_id").agg(F.max_by(F.struct(*rest), order).alias("m")).select("session", "utterance_id", "m.*")


def disconnect_stream(events: DataFrame, after_ms: int = 60_000) -> DataFrame:
    """``session``, ``action``: 'finalize' once a session has had no connection for ``after_ms``. ``events``: ``session``,
    ``seq``, ``kind`` ('connect' or 'disconnect'); a new connection calls the finalizing off."""

    def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"session": [key[0]], "action": ["finalize"]})
            return
        clients = int(_load(state) or 0)
        for kind in pd.concat(list(batches)).sort_values("seq")["kind"]:
            clients = max(0, clients + (1 if kind == "connect" else -1))
        state.update((json.dumps(clients),))
        if not clients:
            state.setTimeoutDuration(after_ms)

    schema = f"{_kinds(events, ['session'])}, action string"
    return events.groupBy("session").applyInPandasWithState(update, schema, _TEXT, "append", GroupStateTimeout.ProcessingTimeTimeout)


def upsert(folder: str, keys: list[str], version: str, *, compact_every: int = 20) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that keeps the latest row of each key under ``folder``; read it with
    :func:`upserted`.

    Each batch is written as a part of its own, so it costs its own rows, and a batch run again replaces its part. Every
    ``compact_every`` batches the parts so far become one, and those that went into the one before are removed.
    """
    from colloq.operators.changelog import latest

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        latest(batch, keys, version).write.mode("overwrite").parquet(f"{folder}/part={number}")
        if number and number % compact_every == 0:
            upserted(spark, folder, keys, version).write.mode("overwrite").parquet(f"{folder}/whole={number}")
            _remove(spark, folder, before=number - compact_every)

    return apply


def _parts(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []
    return sorted((n.split("=")[0], int(n.split("=")[1])) for n in names if n.startswith(("part=", "whole=")) and files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS")))


def _remove(spark: SparkSession, folder: str, before: int) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for kind, n in _parts(spark, folder):
        if n < before or kind == "part" and n <= before:
            files.delete(path(f"{folder}/{kind}={n}"), True)


def upserted(spark: SparkSession, folder: str, keys: list[str], version: str) -> DataFrame:
    """The latest row of each key that :func:`upsert` has kept: of the newest whole and the parts after it."""
    from colloq.operators.changelog import latest

    parts = _parts(spark, folder)
    whole = max((n for kind, n in parts if kind == "whole"), default=-1)
    read = [f"{folder}/whole={whole}"] * (whole >= 0) + [f"{folder}/part={n}" for kind, n in parts if kind == "part" and n > whole]
    return latest(spark.read.parquet(*read), keys, version)
