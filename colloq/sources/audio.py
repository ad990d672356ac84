"""PCM and WAV bytes as tables."""

from __future__ import annotations

import shutil
import struct
from collections.abc import Callable, Iterator
from itertools import islice
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLE_RATE = 16_000
FRAME_SAMPLES = 512  # fixed value: 32 ms
LAYOUT = "channels int, sample_rate int, sample_width int, data_offset long, data_bytes long, seconds double"


def decode_pcm(data: bytes) -> np.ndarray:
    """Mono 16-bit little-endian bytes to floats in -1..1; an odd last byte is dropped."""
    return np.frombuffer(data[: len(data) - len(data) % 2], dtype="<i2").astype(np.float32) / 32768.0


def energy_probability(frame: np.ndarray, threshold: float = 0.01) -> float:
    """The built-in speech probability: 1 where the frame's mean magnitude reaches ``threshold``."""
    return float(np.abs(frame).mean() >= threshold) if len(frame) else 0.0


def frames(chunks: DataFrame, probability: Callable[[np.ndarray], float] = energy_probability) -> DataFrame:
    """Frames of 512 samples of each session's chunks (``session``, ``chunk_no``, ``data``): ``session``, ``frame_no``
    (from 1), ``probability``. What is left of a chunk goes to the next one; a last incomplete frame is dropped.
    A chunk with an odd number of bytes loses its last one."""
    kind = chunks.schema["session"].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, rest, n = None, np.empty(0, np.float32), 0
        for batch in batches:
            out = []
            for session, data in zip(batch["session"], batch["data"], strict=True):
                if session != now:
                    now, rest, n = session, np.empty(0, np.float32), 0
                rest = np.concatenate([rest, decode_pcm(data or b"")])
                whole = len(rest) // FRAME_SAMPLES
                for frame in rest[: whole * FRAME_SAMPLES].reshape(whole, FRAME_SAMPLES):
                    n += 1
                    out.append((session, n, probability(frame)))
                rest = rest[whole * FRAME_SAMPLES :]
            yield pd.DataFrame(out, columns=["session", "frame_no", "probability"])

    rows = chunks.select("session", "chunk_no", "data").repartition("session").sortWithinPartitions("session", "chunk_no")
    return rows.mapInPandas(cut, f"session {kind}, frame_no long, probability double")


def resample(samples: np.ndarray, rate: int, position: float = 0.0, previous: float = 0.0, to: int = SAMPLE_RATE) -> tuple[np.ndarray, float, float]:
    """Linear resampling of one chunk; (samples, position, last sample), the latter two to be given with the next chunk."""
    step = rate / to
    line = np.concatenate([[previous], samples])
    at = np.arange(position, len(samples), step)
    out = np.interp(at, np.arange(len(line)), line) if len(samples) else np.empty(0)
    following = (at[-1] + step if len(at) else position) - len(samples)
    return out.astype(np.float32), float(following), float(samples[-1]) if len(samples) else previous


def quantize(samples: np.ndarray, *, full_negative: bool = False) -> bytes:
    """16-bit little-endian bytes of samples cut to -1..1. With ``full_negative``, as browsers do, -1 is -32768, else
    -32767."""
    clipped = np.clip(samples, -1.0, 1.0)
    return np.trunc(clipped * np.where(full_negative & (clipped < 0), 32768, 32767)).astype("<i2").tobytes()


class Downsampler:
    """The browser's way from chunks of channels to 16 kHz bytes: no sample before the first, each output between two
    inputs, what is left over kept for the next chunk, full negative scale."""

    def __init__(self, rate: int, to: int = SAMPLE_RATE) -> None:
        self.step, self.at, self.rest = rate / to, 0.0, np.empty(0, np.float64)

    def feed(self, interleaved: np.ndarray, channels: int = 1) -> bytes:
        line = np.concatenate([self.rest, downmix(np.asarray(interleaved, np.float64), channels)])
        many = max(0, int(np.ceil((len(line) - 1 - self.at) / self.step)))
        where = self.at + self.step * np.arange(many)
        after = self.at + self.step * many
        used = min(int(after), len(line))
        out = np.interp(where, np.arange(len(line)), line) if many else np.empty(0)
        self.rest, self.at = line[used:], after - used
        return quantize(out, full_negative=True)


def downmix(interleaved: np.ndarray, channels: int) -> np.ndarray:
    whole = len(interleaved) // channels
    return interleaved[: whole * channels].reshape(whole, channels).mean(axis=1)


def wav_layout(data: bytes) -> tuple[int, int, int, int, int, float] | None:
    """Where the samples of a RIFF/WAVE file are, whatever its size fields say: (channels, rate, width, offset of the
    samples, bytes of whole frames there are, seconds). Null for anything else. At most 64 chunks are looked at."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return None
    form = None
    for name, body, size in islice(_chunks(data), 64):
        if name == b"data":
            if form is None or not all(form):
                return None
            channels, rate, width = form
            there = (len(data) - body) // (channels * width) * (channels * width)
            return channels, rate, width, body, there, there / (rate * channels * width)
        if name == b"fmt ":
            if body + 16 > len(data):
                return None
            channels, rate, bits = (*struct.unpack_from("<HI", data, body + 2), *struct.unpack_from("<H", data, body + 14))
            form = channels, rate, bits // 8
    return None


def _chunks(data: bytes) -> Iterator[tuple[bytes, int, int]]:
    """(name, where its body begins, size as stated) of the chunks after the header; bodies are padded to even sizes."""
    at = 12
    while at + 8 <= len(data):
        name, size = struct.unpack_from("<4sI", data, at)
        yield name, at + 8, size
        at += 8 + size + size % 2


def recoverable_recordings(spark: SparkSession, folder: str, least_seconds: float = 1.0) -> DataFrame:
    """Unfinished recordings (``*.wav.part``) under ``folder`` that hold at least ``least_seconds``: ``path`` and the layout."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav.part").load(folder)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, *found) for p, c in zip(batch["path"], batch["content"], strict=True) if (found := wav_layout(bytes(c)))]
            yield pd.DataFrame(rows, columns=["path", "channels", "sample_rate", "sample_width", "data_offset", "data_bytes", "seconds"])

    return files.select("path", "content").mapInPandas(read, f"path string, {LAYOUT}").filter(F.col("seconds") >= least_seconds)


def repaired(data: bytes) -> bytes | None:
    """The file with true sizes in its header and no partial frame at its end."""
    found = wav_layout(data)
    if found is None:
        return None
    _, _, _, offset, there, _ = found
    return data[:4] + struct.pack("<I", offset + there - 8) + data[8 : offset - 4] + struct.pack("<I", there) + data[offset : offset + there]


def sample_count(data: Column) -> Column:
    """How many 16-bit samples bytes hold."""
    return F.floor(F.octet_length(data) / 2)


def elapsed_seconds(samples: Column, rate: int = SAMPLE_RATE) -> Column:
    """How long so many samples last, to a tenth of a second."""
    return F.bround(samples / F.lit(float(rate)), 1)


def recover_recordings(spark: SparkSession, folder: str, target: str, *, least_seconds: float = 1.0, prefix: str = "recovered_") -> list[str]:
    """Repairs unfinished recordings (``*.wav.part``) of ``folder`` and moves them to ``target`` under a name of their
    own, then moves finished ones that were left behind (``live_*.wav``); those too short or of no form are removed or,
    if finished, left. Returns the new paths. The layouts are found by Spark; the moves, a file each, are the driver's."""
    Path(target).mkdir(parents=True, exist_ok=True)
    worth = {Path(r.path.removeprefix("file:")).name for r in recoverable_recordings(spark, folder, least_seconds).select("path").collect()}
    moved = []
    for part in sorted(Path(folder).glob("*.wav.part")):
        if part.name not in worth:
            part.unlink()
            continue
        part.write_bytes(repaired(part.read_bytes()))
        moved.append(_moved(part, Path(target), prefix + part.name.removesuffix(".part")))
    moved += [_moved(whole, Path(target), prefix + whole.name) for whole in sorted(Path(folder).glob("live_*.wav"))]
    return moved


def _moved(path: Path, folder: Path, name: str) -> str:
    stem, suffix = name.rsplit(".", 1)
    n, free = 2, name
    while (folder / free).exists():
        n, free = n + 1, f"{stem}_{n}.{suffix}"
    return str(shutil.move(path, folder / free))
