"""WAV files as tables of samples, in blocks, so that a day-long recording never is one value."""

from __future__ import annotations

import io
import os
import uuid
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Samples that a task hands on at once, at least; short files share a frame.
AT_ONCE = 1 << 20
SIGNAL = "recording_filename string, channel int, rate int, start_sample bigint, samples array<float>"


def decode(raw: bytes, width: int, channels: int) -> np.ndarray:
    """Samples from -1 to 1, a column for each channel, of little-endian PCM of 1 to 4 bytes."""
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / float(1 << 23)
    else:
        x = np.frombuffer(raw, {2: "<i2", 4: "<i4"}[width]).astype(np.float64) / float(1 << (8 * width - 1))
    return x.reshape(-1, channels)


def encode(x: np.ndarray, rate: int) -> bytes:
    """A 16-bit WAV file of samples from -1 to 1, a column for each channel."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(x.shape[1])
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.clip(np.rint(x * 32767), -32768, 32767).astype("<i2").tobytes())
    return out.getvalue()


def _frame(rows: list[tuple]) -> pd.DataFrame:
    name, channel, rate, start, samples = zip(*rows)
    return pd.DataFrame({"recording_filename": name, "channel": np.array(channel, np.int32), "rate": np.array(rate, np.int32), "start_sample": np.array(start, np.int64), "samples": samples})


def read_wav(spark: SparkSession, path: str | list[str], block_ms: int = 60_000) -> DataFrame:
    """A row for each channel and block of each file. Files that can't be read have no rows. A file is held whole by its task, so none may exceed 2 GB."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, held = [], 0
        for batch in batches:
            for name, content in zip(batch["name"], batch["content"]):
                try:
                    with wave.open(io.BytesIO(content)) as w:
                        rate, width, channels = w.getframerate(), w.getsampwidth(), w.getnchannels()
                        size = max(1, rate * block_ms // 1000)
                        for start in range(0, w.getnframes(), size):
                            w.setpos(start)
                            x = decode(w.readframes(size), width, channels).astype(np.float32)
                            rows += [(name, c, rate, start, x[:, c]) for c in range(channels)]
                            held += x.size
                            if held >= AT_ONCE:
                                yield _frame(rows)
                                rows, held = [], 0
                except (wave.Error, EOFError):
                    continue
        if rows:
            yield _frame(rows)

    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    return files.mapInPandas(task, SIGNAL)


def durations(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """recording_filename and duration in ms, 0 for files that can't be read."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ms = []
            for content in batch["content"]:
                try:
                    with wave.open(io.BytesIO(content)) as w:
                        ms.append(w.getnframes() * 1000 // w.getframerate())
                except (wave.Error, EOFError):
                    ms.append(0)
            yield pd.DataFrame({"recording_filename": batch["name"], "duration": pd.array(ms, "int64")})

    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    return files.mapInPandas(task, "recording_filename string, duration bigint")


def write_wav(signal: DataFrame, folder: str) -> DataFrame:
    """Write each recording of ``signal`` as a file below ``folder``, which all workers mount; gives the paths and sizes.

    Names may have folders. A task reads its blocks sorted by recording and holds those of one recording at a time.
    """

    def write(name: str, rate: int, channels: list[list[np.ndarray]]) -> tuple[str, int]:
        content = encode(np.column_stack([np.concatenate(blocks) for blocks in channels]).astype(np.float64), rate)
        final = os.path.join(folder, name)
        os.makedirs(os.path.dirname(final), exist_ok=True)
        # a task may run twice: the file appears whole or not at all
        part = os.path.join(os.path.dirname(final), f"_{uuid.uuid4().hex}")
        with open(part, "wb") as f:
            f.write(content)
        os.replace(part, final)
        return final, len(content)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nothing = recording = last = object()
        rate, channels, done = 0, [], []
        for batch in batches:
            for name, channel, hz, samples in zip(batch["recording_filename"], batch["channel"], batch["rate"], batch["samples"]):
                if name != recording:
                    if recording is not nothing:
                        done.append(write(str(recording), rate, channels))
                    recording, last, rate, channels = name, nothing, int(hz), []
                if channel != last:
                    last = channel
                    channels.append([])
                channels[-1].append(samples)
            if done:
                yield pd.DataFrame(done, columns=["path", "bytes"])
                done = []
        if recording is not nothing:
            yield pd.DataFrame([write(str(recording), rate, channels)], columns=["path", "bytes"])

    blocks = signal.select("recording_filename", "channel", "start_sample", "rate", "samples")
    return blocks.repartition("recording_filename").sortWithinPartitions("recording_filename", "channel", "start_sample").mapInPandas(task, "path string, bytes bigint")
