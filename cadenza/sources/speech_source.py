"""Speech recognisers as a Python data source: spark.read.format("cadenza_speech") gives transcripts, a file of the media
list a partition.

A recogniser is a class with `name`, `automatic`, is_available() and transcribe(); register() hands the source the ones
built in and any others. The name "auto" means the first automatic one that is available, in order of registration: the
stub, which makes words up, is never chosen so. The recognisers themselves aren't part of the library: `recorded` reads
what one has written beside the audio file, as JSON."""

from __future__ import annotations

import json
import wave
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import opened

NAME = "cadenza_speech"
#: Words of a batch, and rows of the media list read at a time: Spark's own batches go by rows, however long these are.
BATCH_WORDS, LIST_ROWS = 20_000, 1_024
SCHEMA = "transcript_id string, language string, backend string, model string, duration double, segments array<struct<start:double,end:double,text:string,words:array<struct<text:string,start:double,end:double,probability:double>>>>"

_WORD = pa.struct([("text", pa.string()), ("start", pa.float64()), ("end", pa.float64()), ("probability", pa.float64())])
_SEGMENT = pa.struct([("start", pa.float64()), ("end", pa.float64()), ("text", pa.string()), ("words", pa.list_(_WORD))])
ARROW = pa.schema([*[(c, pa.string()) for c in ("transcript_id", "language", "backend", "model")], ("duration", pa.float64()), ("segments", pa.list_(_SEGMENT))])


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), ARROW.types, strict=True)], schema=ARROW)


class Recorded:
    """Results of a recogniser that lie beside the audio file, with .json behind its name."""

    name, automatic, default_model = "recorded", True, "unknown"

    def is_available(self) -> tuple[bool, str]:
        return True, ""

    def transcribe(self, path: str | None, duration_ms: int | None, model: str, language: str | None, offset: float) -> dict:
        if not path:
            raise ValueError("a recorded transcript needs the path of its audio file")
        system, inner = opened(path + ".json")
        with system.open_input_stream(inner) as stream:
            read = json.loads(stream.read())
        segments = []
        for s in read.get("segments") or []:
            timed = [w for w in s.get("words") or [] if w.get("start") is not None and w.get("end") is not None]
            words = [(w.get("word", w.get("text")), w["start"] + offset, w["end"] + offset, w.get("probability")) for w in timed]
            segments.append((s["start"] + offset, s["end"] + offset, (s.get("text") or "").strip(), words))
        return {"language": read.get("language") or language or "unknown", "duration": segments[-1][1] - offset if segments else 0.0, "segments": segments}


class Stub:
    """Made-up words at an even pace, for tests and dry runs: each fills most of its step, segments last five seconds."""

    name, automatic, default_model = "stub", False, "stub"
    step_ms, segment_ms, fill, probability, unknown_ms = 400, 5_000, 0.8, 0.9, 10_000

    def is_available(self) -> tuple[bool, str]:
        return True, ""

    def transcribe(self, path: str | None, duration_ms: int | None, model: str, language: str | None, offset: float) -> dict:
        if duration_ms is None:
            duration_ms = self._length(path)
        at = lambda ms: round(ms / 1000 + offset, 3)
        segments, n = [], 0
        for start in range(0, duration_ms, self.segment_ms):
            end, words = min(start + self.segment_ms, duration_ms), []
            for t in range(start, end, self.step_ms):
                words.append((f"word{n}", at(t), at(min(t + int(self.step_ms * self.fill), end)), self.probability))
                n += 1
            segments.append((at(start), at(end), " ".join(w[0] for w in words), words))
        return {"language": language or "en", "duration": duration_ms / 1000, "segments": segments}

    def _length(self, path: str | None) -> int:
        """The length of a wave file, ten seconds where there is none."""
        try:
            system, inner = opened(path)
            with system.open_input_file(inner) as handle, wave.open(handle, "rb") as wav:
                return round(wav.getnframes() * 1000 / wav.getframerate())
        except Exception:
            return self.unknown_ms


BACKENDS = {c.name: c for c in (Recorded, Stub)}


def chosen(name: str | None, backends: dict[str, type]):
    """The recogniser of a name, or for none or "auto" the first automatic one that is available."""
    if name and name != "auto":
        if name not in backends:
            raise ValueError(f"unknown speech backend {name!r}: {', '.join(backends)}")
        return backends[name]()
    reasons = []
    for c in backends.values():
        if c.automatic:
            found, why = c().is_available()
            if found:
                return c()
            reasons.append(f"{c.name}: {why}")
    raise RuntimeError("no speech backend is available: " + "; ".join(reasons))


class MediaFile(InputPartition):
    """Row groups of one file of the media list."""


class SpeechReader(DataSourceReader):
    def __init__(self, options: dict, backends: dict[str, type]):
        self.options, self.backends = options, backends
        if "path" not in options:
            raise ValueError('a media list is needed: .load(path) of a Parquet table (transcript_id, path, duration_ms)')
        chosen(options.get("backend"), backends)

    def partitions(self) -> list[InputPartition]:
        """One for each row group of the list: names and numbers of its files, not their rows."""
        system, root = opened(self.options["path"])
        info = system.get_file_info(fs.FileSelector(root, recursive=True)) if system.get_file_info(root).type == fs.FileType.Directory else [system.get_file_info(root)]
        files = sorted(f.path for f in info if f.is_file and f.path.endswith(".parquet"))
        groups = [(f, g) for f in files for g in range(pq.ParquetFile(f, filesystem=system).num_row_groups)]
        return [MediaFile(g) for g in groups] or [MediaFile(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        system, _ = opened(self.options["path"])
        backend = chosen(self.options.get("backend"), self.backends)
        model, language, offset = self.options.get("model") or backend.default_model, self.options.get("language"), float(self.options.get("offset", 0.0))
        file, group = partition.value
        rows, held = [], 0
        for batch in pq.ParquetFile(file, filesystem=system).iter_batches(batch_size=LIST_ROWS, row_groups=[group]):
            for row in batch.to_pylist():
                t = backend.transcribe(row.get("path"), row.get("duration_ms"), model, language, offset)
                rows.append((str(row["transcript_id"]), t["language"], backend.name, model, float(t["duration"]), t["segments"]))
                held += 1 + sum(len(s[3]) for s in t["segments"])
                if held >= BATCH_WORDS:
                    yield batch_of(rows)
                    rows, held = [], 0
        if rows:
            yield batch_of(rows)


class SpeechSource(DataSource):
    backends = BACKENDS

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return SpeechReader(dict(self.options), self.backends)


def register(spark: SparkSession, more: tuple[type, ...] = ()) -> None:
    """Makes the source known to a session, with more recognisers before those built in."""
    known = {c.name: c for c in more} | BACKENDS
    spark.dataSource.register(type("SpeechSource", (SpeechSource,), {"backends": known}))
