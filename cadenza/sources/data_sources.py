"""MIDI and WAV files as Spark data sources, read in partitions and written with a commit of the job.

    register(spark)
    spark.read.format("midi").load(path)                  # events; .schema("song string, kind string") decodes to these columns alone
    events.write.format("midi").mode("append").save(path)  # rows of a song together
    spark.read.format("wav").option("frames", 4096).load(path)

Files are written below ``_temporary/<job>`` in the target folder and moved to their
names when all tasks have ended, so a failed job leaves nothing and a task that runs again
replaces its own files. A MIDI file is read by one task, small files together; a WAV file is cut into
ranges of bytes, and a task reads the chunks that begin in its range, so chunks are the same whatever the ranges.

Paths are local (a folder that all executors share) or of a file system that pyarrow opens; ``read_midi`` and
``read_wav`` read from any store that Spark reads.
"""

from __future__ import annotations

import re
import struct
import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

#: Bytes of files, or of a range of one, that a task reads.
TASK_BYTES = 32 << 20
PCM_FIELDS = "song string, voice string, chunk bigint, frame0 bigint, n_channels int, rate int, samples array<smallint>"


def register(spark: SparkSession) -> None:
    """Make the formats known to the session, and let it hand filters to readers written in Python, which these expect."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (MidiSource, WavSource):
        spark.dataSource.register(source)


@dataclass
class Files(InputPartition):
    """Whole files, or one range of bytes [start, end) of one file."""

    names: list[str]
    start: int = 0
    end: int = -1


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


def _store(path: str):
    from .files import store_of

    return store_of(path)


class _Reader(DataSourceReader):
    suffix = ""

    def __init__(self, schema, options):
        self.schema, self.path = schema, options.get("path")
        self.task_bytes = int(options.get("taskbytes", TASK_BYTES))
        self.strict = options.get("mode", "permissive").lower() == "failfast"
        self.songs = None

    def pushFilters(self, filters):
        """Conditions on the song prune files; all are checked again by Spark."""
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("song",):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.songs = own if self.songs is None else self.songs & own
            yield f

    def listed(self):
        """(name below the folder, bytes) of the files that are not temporary."""
        from pyarrow import fs

        store, folder = _store(self.path)
        top = folder.rstrip("/") + "/"
        for info in store.get_file_info(fs.FileSelector(folder, recursive=True)):
            name = info.path.removeprefix(top).removeprefix(top.lstrip("/"))
            if info.is_file and name.lower().endswith(self.suffix) and not any(p.startswith(("_", ".")) for p in name.split("/")) and (self.songs is None or self.song_of(name) in self.songs):
                yield name, info.size

    def song_of(self, name: str) -> str:
        return name

    def opened(self, name: str):
        store, folder = _store(self.path)
        return store.open_input_file(f"{folder.rstrip('/')}/{name}")

    def batch(self, rows: list[dict]):
        """An Arrow batch of the asked columns."""
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        return pa.RecordBatch.from_pylist([{f: r.get(f) for f in self.schema.names} for r in rows], to_arrow_schema(self.schema))


class _Writer(DataSourceArrowWriter):
    suffix = ""

    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.job = uuid.uuid4().hex

    def staged(self, *parts: str) -> str:
        return "/".join([_store(self.path)[1].rstrip("/"), "_temporary", self.job, *parts])

    @staticmethod
    def clean(name: str) -> str:
        """A name below the folder: steps out of it go."""
        return "/".join(p for p in name.split("/") if p not in ("", ".", ".."))

    def moves(self, messages) -> list[tuple[str, str]]:
        """(staged path, name) of everything that the tasks wrote."""
        return [(s, s.removeprefix(self.staged() + "/").partition("/")[2]) for m in messages if m for s in m.names]

    def commit(self, messages) -> None:
        from pyarrow import fs

        store, folder = _store(self.path)
        moves = self.moves(messages)
        if len({n for _, n in moves}) < len(moves):
            self.abort(messages)
            raise ValueError("rows of one file lie in several tasks; repartition by song first")
        if self.overwrite:
            for info in store.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True)):
                if info.is_file and info.path.lower().endswith(self.suffix) and "/_temporary/" not in info.path:
                    store.delete_file(info.path)
        for staged, name in moves:
            to = f"{folder.rstrip('/')}/{name}"
            store.create_dir(to.rpartition("/")[0], recursive=True)
            store.move(staged, to)
        self.abort(messages)

    def abort(self, messages) -> None:
        """Remove what is staged; the final names were never touched."""
        from pyarrow import fs

        store, folder = _store(self.path)
        top = f"{folder.rstrip('/')}/_temporary"
        if store.get_file_info(f"{top}/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{top}/{self.job}")
        if store.get_file_info(top).type == fs.FileType.Directory and not store.get_file_info(fs.FileSelector(top)):
            store.delete_dir(top)


class MidiSource(DataSource):
    """Events of MIDI files; a broken file is a row of its song and a reason, or an error in mode ``failfast``."""

    @classmethod
    def name(cls):
        return "midi"

    def schema(self):
        from pyspark.sql import types as T

        from cadenza.schemas import EVENTS

        return T.StructType([*EVENTS.fields, T.StructField("reason", T.StringType())])

    def reader(self, schema):
        return _MidiReader(schema, self.options)

    def writer(self, schema, overwrite):
        return _MidiWriter(self.options, overwrite)


class _MidiReader(_Reader):
    suffix = ".mid"

    def partitions(self):
        out, own, size = [], [], 0
        for name, n in sorted(self.listed()):
            if own and size + n > self.task_bytes:
                out.append(Files(own))
                own, size = [], 0
            own.append(name)
            size += n
        return [*out, Files(own)]

    def read(self, partition):
        from .midi import decode

        for name in partition.names:
            with self.opened(name) as f:
                data = f.read()
            try:
                rows = decode(data, name)
            except (ValueError, IndexError) as e:
                if self.strict:
                    raise
                rows = [{"song": name, "reason": str(e) or type(e).__name__}]
            for i in range(0, len(rows), 1 << 14):
                yield self.batch(rows[i : i + (1 << 14)])


class _MidiWriter(_Writer):
    suffix = ".mid"

    def write(self, iterator):
        from .midi import encode

        store, _ = _store(self.path)
        task, names, own = uuid.uuid4().hex, [], []

        def put():
            if own:
                name = self.clean(re.sub(r"\.midi?$", "", str(own[0]["song"]))) + ".mid"
                names.append(self.staged(task, name))
                if names[-1] in names[:-1]:
                    raise ValueError("rows of one song are not together; sort by song first")
                store.create_dir(names[-1].rpartition("/")[0], recursive=True)
                with store.open_output_stream(names[-1]) as f:
                    f.write(encode(own))
                own.clear()

        for batch in iterator:
            for row in batch.to_pylist():
                if own and own[0]["song"] != row["song"]:
                    put()
                own.append(row)
        put()
        return Written(names)


class WavSource(DataSource):
    """Chunks of ``frames`` frames of PCM files ``<song>-<voice>.wav``; a broken file is a row of its song, voice and a reason."""

    @classmethod
    def name(cls):
        return "wav"

    def schema(self):
        return PCM_FIELDS + ", reason string"

    def reader(self, schema):
        return _WavReader(schema, self.options)

    def writer(self, schema, overwrite):
        return _WavWriter(self.options, overwrite)


class _WavReader(_Reader):
    suffix = ".wav"

    def __init__(self, schema, options):
        super().__init__(schema, options)
        self.frames = int(options.get("frames", 4096))

    def song_of(self, name):
        return name[: -len(self.suffix)].rpartition("-")[0]

    def partitions(self):
        """Ranges of bytes; small files together."""
        out, own, size = [], [], 0
        for name, n in sorted(self.listed()):
            if n > self.task_bytes:
                out += [Files([name], i, i + self.task_bytes) for i in range(0, n, self.task_bytes)]
                continue
            if own and size + n > self.task_bytes:
                out.append(Files(own))
                own, size = [], 0
            own.append(name)
            size += n
        return [*out, *([Files(own)] if own or not out else [])]

    def read(self, partition):
        from .wav import read_head, to_16_bits

        asked = "samples" in self.schema.names
        for name in partition.names:
            song, _, voice = name[: -len(self.suffix)].rpartition("-")
            with self.opened(name) as f:
                try:
                    channels, rate, bits, first, size = read_head(f, f.size())
                except (ValueError, struct.error) as e:
                    if self.strict:
                        raise
                    if partition.start == 0:  # of the ranges of a file the first tells
                        yield self.batch([{"song": song, "voice": voice, "reason": str(e)}])
                    continue
                step = self.frames * channels * (bits // 8)
                begin = max(0, -(-(partition.start - first) // step)) if partition.start else 0
                stop = -(-size // step) if partition.end < 0 else min(-(-size // step), max(0, -(-(partition.end - first) // step)))
                for chunk in range(begin, stop):
                    row = {"song": song, "voice": voice, "chunk": chunk, "frame0": chunk * self.frames, "n_channels": channels, "rate": rate}
                    if asked:
                        f.seek(first + chunk * step)
                        row["samples"] = to_16_bits(f.read(min(step, size - chunk * step)), bits)
                    yield self.batch([row])


class _WavWriter(_Writer):
    """Rows (song, voice, frame0, n_channels, samples, total, first): ``total`` is the file's samples, ``first`` marks its first chunk.

    On a local folder every task writes its chunks at their places in the file, so a file is
    written by many tasks; elsewhere a task writes whole files, whose chunks must come in order.
    """

    suffix = ".wav"

    def __init__(self, options, overwrite):
        super().__init__(options, overwrite)
        self.rate = int(options.get("rate", 44100))

    def moves(self, messages):
        return sorted(set(super().moves(messages)))  # tasks share a file

    def write(self, iterator):
        import numpy as np
        from pyarrow import fs

        from .wav import head

        store, _ = _store(self.path)
        local = isinstance(store, fs.LocalFileSystem)
        task = "shared" if local else uuid.uuid4().hex
        names, now = [], None
        try:
            for batch in iterator:
                for r in batch.to_pylist():
                    name = self.staged(task, self.clean(f"{r['song']}-{r['voice']}.wav"))
                    n = int(r["n_channels"])
                    body = np.clip(np.asarray(r["samples"], np.int64), -32767, 32767).astype("<i2").tobytes()
                    at = int(r["frame0"]) * n * 2
                    top = head(n, self.rate, int(r["total"]) * 2)
                    if now is None or now[0] != name:
                        if now:
                            now[1].close()
                        if name in names and not local:
                            raise ValueError("chunks of one file are not together; sort by song and voice first")
                        store.create_dir(name.rpartition("/")[0], recursive=True)
                        now = [name, _Places(name) if local else store.open_output_stream(name), 0]
                        names.append(name)
                        if not local:
                            now[1].write(top)
                    if local:
                        if r["first"]:
                            now[1].put(0, top)
                        now[1].put(len(top) + at, body)
                    else:
                        now[1].write(b"\0" * (at - now[2]))  # silence before the chunk
                        now[1].write(body)
                        now[2] = at + len(body)
        finally:
            if now:
                now[1].close()
        return Written(sorted(set(names)))


class _Places:
    """A local file that many tasks write to, each at its own places; what nobody writes is zero."""

    def __init__(self, name: str):
        import os

        self.file = os.open(name, os.O_CREAT | os.O_WRONLY)

    def put(self, at: int, data: bytes) -> None:
        import os

        while data:
            n = os.pwrite(self.file, data, at)
            data, at = data[n:], at + n

    def close(self) -> None:
        import os

        os.close(self.file)
