"""Event lines as a data source: streams write to it and read from it, and a stream that starts anew neither loses nor repeats a line.

A folder holds ``parts`` (files of lines, one a task) and ``batches``: a small file for each batch that was committed, with the names of
its parts. Tasks of a batch write parts under names of their own; the commit of the batch names those that ended well, in
one file that exists whole or not at all. A batch that is committed a second time, as after a stop between the commit and Spark's own
note of it, changes nothing. Readers count in batches: an offset is the number of batches seen, and a part is read by one task.

Nulls and edges: a null line is kept as null. Lines are of any length. A folder without batches is an empty stream. A part that a lost task
left behind is in no batch and is never read. Writers of one folder must be one stream, as batches go by its numbers.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

FORMAT = "querent_lines"


def registered(spark: SparkSession) -> None:
    """Makes the format known to ``spark``; its option ``path`` is a folder that driver and executors share."""
    import json
    import uuid

    from pyspark.sql.datasource import DataSource, DataSourceStreamReader, DataSourceStreamWriter, InputPartition, WriterCommitMessage

    # The classes stand here so that they travel with the session, whatever modules a worker can import.
    class Folder:
        def __init__(self, path: str):
            from pyarrow import fs

            if path.startswith("file:"):
                path = "/" + path[5:].lstrip("/")
            self.system, self.path = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)

        def names(self, kind: str) -> list[str]:
            from pyarrow import fs

            found = self.system.get_file_info(fs.FileSelector(f"{self.path}/{kind}", allow_not_found=True))
            return sorted(f.base_name for f in found if not f.base_name.startswith("."))

        def put(self, name: str, data: bytes) -> None:
            kind, _, last = name.rpartition("/")
            self.system.create_dir(f"{self.path}/{kind}", recursive=True)
            part = f"{self.path}/{kind}/.{uuid.uuid4().hex}"
            with self.system.open_output_stream(part) as out:
                out.write(data)
            self.system.move(part, f"{self.path}/{kind}/{last}")

        def get(self, name: str) -> bytes:
            with self.system.open_input_stream(f"{self.path}/{name}") as file:
                return file.read()

        def drop(self, names: list[str]) -> None:
            for name in names:
                self.system.delete_file(f"{self.path}/{name}")

    class Part(InputPartition):
        def __init__(self, name: str):
            self.name = name

    class Written(WriterCommitMessage):
        def __init__(self, name: str | None):
            self.name = name

    class Reader(DataSourceStreamReader):
        def __init__(self, path: str):
            self.path = path

        def initialOffset(self) -> dict:
            return {"batches": 0}

        def latestOffset(self) -> dict:
            return {"batches": len(Folder(self.path).names("batches"))}

        def partitions(self, start: dict, end: dict) -> list[Part]:
            folder = Folder(self.path)
            batches = folder.names("batches")[start["batches"] : end["batches"]]
            return [Part(name) for b in batches for name in json.loads(folder.get(f"batches/{b}"))]

        def read(self, partition: Part):
            for line in Folder(self.path).get(partition.name).splitlines():
                yield tuple(json.loads(line))

        def commit(self, end: dict) -> None:
            pass

    class Writer(DataSourceStreamWriter):
        def __init__(self, path: str):
            self.path = path

        def write(self, iterator) -> Written:
            rows = [json.dumps([row["key"], row["seq"], row["line"]]) for row in iterator]
            if not rows:
                return Written(None)
            name = f"parts/{uuid.uuid4().hex}.json"
            Folder(self.path).put(name, "\n".join(rows).encode())
            return Written(name)

        def commit(self, messages, batchId: int) -> None:
            folder, names = Folder(self.path), sorted(m.name for m in messages if m is not None and m.name)
            batch = f"{batchId:012d}.json"
            if batch in folder.names("batches"):
                folder.drop(names)
            else:
                folder.put(f"batches/{batch}", json.dumps(names).encode())

        def abort(self, messages, batchId: int) -> None:
            Folder(self.path).drop([m.name for m in messages if m is not None and m.name])

    class Lines(DataSource):
        @classmethod
        def name(cls) -> str:
            return FORMAT

        def schema(self) -> str:
            return "key string, seq int, line string"

        def streamReader(self, schema) -> Reader:
            return Reader(self.options["path"])

        def streamWriter(self, schema, overwrite: bool) -> Writer:
            return Writer(self.options["path"])

    spark.dataSource.register(Lines)
