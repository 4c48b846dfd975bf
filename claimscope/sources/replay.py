"""A Python data source that replays fetched pages from a Parquet folder, standing in for live requests: as a batch, and as
a stream that admits so many links at a time."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: Links of a micro-batch, and tasks that read them at most, where the options do not say otherwise.
LINKS_PER_BATCH = 8
COLUMNS = ["page_id", "url", "html"]


def _opened(uri: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri.removeprefix("file:"))


class PageReplay(DataSource):
    """``spark.read.format("page_replay").option("path", ...)``: rows (page_id, url, html), one partition per row group.

    ``spark.readStream`` with the same format reads each page once, in the order of the files' names, ``linksPerBatch`` a
    micro-batch in ``tasksPerBatch`` tasks at most. A batch's links of one row group are read by one task, as rows within a
    group are reached by decoding those before them. Files may be added while it runs if their names come after those there.
    """

    @classmethod
    def name(cls) -> str:
        return "page_replay"

    def schema(self) -> str:
        return "page_id long, url string, html string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"])

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        links = int(self.options.get("linksPerBatch", LINKS_PER_BATCH))
        return _StreamReader(self.options["path"], links, int(self.options.get("tasksPerBatch", LINKS_PER_BATCH)))


def _groups(path: str, known: dict[str, list[int]]) -> list[tuple[str, int, int]]:
    """(file, row group, rows) of all files in the order of their names; read from the footers of files not yet ``known``."""
    import pyarrow.dataset as ds

    files, path = _opened(path)
    found = sorted(ds.dataset(path, filesystem=files, format="parquet").get_fragments(), key=lambda f: f.path)
    for f in found:
        if f.path not in known:
            known[f.path] = [f.metadata.row_group(k).num_rows for k in range(f.metadata.num_row_groups)]
    return [(f.path, k, rows) for f in found for k, rows in enumerate(known[f.path])]


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(g[:2]) for g in _groups(self.path, {})] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator:
        if partition.value is None:
            return
        import pyarrow.parquet as pq

        path, group = partition.value
        with _opened(self.path)[0].open_input_file(path) as file:
            yield from pq.ParquetFile(file).read_row_group(group, columns=COLUMNS).to_batches()


class _StreamReader(DataSourceStreamReader):
    """An offset is the number of links read so far. Spark keeps the offsets; after a restart it plans the last batch again,
    by which this reader learns where the query stands."""

    def __init__(self, path: str, links: int, tasks: int):
        if links < 1 or tasks < 1:
            raise ValueError("a micro-batch needs a link and a task at least")
        self.path, self.links, self.tasks, self.at = path, links, tasks, 0
        self.known: dict[str, list[int]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}  # tasks do not plan

    def initialOffset(self) -> dict:
        return {"links": 0}

    def latestOffset(self) -> dict:
        there = sum(rows for _, _, rows in _groups(self.path, self.known))
        return {"links": max(self.at, min(self.at + self.links, there))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.at = max(self.at, end["links"])
        pieces = self._pieces(start["links"], end["links"])
        step = max(1, -(-len(pieces) // self.tasks))
        return [InputPartition(pieces[k : k + step]) for k in range(0, len(pieces), step)]

    def _pieces(self, first: int, last: int) -> list[tuple[str, int, int, int]]:
        """(file, row group, first row in it, rows) of a range of links."""
        out, before = [], 0
        for path, group, rows in _groups(self.path, self.known):
            low, high = max(first, before), min(last, before + rows)
            if low < high:
                out.append((path, group, low - before, high - low))
            before += rows
        return out

    def read(self, partition: InputPartition) -> Iterator:
        for piece in partition.value:
            yield from self._read(*piece)

    def _read(self, path: str, group: int, first: int, rows: int) -> Iterator:
        import pyarrow.parquet as pq

        with _opened(self.path)[0].open_input_file(path) as file:
            at = 0
            for batch in pq.ParquetFile(file).iter_batches(batch_size=max(1, min(rows, 1024)), row_groups=[group], columns=COLUMNS):
                low, high = max(0, first - at), min(batch.num_rows, first + rows - at)
                if low < high:
                    yield batch.slice(low, high - low)
                at += batch.num_rows
                if at >= first + rows:
                    return

    def commit(self, end: dict) -> None:
        self.at = max(self.at, end["links"])
