"""A stream source over an append-only log of rows with growing ids, some of which are saved late."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition


def _source() -> type[DataSource]:
    """The source's class; made here, so that workers get it by value."""

    class Part(InputPartition):
        """Ids in (low, high], only those of `only` if there are any, without those of `absent`."""

        def __init__(self, files: list[str], low: int, high: int, only: list[int], absent: list[int]):
            self.files, self.low, self.high, self.only, self.absent = files, low, high, only, absent

    class Reader(DataSourceStreamReader):
        """An offset is the newest id and the ids that were missing within `lookback` below it, so what lies between two offsets is the same each time it is read.

        What was below the baseline, or that far back, when it was saved, never comes; nor does an id come twice."""

        def __init__(self, options: dict, names: list[str]):
            self.path, self.column, self.names = options["path"].removeprefix("file://").replace("file:/", "/"), options["id"], names
            self.baseline, self.lookback, self.ids_a_task = int(options.get("baseline", -1)), int(options.get("lookback", 100)), int(options.get("ids_a_task", 100_000))
            self.known: dict[str, tuple[int, int] | None] = {}  # files never change: least and largest id

        def _files(self) -> dict[str, tuple[int, int]]:
            """Least and largest id of each file; the footers of new files alone are read."""
            import pyarrow.dataset as pads

            try:
                found = pads.dataset(self.path, format="parquet").get_fragments()
            except FileNotFoundError:
                return {}
            for f in found:
                if f.path not in self.known:
                    seen = [g.statistics.get(self.column) for g in f.row_groups]
                    seen = [(s["min"], s["max"]) for s in seen if s and s["max"] is not None]
                    self.known[f.path] = (min(a for a, _ in seen), max(b for _, b in seen)) if seen else None
            return {f: s for f, s in self.known.items() if s}

        def initialOffset(self) -> dict:
            return {"highest": self.baseline, "missing": ""}

        def latestOffset(self) -> dict:
            import pyarrow.dataset as pads

            files = self._files()
            highest = max((b for _, b in files.values()), default=self.baseline)
            if highest <= self.baseline:
                return self.initialOffset()
            floor = max(self.baseline, highest - self.lookback)
            near = pads.dataset([f for f, (_, b) in files.items() if b > floor], format="parquet")
            there = set(near.to_table(columns=[self.column], filter=pads.field(self.column) > floor)[self.column].to_pylist())
            return {"highest": highest, "missing": ",".join(str(i) for i in range(floor + 1, highest) if i not in there)}

        def partitions(self, start: dict, end: dict) -> list[InputPartition]:
            files = self._files()
            late = {int(i) for i in start["missing"].split(",") if i} - {int(i) for i in end["missing"].split(",") if i}
            # what was missing and isn't any more: it has come, or is out of reach of the end and may have
            out = [Part([f for f, (a, b) in files.items() if a <= max(late) and b >= min(late)], min(late) - 1, max(late), sorted(late), [])] if late else []
            for low in range(start["highest"], end["highest"], self.ids_a_task):
                high = min(low + self.ids_a_task, end["highest"])
                inside = [f for f, (a, b) in files.items() if a <= high and b > low]
                if inside:
                    out.append(Part(inside, low, high, [], [int(i) for i in end["missing"].split(",") if i and low < int(i) <= high]))
            return out

        def read(self, part: Part):
            import pyarrow as pa
            import pyarrow.compute as pc
            import pyarrow.dataset as pads

            if not part.files:
                return
            field = pads.field(self.column)
            wanted = (field > part.low) & (field <= part.high)
            if part.only:
                wanted = wanted & field.isin(part.only)
            if part.absent:  # saved since the offset was taken: they come with a later one
                wanted = wanted & ~field.isin(part.absent)
            table = pads.dataset(part.files, format="parquet").to_table(columns=self.names, filter=wanted).sort_by(self.column)
            ids = table[self.column].combine_chunks()
            if len(ids):
                first = pa.concat_arrays([pa.array([True]), pc.not_equal(ids[1:], ids[:-1])])
                yield from table.filter(first).to_batches()

    class IdLog(DataSource):
        @classmethod
        def name(cls) -> str:
            return "id_log"

        def streamReader(self, schema) -> DataSourceStreamReader:
            return Reader(dict(self.options), schema.fieldNames())

    return IdLog


def stream(spark: SparkSession, path: str, schema, id_column: str, baseline: int = -1, lookback: int = 100, ids_a_task: int = 100_000) -> DataFrame:
    """Rows of a folder of Parquet files as they are appended, each id once: ids above the newest one that was read, and those that were
    missing among the `lookback` ids below it. Ids up to `baseline` never come, nor do those saved when they are further back than that (one
    that is saved between the taking of an offset and the read may); null ids are left out, and of rows that repeat an id one comes. A task reads the files that may hold its range of ids, with the range pushed down.

    The log is opened by Arrow, on the driver and in tasks: the folder must be one that all of them see. A trigger looks at the
    footers of the files that are new and at the ids within the lookback; its offset holds at most `lookback` ids."""
    spark.dataSource.register(_source())
    options = {"path": path, "id": id_column, "baseline": str(baseline), "lookback": str(lookback), "ids_a_task": str(ids_a_task)}
    return spark.readStream.format("id_log").schema(schema).options(**options).load()
