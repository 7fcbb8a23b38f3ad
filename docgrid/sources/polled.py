"""Polled parsing services as a Spark data source, for batches and for streams.

``spark.read.format("docgrid_tasks")`` and ``readStream`` submit files to a service, ask it until a task is done, and give a
row a file.  The service is a class of the caller's, named by its import path or pickled into the options, with

* ``listing() -> list[str]``: names of the files, in the order of their arrival, which only grows;
* ``submit(name) -> task``, ``status(task) -> "done" | "failed" | other`` and ``fetch(task) -> str``.

A batch has a partition for every ``per_partition`` files, so executors wait for many tasks at a time.  A stream's offset is
how many files of the listing were seen; a stream that stopped goes on behind the last offset that was committed.
"""

from __future__ import annotations

import base64
import pickle
import time
from collections.abc import Iterator
from dataclasses import dataclass
from importlib import import_module

from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

NAME = "docgrid_tasks"
SCHEMA = "name string, content string, status string, error string"


def service_option(service: object) -> str:
    """A service as the value of the option ``service``."""
    return base64.b64encode(cloudpickle.dumps(service)).decode()


def _service(options: dict):
    given = options.get("service", "")
    if ":" in given:
        module, name = given.split(":", 1)
        return getattr(import_module(module), name)()
    if not given:
        raise ValueError("the option service is needed")
    return pickle.loads(base64.b64decode(given))  # noqa: S301 - made by service_option in the caller's own program


@dataclass
class Files(InputPartition):
    names: list


class _Reads:
    """What batches and streams share: files are dealt into partitions and waited for on executors."""

    def __init__(self, options: dict):
        # names of options come in lower case
        self.options = {k.lower(): v for k, v in options.items()}
        self.per_partition = int(self.options.get("per_partition", 16))
        self.every, self.patience = float(self.options.get("every", 2.0)), float(self.options.get("patience", 300.0))

    def dealt(self, names: list) -> list[Files]:
        return [Files(names[s : s + self.per_partition]) for s in range(0, len(names), self.per_partition)]

    def read(self, partition: Files) -> Iterator[tuple]:
        """All tasks are submitted first and then asked in turn, so a partition takes as long as its slowest file."""
        service, tasks, until = _service(self.options), {}, time.monotonic() + self.patience
        for name in partition.names:
            try:
                tasks[name] = service.submit(name)
            except Exception as e:  # noqa: BLE001 - a service may fail in any way, and the other files go on
                yield name, None, "failed", str(e)
        while tasks:
            for name, task in list(tasks.items()):
                try:
                    now = service.status(task)
                    if now == "done":
                        yield name, service.fetch(task), "done", None
                    elif now == "failed":
                        yield name, None, "failed", "the service failed"
                    elif time.monotonic() > until:
                        yield name, None, "timeout", "the task isn't done in time"
                    else:
                        continue
                except Exception as e:  # noqa: BLE001
                    yield name, None, "failed", str(e)
                del tasks[name]
            if tasks:
                time.sleep(self.every)


class TaskReader(_Reads, DataSourceReader):
    def partitions(self) -> list[Files]:
        return self.dealt(list(_service(self.options).listing()))


class TaskStream(_Reads, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"seen": int(self.options.get("from", 0))}

    def latestOffset(self) -> dict:
        return {"seen": len(_service(self.options).listing())}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return self.dealt(list(_service(self.options).listing())[start["seen"] : end["seen"]])

    def commit(self, end: dict) -> None:
        """The listing keeps all files, so nothing is to be done."""


class TaskSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TaskReader:
        return TaskReader(self.options)

    def streamReader(self, schema) -> TaskStream:
        return TaskStream(self.options)


def register(spark: SparkSession) -> None:
    """Make the format ``docgrid_tasks`` known to a session."""
    spark.dataSource.register(TaskSource)
