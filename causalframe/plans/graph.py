"""Task graphs, their status, and runners that submit Spark jobs."""

from __future__ import annotations

import logging
from abc import ABC, abstractmethod
from collections.abc import Iterable
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

from causalframe.plans.tasks import Task


class Graph:
    """Tasks and all that they depend on; equal ones are one."""

    def __init__(self, tasks: Iterable[Task]):
        self.parents: dict[Task, set[Task]] = {}
        todo = list(tasks)
        while todo:
            task = todo.pop()
            if task not in self.parents:
                self.parents[task] = {d.task for d in task.dependencies.values()}
                todo += self.parents[task]
        self.children: dict[Task, set[Task]] = {t: set() for t in self.parents}
        for task, parents in self.parents.items():
            for p in parents:
                self.children[p].add(task)

    @property
    def tasks(self) -> set[Task]:
        return set(self.parents)

    @property
    def sinks(self) -> set[Task]:
        return {t for t, c in self.children.items() if not c}

    def get_successors(self, task: Task) -> set[Task]:
        return set(self.children[task])


class TaskModule:
    """A namespace whose attributes are tasks, or modules of them."""

    def all_tasks(self) -> set[Task]:
        found = set()
        for name in dir(self):
            if name.startswith("_"):
                continue
            value = getattr(self, name)
            if isinstance(value, Task):
                found.add(value)
            elif isinstance(value, TaskModule):
                found |= value.all_tasks()
        return found


class GraphStatus:
    """What of a graph needs to run. The walk starts at the sinks and stops at complete
    tasks, so what only they need is never looked at."""

    def __init__(self, graph: Graph):
        self.graph = graph
        self.complete: set[Task] = set()
        self.failed: set[Task] = set()
        self.has_failed_predecessor: set[Task] = set()
        self.ready: set[Task] = set()
        self._pending: set[Task] = set()
        todo, seen = list(graph.sinks), set()
        while todo:
            task = todo.pop()
            if task in seen:
                continue
            seen.add(task)
            if task.complete():
                self.complete.add(task)
            else:
                self._pending.add(task)
                todo += graph.parents[task]
        self.ready = {t for t in self._pending if self._can_run(t)}

    def _can_run(self, task: Task) -> bool:
        return self.graph.parents[task] <= self.complete

    @property
    def waiting(self) -> set[Task]:
        return self._pending - self.ready

    def ran(self, task: Task) -> set[Task]:
        """Marks a success; what can run now because of it."""
        self._settle(task)
        self.complete.add(task)
        new = {t for t in self.graph.children[task] if t in self._pending and self._can_run(t)}
        self.ready |= new
        return new

    def gave_up(self, task: Task) -> set[Task]:
        """Marks a failure; what cannot run any more because of it."""
        self._settle(task)
        self.failed.add(task)
        new, todo = set(), list(self.graph.children[task])
        while todo:
            t = todo.pop()
            if t in self._pending and t not in new:
                new.add(t)
                self._settle(t)
                todo += self.graph.children[t]
        self.has_failed_predecessor |= new
        return new

    def _settle(self, task: Task) -> None:
        self._pending.discard(task)
        self.ready.discard(task)

    def __str__(self) -> str:
        names = "\n  ".join(sorted(t.output.name for t in self.failed))
        return f"{len(self.graph.tasks)} tasks: {len(self.complete)} complete, {len(self.failed)} failed, {len(self.ready)} ready, {len(self.waiting)} waiting, {len(self.has_failed_predecessor)} without a predecessor that failed\n  {names}"

    def to_df(self, spark: SparkSession) -> DataFrame:
        """name, status."""
        groups = {"complete": self.complete, "failed": self.failed, "ready": self.ready, "waiting": self.waiting, "blocked": self.has_failed_predecessor}
        return spark.createDataFrame([(t.output.name, k) for k, g in groups.items() for t in g], "name string, status string")


class Runner(ABC):
    @abstractmethod
    def run(self, graph: Graph) -> GraphStatus: ...

    @staticmethod
    def _failed(task: Task) -> None:
        logging.getLogger(__name__).exception("%s failed", task.output.name)


class SingleThreadedRunner(Runner):
    """One task after the other; a failure stops only what depends on it."""

    def run(self, graph):
        status = GraphStatus(graph)
        while status.ready:
            task = min(status.ready, key=lambda t: t.output.name)
            try:
                task.run()
            except Exception:
                self._failed(task)
                status.gave_up(task)
            else:
                status.ran(task)
        return status


class MultiThreadedRunner(Runner):
    """Independent tasks at once: threads of one driver submit jobs to one session, which a
    FAIR scheduler shares out. Threads take over the caller's job properties."""

    def __init__(self, spark: SparkSession, threads: int = 8):
        self.spark, self.threads = spark, threads

    def run(self, graph):
        status = GraphStatus(graph)
        running = {}
        with ThreadPoolExecutor(self.threads) as pool:
            while status.ready or running:
                for task in list(status.ready):
                    status.ready.discard(task)
                    running[pool.submit(inheritable_thread_target(self.spark)(task.run))] = task
                done, _ = wait(running, return_when=FIRST_COMPLETED)
                for future in done:
                    task = running.pop(future)
                    try:
                        future.result()
                    except Exception:
                        self._failed(task)
                        status.gave_up(task)
                    else:
                        status.ran(task)
        return status
