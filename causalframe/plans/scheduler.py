"""Task graphs for an external scheduler.

A scheduler that asks its tasks for an identity, what they require, whether they are
complete, and to run (as public workflow schedulers do) gets a `Scheduled` for each task.
Its classes need no more than to pass these calls on:

    class Own(scheduler.Task):
        def __init__(self, scheduled): self.own = scheduled
        task_id = property(lambda self: self.own.task_id)
        def requires(self): return [Own(s) for s in self.own.requires()]
        def complete(self): return self.own.complete()
        def run(self): self.own.run()

`ScheduledRunner` runs a graph through such a scheduler's entry point and tells the
outcome from what is there afterwards, so it does not matter in which processes tasks ran.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from causalframe.plans.graph import Graph, GraphStatus, Runner
from causalframe.plans.tasks import Task


@dataclass(frozen=True)
class Scheduled:
    task: Task
    graph: Graph

    @property
    def task_id(self) -> str:
        """The same for equal tasks, in every process."""
        return f"{self.task.output.name}_{self.task.output.version}_{self.task.output.hash}"

    @property
    def parameters(self) -> dict[str, str]:
        """What identifies the task, as text."""
        out = self.task.output
        return {"name": out.name, "version": out.version, "hash": str(out.hash)} | {k: repr(v) for k, v in out.params.items()}

    def requires(self) -> list[Scheduled]:
        return sorted((Scheduled(t, self.graph) for t in self.graph.parents[self.task]), key=lambda s: s.task_id)

    def complete(self) -> bool:
        return self.task.complete()

    def run(self) -> None:
        self.task.run()


def scheduled(graph: Graph) -> list[Scheduled]:
    """What to hand to a scheduler: the tasks that nothing else depends on."""
    return sorted((Scheduled(t, graph) for t in graph.sinks), key=lambda s: s.task_id)


def outcome(graph: Graph) -> GraphStatus:
    """The state of a graph after a run elsewhere: tasks that could have run and are not
    complete have failed, what depends on them is blocked."""
    status = GraphStatus(graph)
    for task in sorted(status.ready, key=lambda t: t.output.name):
        status.gave_up(task)
    return status


class ScheduledRunner(Runner):
    """build: runs these tasks and all that they require, in whatever processes."""

    def __init__(self, build: Callable[[list[Scheduled]], object]):
        self.build = build

    def run(self, graph):
        self.build(scheduled(graph))
        return outcome(graph)
