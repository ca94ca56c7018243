"""Model calls in processes that can be killed, for calls with a hard time limit."""

from __future__ import annotations

import multiprocessing
import pickle
import signal
import time
from collections.abc import Callable
from multiprocessing.connection import Connection, wait
from typing import Any

from pyspark import cloudpickle

#: Seconds after its limit at which a call's process ends by itself, should the task be gone that watches it.
GRACE = 5.0


def _serve(pipe: Connection, make: bytes, limit: float) -> None:
    """Make the model, say so, and answer rows until the pipe ends."""
    signal.signal(signal.SIGALRM, signal.SIG_DFL)
    try:
        call = pickle.loads(make)()
    except Exception as e:
        pipe.send(e.__class__.__name__)
        return
    pipe.send(None)
    while True:
        try:
            row = pipe.recv()
        except EOFError:
            return
        signal.setitimer(signal.ITIMER_REAL, limit + GRACE)
        answer = call(row)
        try:
            pipe.send(answer)
        except Exception as e:  # an answer that cannot be sent is the adapter's failure
            pipe.send({"error_kind": "adapter_error", "error_message": type(e).__name__, "retriable": False})
        signal.setitimer(signal.ITIMER_REAL, 0)


class ModelProcesses:
    """Up to size processes with a model each, started when there is a row for them.

    make gives the function that is called with each row and returns a dict. A call that has not answered within limit
    seconds has its process killed, whatever it is doing, and its row becomes late; the next row for that place starts a
    new process and makes the model again. A process that dies has lost its row. Making a model is not part of the limit.
    Modules in preload are imported once, before processes are split off, so a new process costs little.
    """

    def __init__(self, make: Callable[[], Callable[[Any], dict]], limit: float, size: int, preload: list[str] | None = None) -> None:
        self.make, self.limit, self.size = cloudpickle.dumps(make), limit, size
        self.context = multiprocessing.get_context("forkserver")  # not a copy of the task's process, which has threads
        self.context.set_forkserver_preload([__name__, *(preload or [])])
        self.running: dict[Connection, multiprocessing.Process] = {}

    def _start(self) -> Connection:
        mine, its = self.context.Pipe()
        process = self.context.Process(target=_serve, args=(its, self.make, self.limit), daemon=True)
        process.start()
        its.close()
        failed = mine.recv()  # EOFError: the process died while the model was made
        if failed is not None:
            process.join()
            raise RuntimeError(f"the model could not be made: {failed}")
        self.running[mine] = process
        return mine

    def _end(self, pipe: Connection) -> None:
        process = self.running.pop(pipe)
        process.kill()
        process.join()
        pipe.close()

    def answers(self, rows: list, late: dict, lost: dict, retries: int = 0) -> list[dict]:
        """One dict a row, in the rows' order. A late or lost row is called again up to retries times."""
        out: list[dict] = [late] * len(rows)
        waiting, tries = list(range(len(rows)))[::-1], [0] * len(rows)
        busy: dict[Connection, tuple[int, float]] = {}
        while waiting or busy:
            while waiting and len(busy) < self.size:
                idle = next((p for p in self.running if p not in busy), None) or self._start()
                at = waiting.pop()
                tries[at] += 1
                try:
                    idle.send(rows[at])
                except (BrokenPipeError, ConnectionResetError):  # it ended after its last answer: no fault of this row
                    self._end(idle)
                    tries[at] -= 1
                    waiting.append(at)
                    continue
                busy[idle] = at, time.monotonic() + self.limit
            ready = wait(list(busy), max(0.0, min(end for _, end in busy.values()) - time.monotonic()))
            now = time.monotonic()
            for pipe in [p for p, (_, end) in busy.items() if p in ready or end <= now]:
                at, _ = busy.pop(pipe)
                try:
                    if pipe in ready:
                        out[at] = pipe.recv()
                        continue
                    failed = late
                except (EOFError, ConnectionResetError):
                    failed = lost
                self._end(pipe)
                out[at] = failed
                if tries[at] <= retries:
                    waiting.append(at)
        return out

    def close(self) -> None:
        for pipe in list(self.running):
            self._end(pipe)

    def __enter__(self) -> ModelProcesses:
        return self

    def __exit__(self, *_) -> None:
        self.close()

