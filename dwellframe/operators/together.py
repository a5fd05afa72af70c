"""Tasks that work on their rows together: one barrier job in place of a job for every sum.

A learner needs the sums over all rows again and again. Where every task of a pass can
run at the same time, one barrier job keeps the rows in the tasks' memory, and the tasks
exchange their tables through small files in the shared folder (Spark's own ``allGather``
answers once a second only). Each task has two files, which it replaces in turn: nobody
writes a table anew before all have read the one before. If a task fails, Spark starts
the whole stage again; its tasks first tell one another who they are, and meet in a new folder.

Tables of counts and sums by (node, feature, code) come from :class:`Packed`: features of
few codes share one number, so one pass over the rows counts several of them.
"""

from __future__ import annotations

import math
import os
import re
import struct
import time
from collections.abc import Sequence

import numpy as np
from pyspark import BarrierTaskContext, TaskContext

from ..session import ensure_checkpoint_dir

#: So many tasks work together at most (each reads the sums of all), with about so many bytes of rows each at most.
MOST_TASKS, MOST_BYTES = 32, 1 << 30
#: Larger tables are summed in shares, one a task.
WHOLE_BYTES = 1 << 20
#: Rows that are counted at a time, and the cells that they are counted into.
ROWS, CELLS = 1 << 15, 1 << 12


def slots(spark) -> int:
    """Tasks that can run at the same time for as long as they like; 0 where Spark or the shared folder do not allow that."""
    sc = spark.sparkContext
    ensure_checkpoint_dir(spark)
    if not sc.getCheckpointDir().startswith("file:") or str(sc.getConf().get("spark.dynamicAllocation.enabled", "false")).lower() == "true":
        return 0
    jsc = sc._jsc.sc()
    return int(jsc.maxNumConcurrentTasks(jsc.resourceProfileManager().defaultResourceProfile()))


def _put(path: str, *data: bytes | str) -> None:
    """A small file, all at once."""
    with open(f"{path}.new", "wb") as f:
        for x in data:
            f.write(x.encode() if isinstance(x, str) else x)
    os.replace(f"{path}.new", path)


def _text(path: str) -> str | None:
    try:
        with open(path) as f:
            return f.read()
    except FileNotFoundError:
        return None


class Exchange:
    """What the tasks of a barrier stage tell one another; a single task talks to itself."""

    def __init__(self, folder: str, rank: int, size: int):
        self.rank, self.size, self.turn = rank, size, 0
        self.folder = re.sub(r"^file:(//[^/]*)?", "", folder)
        if size > 1:
            os.makedirs(self.folder, exist_ok=True)

    @classmethod
    def here(cls, folder: str, tasks: int) -> Exchange:
        """The exchange of the running task."""
        if tasks == 1:
            return cls(folder, TaskContext.get().partitionId(), 1)
        context = BarrierTaskContext.get()
        rank, own = context.partitionId(), str(context.taskAttemptId())
        at = cls(folder, rank, tasks).folder
        leader, told, pause = own if rank == 0 else None, None, 1e-4
        while True:
            if rank:
                leader = _text(f"{at}/0.task")
            if leader and told != leader:
                _put(f"{at}/{rank}.task", f"{own} {leader}" if rank else own)
                told = leader
            if rank == 0:
                others = [(_text(f"{at}/{i}.task") or "").split() for i in range(1, tasks)]
                if all(x[1:] == [own] for x in others):
                    _put(f"{at}/all", " ".join([own, *(x[0] for x in others)]))
            found = (_text(f"{at}/all") or "").split()
            if len(found) == tasks and found[rank] == own:  # nobody else was this task
                return cls(f"{at}/{found[0]}", rank, tasks)
            time.sleep(pause)
            pause = min(2 * pause, 5e-3)

    def _path(self, rank: int) -> str:
        return f"{self.folder}/{rank}.{self.turn % 2}"

    def _read(self, rank: int, a: int = 0, b: int | None = None) -> bytes:
        """Bytes a to b of what a task says in this turn, as soon as it says it."""
        pause = 1e-4
        while True:
            try:
                with open(self._path(rank), "rb") as f:
                    if struct.unpack("<q", f.read(8))[0] == self.turn:
                        f.seek(a, 1)
                        return f.read() if b is None else f.read(b - a)
            except FileNotFoundError:
                pass
            time.sleep(pause)
            pause = min(2 * pause, 5e-3)

    def _say(self, data: bytes) -> None:
        self.turn += 1
        _put(self._path(self.rank), struct.pack("<q", self.turn), data)

    def gather(self, own: np.ndarray) -> list[np.ndarray]:
        """Every task's flat array of one kind, in order."""
        own = np.ascontiguousarray(own).reshape(-1)
        if self.size == 1:
            return [own]
        self._say(own.tobytes())
        return [own if i == self.rank else np.frombuffer(self._read(i), own.dtype) for i in range(self.size)]

    def share(self, table: np.ndarray) -> tuple[int, np.ndarray]:
        """The sum of all tasks' tables, of this task's share of their first axis, and where the share begins."""
        if self.size == 1:
            return 0, table
        ends = [len(table) * i // self.size for i in range(self.size + 1)]
        a, b = ends[self.rank], ends[self.rank + 1]
        self._say(np.ascontiguousarray(table).tobytes())
        row, total = math.prod(table.shape[1:]) * table.itemsize, table[a:b].copy()
        for i in range(self.size):
            if i != self.rank:
                total += np.frombuffer(self._read(i, a * row, b * row), table.dtype).reshape(total.shape)
        return a, total

    def total(self, table: np.ndarray) -> np.ndarray:
        """The sum of all tasks' tables."""
        if self.size == 1:
            return table
        flat = np.ascontiguousarray(table).reshape(-1)
        if flat.nbytes * self.size <= WHOLE_BYTES:
            return sum(self.gather(flat)).reshape(table.shape)
        return np.concatenate(self.gather(self.share(flat)[1])).reshape(table.shape)


class Packed:
    """Codes of rows (features x rows, bytes from 0 on), with the features of a group in one number.

    A group's number tells the codes of its features that occur here; groups have ``cells`` numbers
    at most, so single features of more codes stay by themselves.
    """

    def __init__(self, codes: np.ndarray, cells: int = CELLS):
        self.present = [np.flatnonzero(np.bincount(code.view(np.uint8), minlength=1)) for code in codes]
        self.groups: list[tuple[list[int], int]] = []
        self.columns: list[np.ndarray] = []
        members: list[list[int]] = []
        size = cells + 1
        for j in sorted(range(len(codes)), key=lambda j: len(self.present[j])):
            if size * len(self.present[j]) > cells:
                members.append([])
                size = 1
            members[-1].append(j)
            size *= len(self.present[j])
        for own in members:
            number, stride = np.zeros(codes.shape[1], np.int16 if cells <= 1 << 15 else np.int32), 1
            for j in reversed(own):
                place = np.zeros(256, number.dtype)
                place[self.present[j]] = stride * np.arange(len(self.present[j]))
                number += place[codes[j].view(np.uint8)]
                stride *= len(self.present[j])
            self.groups.append((own, stride))
            self.columns.append(number)

    def counted(self, columns: Sequence[np.ndarray], slot: np.ndarray, both: np.ndarray, starts: Sequence[int], out: np.ndarray) -> None:
        """Adds sums of ``both`` (whole numbers) to ``out`` (slots x cells, a feature's codes from its start on) for rows with these group numbers."""
        n = len(out)
        for (own, size), number in zip(self.groups, columns, strict=True):
            cells = np.bincount(slot * size + number, weights=both, minlength=n * size)
            cells = cells.reshape(n, *(len(self.present[j]) for j in own))
            for k, j in enumerate(own):
                out[:, starts[j] + self.present[j]] += cells.sum(axis=tuple(i + 1 for i in range(len(own)) if i != k)) if len(own) > 1 else cells


class Both:
    """Whole numbers w >= 0 and g of rows as one number each, w in the units above the largest sum of g, where doubles
    hold the sums exactly (below 2**53); else two numbers."""

    def __init__(self, w: np.ndarray | None, g: np.ndarray):
        rows = float(len(g) if w is None else w.sum())
        self.unit = 2.0 ** (math.frexp(float(np.abs(g).sum()))[1] + 1)
        w = 1.0 if w is None else w.astype(float)
        self.parts = [w * self.unit + g] if (rows + 1) * self.unit < 2.0 ** 53 else [w + np.zeros(len(g)), g]

    def masked(self, mine: np.ndarray) -> list[np.ndarray]:
        return [np.where(mine, x, 0.0) for x in self.parts]

    def apart(self, sums: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Sums of w and of g, from sums of the parts."""
        if len(sums) == 2:
            return tuple(np.rint(x).astype(np.int64) for x in sums)
        n = np.rint(sums[0] / self.unit)
        return n.astype(np.int64), (sums[0] - n * self.unit).astype(np.int64)
