"""Merges of byte pairs, learned by tasks that hold a share of the words each and add up their counts merge by merge.

The words stay where they are: a barrier stage has one task a slot, and the driver gets nothing but the merges. Every task
keeps the same table of the pairs that occur ``least`` times or more in all words. A pair of known tokens only ever gets
rarer, and a new one is at most as frequent as the pair it replaces, so that a pair below ``least`` need not be looked at
until all above it are merged; then ``least`` is lowered and all pairs are counted again. No pair or word is left out.
"""

from __future__ import annotations

import os
import secrets
import socket
from bisect import bisect_left
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: What stands between words, and inside a token of several bytes.
BETWEEN, INSIDE = -1, -2
#: Places that are counted at once.
PIECE = 1 << 22
#: A new ``least`` is this part of the most frequent pair's count.
STEP = 8


def alphabet() -> dict[int, str]:
    """Byte -> printable character: bytes that print stand for themselves, the others follow from 256 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the order that sorts ``keys``, and where each distinct one begins in it."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    return keys[first], order, first


def added(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, order, first = grouped(keys)
    return found, np.add.reduceat(n[order], first) if len(first) else n[:0]


def places(among: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key stands in the sorted array ``among``, and whether it does."""
    at = np.searchsorted(among, keys)
    there = at < len(among)
    there[there] = among[at[there]] == keys[there]
    return at, there


class Alone:
    """One task has all words."""

    n = 1
    add = staticmethod(added)


class Together:
    """The tasks of a barrier stage; the first adds up what all others send, over sockets."""

    def __init__(self, context, secret: bytes):
        from multiprocessing.connection import Client, Listener

        tasks = context.getTaskInfos()
        self.n, self.first = len(tasks), context.partitionId() == 0
        host = tasks[0].address.rsplit(":", 1)[0]
        listener = Listener((host, 0), backlog=self.n, authkey=secret) if self.first else None
        port = context.allGather(str(listener.address[1]) if self.first else "")[0]
        self.ends = [listener.accept() for _ in tasks[1:]] if self.first else [Client((host, int(port)), authkey=secret)]
        if listener:
            listener.close()
        for end in self.ends:
            with socket.socket(fileno=os.dup(end.fileno())) as s:
                s.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)

    def add(self, keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not self.first:
            self.ends[0].send_bytes(np.concatenate([keys, n]).tobytes())
            return self._received(self.ends[0])
        parts = [(keys, n), *map(self._received, self.ends)]
        total = added(np.concatenate([k for k, _ in parts]), np.concatenate([x for _, x in parts]))
        message = np.concatenate(total).tobytes()
        for end in self.ends:
            end.send_bytes(message)
        return total

    @staticmethod
    def _received(end) -> tuple[np.ndarray, np.ndarray]:
        both = np.frombuffer(end.recv_bytes(), np.int64)
        return both[: len(both) // 2], both[len(both) // 2 :]


class Words:
    """A task's words, one after the other in flat arrays.

    ``sym`` has a token at its first byte, ``INSIDE`` at its others and ``BETWEEN`` before and after each word; ``span`` has a
    token's length at its first and last byte. A place is where the right token of a pair begins.
    """

    def __init__(self, batches: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]], n_merges: int):
        """``batches``: bytes of all words, length of each, count of each."""
        self.base = 256 + n_merges
        kind = np.int16 if self.base < 1 << 15 else np.int32
        syms, starts, freq, size = [], [], [], 0
        for data, lengths, n in batches:
            begins = np.concatenate([[0], np.cumsum(lengths[:-1])]).astype(np.int64) + np.arange(len(lengths))
            sym, held = np.empty(len(data) + len(lengths), kind), np.ones(len(data) + len(lengths), bool)
            held[begins] = False
            sym[begins] = BETWEEN
            sym[held] = data
            syms.append(sym)
            starts.append(begins + size)
            freq.append(np.array(n, np.int64))
            size += len(sym)
        self.sym = np.concatenate([*syms, np.array([BETWEEN], kind)])
        self.starts, self.freq = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (starts, freq))
        self.span = np.ones(len(self.sym), np.int32)
        self.kind = np.int32 if len(self.sym) < 1 << 31 else np.int64
        self.index: dict[int, list[np.ndarray]] = {}

    def left(self, at: np.ndarray) -> np.ndarray:
        return self.sym[at - self.span[at - 1]]

    def keys(self, at: np.ndarray) -> np.ndarray:
        return self.left(at).astype(np.int64) * self.base + self.sym[at]

    def weight(self, at: np.ndarray) -> np.ndarray:
        return self.freq[np.searchsorted(self.starts, at, "right") - 1]

    def pairs(self, at: np.ndarray) -> np.ndarray:
        """Those of ``at`` that have a token on either side, once."""
        at = np.unique(at)
        at = at[self.sym[at] >= 0]
        return at[self.left(at) >= 0]

    def count(self) -> tuple[np.ndarray, np.ndarray, list]:
        """All pairs with their counts in this task, and their places by pair."""
        found = []
        for lo in range(1, len(self.sym), PIECE):
            at = lo + np.flatnonzero(self.sym[lo : lo + PIECE] >= 0)
            at = at[self.left(at) >= 0]
            keys = self.keys(at)
            keys, order, first = grouped(keys.astype(np.int32) if self.base**2 < 1 << 31 else keys)
            if len(keys):
                found.append((keys.astype(np.int64), np.add.reduceat(self.weight(at)[order], first), first, at[order].astype(self.kind)))
        none = np.zeros(0, np.int64)
        return *added(np.concatenate([none, *[x[0] for x in found]]), np.concatenate([none, *[x[1] for x in found]])), found

    def merge(self, key: int, token: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Merge a pair everywhere. Places of the pairs that this changed, and these pairs before and after."""
        a, b = divmod(key, self.base)
        at = np.unique(np.concatenate([np.zeros(0, self.kind), *self.index.pop(key, [])]))
        at = at[self.sym[at] == b]
        at = at[self.left(at) == a]
        if a == b and len(at):  # in a run, every other pair
            i = np.arange(len(at))
            begins = np.concatenate([[True], at[1:] != at[:-1] + self.span[at[:-1]]])
            at = at[(i - np.maximum.accumulate(np.where(begins, i, 0))) % 2 == 0]
        begin = at - self.span[at - 1]
        length = self.span[begin] + self.span[at]
        end = begin + length
        changed = self.pairs(np.concatenate([begin, end]))
        before = self.keys(changed)
        self.sym[at] = INSIDE
        self.sym[begin] = token
        self.span[begin] = self.span[end - 1] = length
        return changed, before, self.keys(changed)

    def around(self, token: int) -> np.ndarray:
        at = np.flatnonzero(self.sym == token)
        return self.pairs(np.concatenate([at, at + self.span[at]]))


def learned(words: Words, tasks: Alone | Together, n_merges: int) -> list[tuple[str, str]]:
    """The ``n_merges`` most frequent pairs one after the other; of equally frequent ones the smaller pair. The same in all tasks."""
    names = list(alphabet()[b] for b in range(256))
    ids, by_name = {x: i for i, x in enumerate(names)}, sorted(names)
    rank = np.zeros(words.base, np.int64)
    for i, x in enumerate(by_name):
        rank[ids[x]] = i
    keys = counts = np.zeros(0, np.int64)
    least, merges = 1 << 62, []

    def index(kept: np.ndarray, pairs: np.ndarray, first: np.ndarray, at: np.ndarray) -> None:
        """Note the places of the pairs that are ``kept``; ``at`` has those of ``pairs[i]`` from ``first[i]`` on."""
        ends = np.append(first[1:], len(at))
        for i in np.flatnonzero(places(kept, pairs)[1]).tolist():
            words.index.setdefault(int(pairs[i]), []).append(at[first[i] : ends[i]])

    while len(merges) < n_merges:
        if not len(keys):
            if least == 1:
                break
            words.index.clear()
            mine, n, found = words.count()
            top = int(tasks.add(np.zeros(1, np.int64), np.array([n.max(initial=0)]))[1][0])
            least = max(1, min(least, top) // STEP)
            many = mine[n >= -(-least // tasks.n)]  # a pair that has ``least`` has this in a task
            union, _ = tasks.add(many, np.zeros_like(many))
            at, there = places(mine, union)
            have = np.zeros(len(union), np.int64)
            have[there] = n[at[there]]
            keys, counts = tasks.add(union, have)
            keys, counts = keys[counts >= least], counts[counts >= least]
            for pairs, _, first, at in found:
                index(keys, pairs, first, at)
            del found
            continue
        best = np.flatnonzero(counts == counts.max())
        if len(best) > 1:
            best = best[[np.argmin(rank[keys[best] // words.base] * words.base + rank[keys[best] % words.base])]]
        key = int(keys[best[0]])
        pair = tuple(names[i] for i in divmod(key, words.base))
        merges.append(pair)
        name = "".join(pair)
        is_new = name not in ids
        if is_new:
            ids[name] = len(names)
            names.append(name)
            i = bisect_left(by_name, name)
            by_name.insert(i, name)
            rank[rank >= i] += 1
            rank[ids[name]] = i
        token = ids[name]
        changed, before, after = words.merge(key, token)
        there = places(keys, before)[1]
        changed, before, after = changed[there], before[there], after[there]
        n = words.weight(changed)
        if is_new:
            total, n = tasks.add(np.concatenate([before, after]), np.concatenate([-n, n]))
        else:  # a token made another way before: its pairs may get more frequent, so they are counted anew
            total, n = tasks.add(before, -n)
        at, there = places(keys, total)
        counts = counts.copy()
        counts[at[there]] += n[there]
        more, n_more = total[~there], n[~there]
        stay = (counts >= least) & (keys != key)
        if not is_new:
            stay &= (keys // words.base != token) & (keys % words.base != token)
            changed = words.around(token)
            after = words.keys(changed)
            more, n_more = tasks.add(after, words.weight(changed))
        for k in keys[~stay].tolist():
            words.index.pop(k, None)
        keys, counts = keys[stay], counts[stay]
        more, n_more = more[n_more >= least], n_more[n_more >= least]
        if len(more):
            at = np.searchsorted(keys, more)
            keys, counts = np.insert(keys, at, more), np.insert(counts, at, n_more)
            pairs, order, first = grouped(after)
            index(more, pairs, first, changed[order].astype(words.kind))
    return merges


def from_words(words: Iterable[tuple[str, int]], n_merges: int) -> list[tuple[str, str]]:
    pairs = [(w.encode(), n) for w, n in words]
    data = np.frombuffer(b"".join(w for w, _ in pairs), np.uint8)
    batches = [(data, np.array([len(w) for w, _ in pairs]), np.array([n for _, n in pairs]))] if pairs else []
    return learned(Words(batches, n_merges), Alone(), n_merges)


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    token = batch.column(0).cast(pa.large_binary())
    ends = np.frombuffer(token.buffers()[1], np.int64)[token.offset : token.offset + len(token) + 1]
    data = np.frombuffer(token.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return data, np.diff(ends), batch.column(1).to_numpy()


def slots(spark) -> int:
    """Tasks that run at a time, as Spark counts them for a barrier stage."""
    context = spark.sparkContext._jsc.sc()
    return max(1, context.maxNumConcurrentTasks(context.resourceProfileManager().defaultResourceProfile()))


def from_counts(counts: DataFrame, n_merges: int) -> list[tuple[str, str]]:
    """Merges of a table ``token, n`` of distinct words."""
    secret = secrets.token_bytes(32)

    def run(batches):
        from pyspark import BarrierTaskContext

        context = BarrierTaskContext.get()
        words = Words((_arrays(b) for b in batches if b.num_rows), n_merges)
        merges = learned(words, Together(context, secret), n_merges)
        if context.partitionId() == 0:
            columns = [pa.array(range(len(merges)), pa.int32()), *[pa.array([m[i] for m in merges], pa.string()) for i in (0, 1)]]
            yield pa.RecordBatch.from_arrays(columns, names=["rank", "left", "right"])

    rows = counts.select("token", "n").repartition(slots(counts.sparkSession))
    return [(r.left, r.right) for r in sorted(rows.mapInArrow(run, "rank int, left string, right string", barrier=True).collect())]
