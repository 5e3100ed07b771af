"""State of the streaming operators: T1 + T4 lines, T5 final responses, T6 page visits in order.

Each is a ``StatefulProcessor`` (state in RocksDB, snapshots in the query's checkpoint). Responses go
through ``transformWithState``, row by row: a pandas frame for each key and micro-batch costs more than
its few rows. Visits go through ``transformWithStateInPandas``. A key's variables are read and written once per micro-batch.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LINE_SCHEMA = "request_id string, service string, line_no long, line string, kind string"
HEAD_SCHEMA = "service string, next_seq int, next_line long, carry binary, early binary"
_LINE = Row("request_id", "service", "line_no", "line", "kind")
#: one early chunk in the state: its number, whether it is the last, the length of its payload, the payload
_CHUNK = "<i?I"


def packed(early: dict[int, tuple[bytes, bool]]) -> bytes:
    """Early chunks as one value: a list of structs would be converted element by element on every write."""
    parts = []
    for seq in sorted(early):
        payload, last = early[seq]
        parts += (struct.pack(_CHUNK, seq, last, len(payload)), payload)
    return b"".join(parts)


def unpacked(value: bytes) -> dict[int, tuple[bytes, bool]]:
    out, at, head = {}, 0, struct.calcsize(_CHUNK)
    while at < len(value):
        seq, last, size = struct.unpack_from(_CHUNK, value, at)
        at += head
        out[seq] = (value[at:at + size], last)
        at += size
    return out


class LineAssembler(StatefulProcessor):
    """T1 + T4: the chunks of one response -> complete lines, then one ``done`` or ``abandoned`` row.

    ``head`` holds an open response: the next chunk wanted, chunks that came early, the unfinished
    line. When the last chunk has been consumed it goes, and ``closed`` stays behind so that chunks
    delivered again are ignored; with ``marker_ttl_ms`` Spark drops it after that time. With
    ``timeout_ms`` a timer runs from the response's latest chunk on; when it ends, the response
    closes as ``abandoned``.
    """

    def __init__(self, flush_tail: bool = False, timeout_ms: int | None = None, marker_ttl_ms: int | None = None):
        self.flush_tail, self.timeout_ms, self.marker_ttl_ms = flush_tail, timeout_ms, marker_ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", HEAD_SCHEMA)
        self.closed = (handle.getValueState("closed", "next_line long", ttlDurationMs=self.marker_ttl_ms)
                       if self.marker_ttl_ms else handle.getValueState("closed", "next_line long"))

    def _rows(self, key, service, items) -> Iterator[Row]:
        return (_LINE(key[0], service, *i) for i in items)

    def _stop_timers(self) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        chunks = [(r["seq"], r["payload"], r["is_last"], r["service"]) for r in rows]
        head = self.head.get()
        if head is not None:
            service, next_seq, next_line, carry, held = head
            early, carry = unpacked(bytes(held or b"")), bytes(carry or b"")
        elif self.closed.exists():
            return
        else:
            service, next_seq, next_line, carry, early = None, 0, 0, b"", {}
        for seq, payload, last, named in chunks:
            if seq >= next_seq:      # else delivered again
                early[seq] = (bytes(payload) if payload is not None else b"", bool(last))
                service = service or named
        out, done = [], False
        while next_seq in early and not done:
            payload, done = early.pop(next_seq)
            next_seq += 1
            *complete, carry = (carry + payload).split(b"\n")
            if done and self.flush_tail and carry:
                complete.append(carry)
            for piece in complete:
                out.append((next_line, piece.decode("utf-8", errors="replace"), "line"))
                next_line += 1
        if done:
            out.append((next_line, None, "done"))
            self.head.clear()
            self.closed.update((next_line,))
        else:
            self.head.update((service, next_seq, next_line, carry, packed(early)))
        if self.timeout_ms:
            self._stop_timers()
            if not done:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms)
        yield from self._rows(key, service, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        head = self.head.get()
        if head is not None:
            service, _, next_line, *_ = head
            self.head.clear()
            self.closed.update((next_line,))
            yield from self._rows(key, service, [(next_line, None, "abandoned")])

    def close(self) -> None:
        pass


RESPONSE_SCHEMA = "request_id string, content string, n_deltas long, n_malformed long, status string"
_RESPONSE = Row("request_id", "content", "n_deltas", "n_malformed", "status")


class ResponseAccumulator(StatefulProcessor):
    """T5: the delta rows of one response -> one row with its whole text when it ends.

    The text grows as a list of the pieces of each micro-batch: a batch appends and never rewrites
    what is there. Lines reach a batch complete and numbered (T1), so sorting the rows of one batch
    by number keeps the order over all of them.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pieces = handle.getListState("pieces", "text string")
        self.counts = handle.getValueState("counts", "n_deltas long, n_malformed long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        got = sorted(((r["line_no"], r["kind"], r["content"]) for r in rows), key=lambda r: r[0])
        deltas = [text for _, kind, text in got if kind == "delta"]
        n_deltas, n_malformed = self.counts.get() or (0, 0)
        n_deltas, n_malformed = n_deltas + len(deltas), n_malformed + sum(kind == "malformed" for _, kind, _ in got)
        ended = [kind for _, kind, _ in got if kind in ("done", "abandoned")]
        if not ended:
            if deltas:
                self.pieces.appendList([("".join(deltas),)])
            self.counts.update((n_deltas, n_malformed))
            return
        text = "".join([p[0] for p in self.pieces.get()] + deltas)
        self.pieces.clear()
        self.counts.clear()
        yield _RESPONSE(key[0], text, n_deltas, n_malformed, ended[0])

    def close(self) -> None:
        pass


VISIT_COLUMNS = ["seq", "ts_us", "url", "path", "owner", "repo", "pr_number"]
VISIT_SCHEMA = ("tab_id long, page_load_id long, seq long, ts_us long, url string, path string, owner string, repo string, "
                "pr_number string, error_code string")
PENDING_SCHEMA = "seq long, ts_us long, url string, path string, owner string, repo string, pr_number string"
LATE, NO_TIME = "LATE_VISIT", "NO_VISIT_TIME"


class VisitOrder(StatefulProcessor):
    """The PR visits of one page session, in any order within the watermark's delay -> changes of path.

    Visits wait in ``pending``. A timer at the earliest of them fires once the watermark has passed
    it; then all waiting visits up to the watermark leave in (ts, seq) order and each is kept if its
    path is not the last one released. A visit that comes before one already released is not
    guessed at: it leaves at once as an error row.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", PENDING_SCHEMA)
        self.released = handle.getValueState("released", "path string, ts_us long, seq long")
        self.due = handle.getValueState("due", "at long")

    def _out(self, key, visits, error: str | None) -> pd.DataFrame:
        # plain lists: casting and inserting columns costs a millisecond per session and batch
        columns = {"tab_id": [key[0]] * len(visits), "page_load_id": [key[1]] * len(visits)}
        columns |= {c: list(values) for c, values in zip(VISIT_COLUMNS, zip(*visits))}
        return pd.DataFrame(columns | {"error_code": [error] * len(visits)})

    def _wait_for(self, ts_us: int, running: bool = True) -> None:
        """A timer at ``ts_us``; ``running``: another may be set."""
        at = -(-ts_us // 1000)
        before = self.due.get() if running else None
        if before is not None:
            if before[0] <= at:
                return
            self.handle.deleteTimer(before[0])
        self.handle.registerTimer(at)
        self.due.update((at,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = self.released.get()
        wait, late, timeless = [], [], []
        for pdf in rows:
            for seq, ts_us, *text in zip(*(pdf[c].tolist() for c in VISIT_COLUMNS)):
                at = None if ts_us is None or ts_us != ts_us else int(ts_us)      # a column with nulls comes as floats
                visit = (int(seq), at, *text)
                if at is None:
                    timeless.append(visit)
                elif last is not None and (at, visit[0]) <= (last[1], last[2]):
                    late.append(visit)
                else:
                    wait.append(visit)
        if wait:
            self.pending.appendList(wait)
            self._wait_for(min(v[1] for v in wait))
        for visits, error in ((late, LATE), (timeless, NO_TIME)):
            if visits:
                yield self._out(key, visits, error)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = {(v[1], v[0]): tuple(v) for v in self.pending.get()}      # a visit delivered twice counts once
        ready = sorted(k for k in waiting if k[0] <= passed)
        rest = [v for k, v in waiting.items() if k[0] > passed]
        if rest:
            self.pending.put(rest)
            self._wait_for(min(v[1] for v in rest), running=False)
        else:
            self.due.clear()
            self.pending.clear()
        path = (self.released.get() or (None,))[0]
        changes = []
        for k in ready:
            if waiting[k][3] != path:
                changes.append(waiting[k])
                path = waiting[k][3]
        if ready:
            self.released.update((path, *ready[-1]))
        if changes:
            yield self._out(key, changes, None)

    def close(self) -> None:
        pass
