"""Answers on request: a bounded cache, a pace that learns its limit, profiles of requests, a deadline, HTTP.

A batch needs none of this (Spark retries tasks, and rows that are equal are dropped before the work); it is for calls to
services outside, and for a service of one's own.
"""

from __future__ import annotations

import hashlib
import json
import threading
import time
from collections import OrderedDict
from collections.abc import Callable, Iterable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

# Faults that may pass when a call is made again, and the fields of a response.
PASSING = ("ReadTimeout", "ConnectTimeout", "Timeout", "ConnectionError", "ChunkedEncodingError")
PASSING_STATUS = ("HTTP 5", "HTTP 429")
RESPONSE = ("question_id", "question", "retrieved_context", "think_trace", "answer")


def may_pass(fault: BaseException) -> bool:
    """Whether a call is worth making again: time-outs, lost connections, a service's own faults, too many requests."""
    return type(fault).__name__ in PASSING or any(s in str(fault) for s in PASSING_STATUS)


class Responses:
    """The responses asked for last, by id and question (without blanks around it), so that an id that comes with another
    question gets no stale answer."""

    def __init__(self, most: int = 512):
        self._most, self._held, self._lock = most, OrderedDict(), threading.Lock()

    @staticmethod
    def key(question_id: str | None, question: str | None) -> tuple[str, str]:
        return str(question_id or ""), hashlib.sha1((question or "").strip().encode()).hexdigest()

    def get(self, key: tuple[str, str]) -> dict | None:
        with self._lock:
            found = self._held.pop(key, None)
            if found is not None:
                self._held[key] = found
            return found

    def put(self, key: tuple[str, str], response: dict) -> None:
        with self._lock:
            self._held.pop(key, None)
            self._held[key] = response
            if len(self._held) > self._most:
                self._held.popitem(last=False)


class Pace:
    """The least time between calls. Being told of too many requests lengthens it by two fifths, to five seconds at most;
    every fifteen good calls on end shorten it by a fifth, to where it began."""

    SLOWER, SLOWEST, FASTER, STREAK = 1.4, 5.0, 0.8, 15

    def __init__(self, per_second: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.least = self.gap = 1 / max(per_second, 0.05)
        self._clock, self._sleep, self._lock = clock, sleep, threading.Lock()
        self._free, self._good = float("-inf"), 0

    def wait(self) -> None:
        """Returns when the next call may be made; threads get turns one gap apart."""
        with self._lock:
            turn = max(self._clock(), self._free)
            self._free = turn + self.gap
        if (rest := turn - self._clock()) > 0:
            self._sleep(rest)

    def told(self, good: bool) -> None:
        with self._lock:
            self._good = self._good + 1 if good else 0
            if not good:
                self.gap = min(self.gap * self.SLOWER, self.SLOWEST)
            elif self._good >= self.STREAK and self.gap > self.least:
                self.gap, self._good = max(self.gap * self.FASTER, self.least), 0


class Profiles:
    """Ways to make a request, of which a service takes one: tried in turn until one works, which then comes first. Another
    is tried only if the service minds the parameters; any other fault would meet them all."""

    def __init__(self, ways: dict[str, Callable], minds_parameters: Callable[[Exception], bool]):
        self._ways, self._minds, self.first = dict(ways), minds_parameters, None

    def call(self, *args):
        faults = []
        for name in sorted(self._ways, key=lambda n: n != self.first):
            try:
                out = self._ways[name](*args)
            except Exception as e:
                faults.append(f"{name}: {e}")
                if not self._minds(e):
                    raise RuntimeError("; ".join(faults)) from e
                continue
            self.first = name
            return out
        raise RuntimeError("; ".join(faults) or "no way to make the request")


def first_working(targets: Iterable, embed: Callable) -> tuple | None:
    """(target, length of its vector) of the first target from which embed gets a vector of numbers; null if none."""
    for target in targets:
        try:
            vector = [float(x) for x in embed(target)]
        except Exception:  # noqa: BLE001, S112  a probe's fault is its result
            continue
        if vector:
            return target, len(vector)
    return None


def within(steps: Iterable[Callable[[dict], dict]], state: dict, fallback: Callable[[dict], str], seconds: float = 240, clock: Callable[[], float] = time.monotonic) -> dict:
    """The state after every step. No step begins past the deadline; the answer then is what there is, or the fallback's."""
    end = clock() + seconds
    for step in steps:
        if clock() > end:
            late = {**state, "trace": [*state.get("trace", []), f"stopped after {seconds:g} s"]}
            return late if late.get("answer") else {**late, "answer": fallback(late)}
        state = step(state)
    return state


def respond(ask: Callable[[str, str], dict], question: str, question_id: str, sorry: str) -> dict:
    """RESPONSE as strings, whatever ask does: a response of the wrong form costs more than one that says sorry."""
    try:
        got = ask(question, question_id)
    except Exception as e:  # noqa: BLE001
        got = {"think_trace": f"{type(e).__name__}: {e}", "answer": sorry}
    return {f: str(got.get(f) or "") for f in RESPONSE} | {"question_id": question_id, "question": question}


def server(ask: Callable[[str, str], dict], port: int = 8000, host: str = "127.0.0.1", sorry: str = "", responses: Responses | None = None) -> ThreadingHTTPServer:
    """GET /answer?question=&question_id= and /health, both JSON; a call of serve_forever starts it. Responses whose ask
    failed are not kept."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            url = urlsplit(self.path)
            given = {k: v[-1] for k, v in parse_qs(url.query, keep_blank_values=True).items()}
            if url.path == "/health":
                self._send(200, {"status": "ok"})
            elif url.path != "/answer":
                self._send(404, {"detail": "not found"})
            elif "question" not in given:
                self._send(422, {"detail": "question is required"})
            else:
                self._send(200, self._answer(given["question"], given.get("question_id", "")))

        def _answer(self, question: str, question_id: str) -> dict:
            key = Responses.key(question_id, question)
            kept = responses.get(key) if responses else None
            if kept is not None:
                return kept | {"question_id": question_id, "question": question}
            failed = []

            def once(q, i):
                try:
                    return ask(q, i)
                except Exception:
                    failed.append(True)
                    raise

            out = respond(once, question, question_id, sorry)
            if responses and not failed:
                responses.put(key, out)
            return out

        def _send(self, status: int, body: dict) -> None:
            data = json.dumps(body, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args):
            pass

    return ThreadingHTTPServer((host, port), Handler)


class Breaker:
    """Whether a failed call may be made again: not after so many time-outs on end, nor with too little time left. A call
    that gives an answer closes it."""

    def __init__(self, threshold: int = 2, least_seconds: float = 40):
        self._threshold, self._least, self._lock, self._missed = threshold, least_seconds, threading.Lock(), 0

    def told(self, timed_out: bool) -> None:
        with self._lock:
            self._missed = self._missed + 1 if timed_out else 0

    def allows(self, seconds_left: float) -> bool:
        with self._lock:
            return self._missed < self._threshold and seconds_left >= self._least
