"""The engine's sequential processors: live regions, previews, the relay's states and connectivity."""

from __future__ import annotations

from attestra.operators.queue import ACTIVE, LEAST_RATE, MAX_ATTEMPTS
from attestra.streaming.folds import Processor

#: Fixed values of the live detector: probabilities, and lengths in frames of 512 samples at 16 kHz.
ENTER, EXIT = 0.3, 0.1
FRAME_MS = 32.0
#: Fixed values of a capture: the silence after which it counts as stalled, and the largest chunk that is stored.
STALL_MS, CHUNK_BYTES = 30_000, 10_000_000


def live_regions(refresh: int = 13, commit: int = 25, least: int = 469, cap: int = 938, speech: int = 8, pad: int = 6) -> Processor:
    """Frames (frame, p) to refreshes and commits of regions; lengths in frames.

    A region that reaches the cap is committed before the next frame. Within speech, silence of `refresh` frames asks for a refresh, and silence of `commit` frames commits a region that has speech and length enough. A frame without p closes the stream: what is held and has speech is given as a drain, and the next frame begins anew.
    """

    def emit(kind: str, s: dict) -> dict:
        first, last = (s["first"], s["last"]) if s["first"] >= 0 else (0, s["n"] - 1)
        begin, end = max(0, first - pad), min(s["n"], last + 1 + pad)
        return {"kind": kind, "start": s["start"], "end": s["start"] + s["n"], "speech_start": s["start"] + begin, "speech_end": s["start"] + end}

    def fresh(s: dict, at: int) -> None:
        s.update(start=at, n=0, speech=0, silence=0, inside=False, first=-1, last=-1)

    def step(s: dict, event: dict) -> list[dict]:
        out, at, p = [], int(event["frame"]), event["p"]
        if p is None or p != p:
            out = [emit("drain", s)] if s["first"] >= 0 else []
            fresh(s, -1)
            return out
        if s["start"] < 0:
            fresh(s, at)
        if s["n"] >= cap:
            out.append(emit("commit", s))
            fresh(s, at)
        s["n"] += 1
        here = s["n"] - 1
        if not s["inside"]:
            if p >= ENTER:
                s.update(inside=True, silence=0, speech=s["speech"] + 1, first=here if s["first"] < 0 else s["first"], last=here)
        elif p >= EXIT:
            s.update(silence=0, speech=s["speech"] + 1, last=here)
        else:
            s["silence"] += 1
            if s["silence"] >= commit:
                if s["speech"] >= speech and s["n"] >= least:
                    out.append(emit("commit", s))
                    fresh(s, at + 1)
            elif s["silence"] == refresh and s["speech"] >= speech:
                out.append(emit("refresh", s))
        return out

    start = {"start": -1, "n": 0, "speech": 0, "silence": 0, "inside": False, "first": -1, "last": -1}
    return Processor(start, step, "kind string, start long, end long, speech_start long, speech_end long")


def live_session() -> Processor:
    """What a live session sends, from opened, refresh, commit and close (each with the start and end of its audio; a close with nothing left has none, end <= start) and done or failed, the end of the transcription that runs.

    Transcriptions run one after the other in the order in which they were asked for. While a refresh waits or runs, further ones are dropped; while a commit waits or runs, the audio of further ones is joined, so that none is lost and one at most waits. A close transcribes what is left as the last commit and then ends the session; one that comes before the session is open ends it as soon as it opens. Outside a session nothing else counts.
    """

    def idle(s: dict) -> None:
        s.update(open=False, leaves=False, refresh=False, commit=False, pending=None, jobs=[])

    def step(s: dict, event: dict) -> list[dict]:
        kind, span = event["event"], [int(event["start"]), int(event["end"])]
        told = lambda k, x=(None, None): {"kind": k, "start": x[0], "end": x[1]}
        if not s["open"]:
            leaves = s["leaves"]
            if kind == "opened":
                s.update(open=not leaves, leaves=False)
                return [told("opened"), told("closed")] if leaves else [told("opened")]
            s["leaves"] = leaves or kind == "close"
            return []
        out = []
        if kind == "close" and span[1] <= span[0]:
            idle(s)
            return [told("closed")]
        if kind == "close":
            s["jobs"].append(["close", *span])
        elif kind == "refresh" and not s["refresh"]:
            s["refresh"] = True
            s["jobs"].append(["tail", *span])
        elif kind == "commit" and s["commit"]:
            s["pending"] = [s["pending"][0] if s["pending"] else span[0], span[1]]
        elif kind == "commit":
            s["commit"] = True
            s["jobs"].append(["commit", *span])
        elif kind in ("done", "failed") and s["jobs"]:
            what, *at = s["jobs"].pop(0)
            out.append(told("error" if kind == "failed" else "tail" if what == "tail" else "commit", at))
            if what == "close":
                idle(s)
                return [*out, told("closed")]
            if what == "tail":
                s["refresh"] = False
            elif s["pending"]:
                s["jobs"].append(["commit", *s["pending"]])
                s["pending"] = None
            else:
                s["commit"] = False
            if s["pending"] and s["jobs"] and s["jobs"][0][0] == "commit":  # begins now, with what has come since it was asked for
                s["jobs"][0][2], s["pending"] = s["pending"][1], None
        return out

    start = {"open": False, "leaves": False, "refresh": False, "commit": False, "pending": None, "jobs": []}
    return Processor(start, step, "kind string, start long, end long")


def capture(stall_ms: int = STALL_MS, most: int = CHUNK_BYTES) -> Processor:
    """Chunks of a recording as they are stored, and its health, from begin, blob (n_bytes), resumed, tick and close.

    Blobs are numbered in order and stored in slices of at most `most` bytes, an empty one as one slice. A gap over stall_ms before a blob or a tick makes the capture stalled for good; a resumption begins the count anew, and the first blob after it is never late. After a close nothing counts.
    """

    def step(s: dict, event: dict) -> list[dict]:
        kind, now, out = event["event"], int(event["at_ms"]), []
        if s["closed"]:
            return []
        late = s["last"] >= 0 and now - s["last"] > stall_ms
        if late and not s["stalled"] and (kind == "tick" or kind == "blob" and not s["resumed"]):
            s["stalled"] = True
            out.append({"at_ms": now, "chunk": None, "slice": None, "n_bytes": None, "health": "stalled"})
        if kind == "blob":
            size, health = int(event["n_bytes"]), "stalled" if s["stalled"] else "flushing"
            out += [{"at_ms": now, "chunk": s["chunk"], "slice": k, "n_bytes": min(most, size - k * most), "health": health} for k in range(max(1, -(-size // most)))]
            s["chunk"] += 1
        s.update(closed=kind == "close", resumed=kind == "resumed" or s["resumed"] and kind != "blob", last=s["last"] if kind == "tick" and s["last"] >= 0 else now)
        return out

    return Processor({"last": -1, "resumed": False, "stalled": False, "closed": False, "chunk": 0}, step, "at_ms long, chunk long, slice long, n_bytes long, health string")


def previews(whole: bool = False) -> Processor:
    """Live text of an item: tails replace each other, a commit adds its text and clears the tail, a handoff ends it. What comes after, or for an older session, is ignored. An item that has been handed off rests.

    whole: each row shows all committed text, joined by spaces (a null adds nothing to it, but counts; nulls alone show a null), and the state holds it until the handoff. Otherwise a committed text is emitted once and not held: the state is a count and a tail.
    """

    def step(s: dict, event: dict) -> list[dict]:
        kind, text, session = event["event"], event["text"], int(event["session"])
        if s["done"] or session < s["session"]:
            return []
        s["session"], added = session, None
        if kind == "tail":
            s["tail"] = text
        elif kind == "commit":
            added = text or ""
            s.update(committed=s["committed"] + 1, tail=None)
            if whole and text is not None:
                s["texts"].append(text)
        elif kind == "handoff":
            s.update(done=True, committed=0, tail=None, **{"texts": []} if whole else {})
        shown = {"text": " ".join(s["texts"]) if s["texts"] or not s["committed"] else None} if whole else {"added": added}
        return [{"n_committed": s["committed"], **shown, "tail": s["tail"], "done": s["done"]}]

    start = {"session": 0, "done": False, "committed": 0, "tail": None, **({"texts": []} if whole else {})}
    return Processor(start, step, f"n_committed long, {'text' if whole else 'added'} string, tail string, done boolean", at_rest=lambda s: s["done"])


def relay(base_ms: float = 1000, cap_ms: float = 60_000) -> Processor:
    """An item's way through the queue: events enqueue, ok (with text), failed (terminal or not), review (accepted, edited or discarded) and reopen.

    An event that the item's state has no use for is ignored; so is an attempt before the item is due. The wait after a failure is the whole window of the attempts before it.
    """

    def step(s: dict, event: dict) -> list[dict]:
        kind, text, now = event["event"], event["text"], int(event["at_ms"])
        status = s["status"]
        if kind == "enqueue" and status is None:
            s.update(status="queued", duration=int(event["duration_ms"]))
        elif kind in ("ok", "failed") and status in ACTIVE:
            if now < s["due"]:
                return []
            doing = "transcribe" if s["transcript"] is None else "extract" if s["extracted"] is None else "write"
            if kind == "failed":
                n, wait = s["attempts"] + 1, min(cap_ms, base_ms * 2 ** min(s["attempts"], 32))
                final = bool(event["terminal"]) or n >= MAX_ATTEMPTS
                s.update(attempts=n, status="dead" if final else "failed", due=0 if final else int(now + wait))
            elif doing == "transcribe":
                thin = s["duration"] > 0 and len((text or "").strip()) * 1000 / s["duration"] < LEAST_RATE
                s.update(transcript=text or "", attempts=0, due=0, status="awaiting-review" if thin else "extracting")
            elif doing == "extract":
                s.update(extracted=text or "", attempts=0, due=0, status="awaiting-review")
            elif s["outcome"] in (None, "discarded"):
                s.update(status="dead")
            else:
                s.update(status="done", attempts=0, due=0)
        elif kind == "review" and status == "awaiting-review":
            s.update(outcome=text, attempts=0, status="discarded" if text == "discarded" else "writing")
        elif kind == "reopen" and status == "dead" and s["transcript"] is not None and s["extracted"] is not None:
            s.update(outcome=None, status="awaiting-review")
        else:
            return []
        return [{"at_ms": now, "status": s["status"], "attempts": s["attempts"], "due_ms": s["due"] or None}]

    start = {"status": None, "duration": 0, "transcript": None, "extracted": None, "outcome": None, "attempts": 0, "due": 0}
    return Processor(start, step, "at_ms long, status string, attempts int, due_ms long", at_rest=lambda s: s["status"] in ("done", "discarded"))


def connectivity(timeout_ms: int = 5000, stable_ms: int = 3000) -> Processor:
    """A device's status from what happens to it: up, down, probe_ok and probe_failed. A probe that takes too long has failed; only after a healthy time is a device online. An offline device rests."""

    def to(s: dict, status: str, at: int) -> list[dict]:
        if s["status"] == status:
            return []
        s["status"] = status
        return [{"at_ms": at, "status": status}]

    def due(s: dict) -> int | None:
        if s["status"] != "probing":
            return None
        return s["healthy"] + stable_ms if s["healthy"] >= 0 else s["since"] + timeout_ms

    def elapse(s: dict, now: int) -> list[dict]:
        at = due(s)
        return [] if at is None or now < at else to(s, "online" if s["healthy"] >= 0 else "offline", at)

    def step(s: dict, event: dict) -> list[dict]:
        now, kind = int(event["at_ms"]), event["event"]
        out = elapse(s, now)
        if kind == "down" or kind == "probe_failed" and s["status"] == "probing":
            out += to(s, "offline", now)
        elif kind == "up" and s["status"] == "offline":
            s.update(since=now, healthy=-1)
            out += to(s, "probing", now)
        elif kind == "probe_ok" and s["status"] == "probing" and s["healthy"] < 0:
            s["healthy"] = now
        return out

    return Processor({"status": "offline", "since": 0, "healthy": -1}, step, "at_ms long, status string", due, elapse, lambda s: s["status"] == "offline")


def agreement(n: int = 2) -> Processor:
    """Words that the last n hypotheses (text) of a stream begin with alike, as far as they go beyond what was committed."""

    def step(s: dict, event: dict) -> list[dict]:
        s["last"] = [*s["last"], (event["text"] or "").split()][-n:]
        if len(s["last"]) < n:
            return []
        same = 0
        while all(len(x) > same for x in s["last"]) and len({x[same] for x in s["last"]}) == 1:
            same += 1
        new = s["last"][-1][s["committed"] : same]
        s["committed"] = max(s["committed"], same)
        return [{"words": " ".join(new), "n_committed": s["committed"]}] if new else []

    return Processor({"last": [], "committed": 0}, step, "words string, n_committed long")


def reframed(size: int = 512) -> Processor:
    """Quanta of samples, in the stream's order, regrouped into frames of `size`: what does not fill a frame is held, under a frame's length, until more comes. A stream that has nothing held rests."""

    def step(s: dict, event: dict) -> list[dict]:
        held = [*s["held"], *(event["samples"] if event["samples"] is not None else ())]
        n = len(held) // size
        out = [{"frame": s["frame"] + k, "samples": held[k * size : (k + 1) * size]} for k in range(n)]
        s.update(frame=s["frame"] + n, held=[x.item() if hasattr(x, "item") else x for x in held[n * size :]])
        return out

    return Processor({"frame": 0, "held": []}, step, "frame long, samples array<double>")
