"""Small row-at-a-time models of the definitions, to check the plans against."""

from __future__ import annotations

import random

KEYS = ["KeyA", "KeyB", "ShiftLeft", "ShiftRight", "MetaLeft", "AltGr", "Return", "UNKNOWN"]
SHOWN = {
    "KeyA": "A", "KeyB": "B", "ShiftLeft": "Shift", "ShiftRight": "Shift", "MetaLeft": "Cmd",
    "AltGr": "AltGr", "Return": "Return",
}
MODIFIER = {"Shift", "Cmd", "AltGr"}


def random_log(seed: int, recordings: int = 12, rows: int = 60):
    """Rows (recording_id, ord, ts_us, etype, raw_key, button, dx, dy, uncaptured)."""
    rnd = random.Random(seed)
    kinds = ["KeyPress"] * 6 + ["KeyRelease"] * 5 + ["MousePress", "MouseRelease", "MouseScroll", "MouseScroll", "ContextChanged", "MouseMove"]
    out = []
    for rec in range(recordings):
        for ord_ in range(rows if rec else rows * 6):
            out.append(
                (
                    f"r{rec}", ord_, rnd.randrange(-100_000, 4_200_000) // 50_000 * 50_000, rnd.choice(kinds),
                    rnd.choice(KEYS), rnd.choice(["Left", "Right", "Back"]), float(rnd.randrange(-1, 2)),
                    float(rnd.randrange(-2, 3)), rnd.random() < 0.7,
                )
            )
    return out


def _walk(rows, frame_of, lowest, highest):
    """Held spans and scroll ticks of one recording, event by event."""
    down: dict = {}
    mods: set = set()
    spans, ticks, last = [], [], 0

    def close(device, frame):
        spans.append((device, *down.pop(device), frame))

    for _, _, ts, etype, raw, button, dx, dy, uncaptured in sorted(rows, key=lambda r: (r[2], r[1])):
        frame = frame_of(ts)
        if frame < lowest or (highest is not None and frame >= highest):
            continue
        last = max(last, frame)
        name = SHOWN.get(raw)
        if etype == "ContextChanged" and uncaptured:
            for device in list(down):
                close(device, frame)
            mods.clear()
        elif etype in ("KeyPress", "KeyRelease") and name:
            pressed = etype == "KeyPress"
            if name in MODIFIER:
                (mods.add if pressed else mods.discard)(name)
            elif pressed and ("key", name) not in down:
                text = "+".join([m for m in ("Cmd", "Shift") if m in mods] + [name])
                down["key", name] = (frame, text)
            elif not pressed and ("key", name) in down:
                close(("key", name), frame)
        elif etype in ("MousePress", "MouseRelease") and button != "Back":
            if etype == "MousePress" and ("button", button) not in down:
                down["button", button] = (frame, button)
            elif etype == "MouseRelease" and ("button", button) in down:
                close(("button", button), frame)
        elif etype == "MouseScroll":
            ticks.append((frame, dx, dy))
    return spans, down, ticks, last


def training_actions(log, fps, num_frames):
    """Multiset of (recording, frame, type, details)."""
    out = []
    for rec in sorted({r[0] for r in log}):
        rows = [r for r in log if r[0] == rec]
        spans, down, ticks, _ = _walk(rows, lambda ts: ts * fps // 1_000_000, 0, num_frames)
        spans += [(device, start, text, num_frames - 1) for device, (start, text) in down.items()]
        for (kind, _), start, text, end in spans:
            if kind == "key":
                out += [(rec, f, "KeyPress", text) for f in range(start, max(end, start + 1))]
            else:
                out.append((rec, start, "MouseClick", text))
        moved: dict = {}
        for frame, dx, dy in ticks:
            delta = dy or dx
            if delta:
                moved[frame] = moved.get(frame, 0) + delta
        gesture: list = []
        for frame in sorted(moved) + [10**9]:
            if gesture and frame > gesture[-1] + 1:
                net = sum(moved[f] for f in gesture)
                if net:
                    out.append((rec, gesture[0], "MouseScroll", "down" if net < 0 else "up"))
                gesture = []
            gesture.append(frame)
    return sorted(out)


def truth_actions(log, start_s, fps):
    out = []
    for rec in sorted({r[0] for r in log}):
        rows = [r for r in log if r[0] == rec]
        at = lambda ts: round((ts - start_s * 1e6) / 1e6 * fps)
        spans, down, ticks, last = _walk(rows, at, 0, None)
        spans += [(device, start, text, last) for device, (start, text) in down.items()]
        acts = []
        for (kind, _), start, text, end in spans:
            if kind == "key":
                acts += [(f, "KeyPress", text) for f in range(start, max(end, start + 1))]
            else:
                acts.append((start, "MouseClick", text))
        acts += [(f, "MouseScroll", "down" if dy < 0 else "up") for f, _, dy in ticks if dy]
        out += [(rec, *a) for a in sorted(acts, key=lambda a: a[:2])]
    return out


def merged(actions, gap=1):
    """Scrolls and clicks of one list with repeats removed; order inside a frame matters."""
    out = [a for a in actions if a[1] == "KeyPress"]
    for kind in ("MouseScroll", "MouseClick"):
        before = None
        for a in sorted((a for a in actions if a[1] == kind), key=lambda a: a[0]):
            if before is None or a[0] - before[0] > gap or a[2] != before[2]:
                out.append(a)
            before = a
    return sorted(out)


def greedy(truth, preds, tolerance):
    """Pairs (truth frame, prediction frame) of (frame, type, detail) lists in their order."""
    free = list(range(len(preds)))
    pairs = []
    for frame, kind, detail in truth:
        best = None
        for j in free:
            d = abs(preds[j][0] - frame)
            if preds[j][1:] == (kind, detail) and d <= tolerance and (best is None or d < best[0]):
                best = (d, j)
        if best:
            free.remove(best[1])
            pairs.append((frame, preds[best[1]][0], kind, detail))
    return sorted(pairs)
