import os
import random
import subprocess
import sys

import numpy as np
import pytest

from strandline.llm import inducing


def brute(text, cap):
    t = list(text)
    order = sorted(range(len(t)), key=lambda i: t[i:])
    common = [0]
    for a, b in zip(order, order[1:]):
        n = 0
        while n < cap and a + n < len(t) and b + n < len(t) and t[a + n] == t[b + n]:
            n += 1
        common.append(n)
    return order, common


@pytest.mark.parametrize("held", [7, 400_000])
def test_against_sorting(tmp_path, held):
    rnd = random.Random(1)
    for trial in range(150):
        n, sigma = rnd.randint(0, 60), rnd.choice([1, 2, 3, 20])
        body = [rnd.randint(1, sigma) for _ in range(n)]
        if trial % 3 == 0:
            body = body[: n // 3] * 3
        text = np.array([*body, 0], np.int16)
        cap = rnd.choice([2, 5, 100])
        got = inducing.induced(text, cap, str(tmp_path), held)
        assert (got[:, 0].tolist(), got[:, 1].tolist()) == brute(text, cap), (body, cap)


@pytest.mark.parametrize("held", [50, 400_000])
def test_repeated_windows(held):
    rnd = random.Random(2)
    for _ in range(30):
        source = bytes(rnd.choice(b"abcd") for _ in range(60))
        segments = []
        for i in range(rnd.randint(0, 8)):
            a = rnd.randint(0, 50)
            segments.append((rnd.randint(0, 4), 100 * i, source[a : a + rnd.randint(0, 40)] + bytes(rnd.choice(b"ab") for _ in range(3))))
        seen = {}
        for s, (o, st, raw) in enumerate(segments):
            for p in range(len(raw) - 9):
                seen.setdefault(raw[p : p + 10], []).append(((o, st + p), s, p))
        want = sorted((s, p) for v in seen.values() for at, s, p in v if at != min(v)[0])
        got = sorted((int(s), int(p)) for a, b in inducing.repeated_windows(((o, st, np.frombuffer(raw, np.uint8)) for o, st, raw in segments), 10, held=held) for s, p in zip(a, b))
        assert got == want


def test_classes_over_many_blocks():
    """More equal windows than a block has, at few and many places."""
    word = np.arange(12)
    segments = [(i % 700, 5 * (i % 3), np.concatenate([word, [50 + i % 90]])) for i in range(3_000)]
    seen = {}
    for s, (o, st, raw) in enumerate(segments):
        for p in range(len(raw) - 9):
            seen.setdefault(tuple(raw[p : p + 10]), []).append(((o, st + p), s, p))
    want = sorted((s, p) for v in seen.values() for at, s, p in v if at != min(v)[0])
    got = sorted((int(s), int(p)) for a, b in inducing.repeated_windows(iter(segments), 10, held=64) for s, p in zip(a, b))
    assert got == want


def test_queue_of_many_runs(tmp_path):
    rnd = random.Random(3)
    queue, plain, out, want = inducing.DiskQueue(str(tmp_path), 4), [], [], []
    for step in range(5_000):
        if plain and rnd.random() < 0.4:
            out.append(queue.pop())
            plain.sort()
            want.append(plain.pop(0))
        else:
            entry = (rnd.randint(0, 50), step, rnd.randint(0, 9), 1)
            queue.push(entry)
            plain.append(entry)
    while plain:
        plain.sort()
        want.append(plain.pop(0))
        out.append(queue.pop())
    assert out == want and queue.peek() is None and len(queue.open) <= inducing.FAN * 6


MEMORY = """
import re, sys, threading, time
import numpy as np
from strandline.llm import inducing
n, peak, on = int(sys.argv[1]), [0], True
rnd = np.random.default_rng(1)
anon = lambda: int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1])
def segments():
    base, done = rnd.integers(0, 200, 5000), 0
    while done < n:
        a, k = rnd.integers(0, 4900), int(rnd.integers(10, 90))
        done += k + 5
        yield int(rnd.integers(0, 1000)), int(rnd.integers(0, 1 << 20)), np.concatenate([base[a : a + k], rnd.integers(0, 200, 5)])
def watch():
    while on:
        peak[0] = max(peak[0], anon())
        time.sleep(0.01)
for _ in inducing.repeated_windows(iter([(0, 0, np.arange(50))] * 100), 8, held=1000): pass
start = anon()
threading.Thread(target=watch, daemon=True).start()
for _ in inducing.repeated_windows(segments(), 8, held=1000): pass
print(peak[0] - start)
"""


def test_memory_does_not_grow_with_the_text():
    """At 1,000 rows held; the arrays of a sort in memory would take over 100 bytes a symbol, 30 MB more for the longer text."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    small, large = (int(subprocess.run([sys.executable, "-c", MEMORY, str(n)], capture_output=True, check=True, text=True, env=os.environ | {"PYTHONPATH": root}).stdout) for n in (60_000, 360_000))
    assert large < small + 3_000  # kB
