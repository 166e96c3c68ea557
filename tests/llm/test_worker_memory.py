"""What Python workers hold: a bounded number of rows at once, and little between tasks."""

import os
import subprocess
import sys

import numpy as np
import pyarrow as pa

from vellumite.llm import packing

HELD = """
import re, sys
import pyarrow as pa
from vellumite.llm import common

def held():
    return sum(map(int, re.findall(r"Pss_Anon: +([0-9]+)", open("/proc/self/smaps_rollup").read()))) / 1024

def made(batches):
    texts = []
    for b in batches:
        texts.append([b"x" * 100_000 for _ in range(2000)])
        texts.append([pa.array([b"y" * 100_000]) for _ in range(1000)])
        kept.append(b"z" * 100_000)  # lies behind them, so that the C library can't just shorten its heap
        yield b

kept = []
before = held()
for _ in getattr(common, "lean", iter)(made([1])):
    most = held()
print(before, most, held())
"""


def test_memory_of_ended_tasks_is_given_back():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    said = subprocess.run([sys.executable, "-c", HELD], capture_output=True, text=True, check=True, env=os.environ | {"PYTHONPATH": root}, cwd=root)
    before, most, after = map(float, said.stdout.split())
    assert most - before > 250 and after - before < 60


def test_pieces_are_cut_some_units_at_once():
    sizes = np.arange(1, 1001) % 700 + 1
    ids = [np.arange(n, dtype="<u2").tobytes() for n in sizes]
    at = np.cumsum(sizes) - sizes
    names = {"_id": range(1000), "_source": ["s"] * 1000, "_n": sizes, "_ids": ids, "_start": [0] * 1000, "_doc": sizes, "_at": at}
    whole = pa.RecordBatch.from_pydict({k: pa.array(v if k == "_ids" else list(v)) for k, v in names.items()})
    made = list(packing.cut(iter([whole]), 2048, 100))
    assert len(made) == 10 and all(b.num_rows <= 200 for b in made)
    rows = [r for b in made for r in b.to_pylist()]
    assert sum(r["length"] for r in rows) == sizes.sum()
    for r in rows:
        want = np.arange(r["start"], r["start"] + r["length"], dtype="<u4").tobytes()
        assert r["ids"] == want and r["sequence_id"] * 2048 + r["offset"] == at[r["_id"]] + r["start"] and r["offset"] + r["length"] <= 2048
