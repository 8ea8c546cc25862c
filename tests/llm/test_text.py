import re
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

from wavecohort.llm import text


def test_tables_made_on_the_driver_stay_there():
    a = np.arange(10, dtype=np.uint64)
    h = text.span_hashes(a, np.array([0, 2]), np.array([3, 5]))
    assert text._powers

    def run():
        return text.span_hashes(a, np.array([0, 2]), np.array([3, 5]))

    body = cloudpickle.dumps(run)
    assert len(body) < 100_000
    assert cloudpickle.loads(body)().tolist() == h.tolist()


def test_a_worker_gives_memory_back_after_a_task():
    def anonymous():
        return int(re.search(r"RssAnon:\s+(\d+)", Path("/proc/self/status").read_text())[1]) / 1024

    def run(batches):
        held = []
        for b in batches:
            held += [bytes(1000) for _ in range(200_000)]
            yield b
        keep.append(bytes(1000))  # on top of the heap, so that nothing below goes by itself

    def after(run):
        start = anonymous()
        for _ in run([pa.RecordBatch.from_pydict({"a": [1]})]):
            pass
        return anonymous() - start

    keep = []
    plain, trimmed = after(run), after(text.trimmed(run))
    assert plain > 100 and trimmed < 20 - plain / 2
