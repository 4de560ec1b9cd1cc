"""The driver's heap between the steps of a long job."""

import os
import subprocess
import sys
from pathlib import Path
from types import SimpleNamespace

from loomtide.operators import checkpoints

#: Fills most of a heap of 600 MB, lets go of it and collects twice.
GROWN = """
import gc
import time
from loomtide.operators.checkpoints import collect_garbage
from loomtide.session import session
sc = session("local[1]", 1, spark_ui_enabled="false", spark_driver_memory="600m").sparkContext
runtime = sc._jvm.java.lang.Runtime.getRuntime()
held = [sc._jvm.java.nio.ByteBuffer.allocate(10 << 20) for _ in range(40)]
before = runtime.totalMemory()
del held  # the JVM hears of it a little later
gc.collect()
time.sleep(3)
print("heap", before, collect_garbage(sc), runtime.totalMemory(), collect_garbage(sc), runtime.maxMemory())
"""


def test_a_grown_heap_is_given_back():
    env = os.environ | {"PYTHONPATH": str(Path(__file__).parent.parent)}
    out = subprocess.run([sys.executable, "-c", GROWN], env=env, capture_output=True, text=True, timeout=120).stdout
    _, before, did, after, again, most = next(x for x in out.splitlines() if x.startswith("heap ")).split()
    assert int(before) > int(most) / 2 and did == "True"
    assert int(after) <= int(most) / 2 and again == "False"


def test_steps_collect_where_the_heap_is_the_drivers_own(monkeypatch):
    seen = []
    monkeypatch.setattr(checkpoints, "collect_garbage", seen.append)
    for master in ("local[4]", "local-cluster[3,2,3000]", "spark://host:7077"):
        folder = SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isEmpty=lambda: False))
        sc = SimpleNamespace(master=master, _jsc=SimpleNamespace(sc=lambda folder=folder: folder))
        df = SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=sc), checkpoint=lambda: "written")
        assert checkpoints.checkpointed(df) == "written"
    assert [sc.master for sc in seen] == ["local-cluster[3,2,3000]", "spark://host:7077"]
