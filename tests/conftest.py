import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from larkspur.session import build_session

    session = build_session(
        "tests",
        master="local[4]",
        extra={
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            # what the listeners keep of past jobs, and compiled code, would else grow with the number of tests
            "spark.ui.retainedJobs": "20",
            "spark.ui.retainedStages": "20",
            "spark.ui.retainedTasks": "1000",
            "spark.sql.ui.retainedExecutions": "5",
            "spark.sql.codegen.cache.maxEntries": "50",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
    yield session
    session.stop()


@pytest.fixture(autouse=True)
def memory_log(request):
    """With LARKSPUR_MEMORY_LOG set to a file: what the JVM holds after each test that used a session."""
    yield
    path = os.environ.get("LARKSPUR_MEMORY_LOG")
    if path and "spark" in request.fixturenames:
        jvm = request.getfixturevalue("spark").sparkContext._jvm
        jvm.System.gc()
        beans = jvm.java.lang.management.ManagementFactory
        pools = {x.getName(): x.getUsage().getUsed() >> 20 for x in beans.getMemoryPoolMXBeans()}
        pid = beans.getRuntimeMXBean().getName().split("@")[0]
        resident = next((int(x.split()[1]) >> 10 for x in Path(f"/proc/{pid}/status").read_text().splitlines() if x.startswith("VmRSS")), 0)
        peak = {x.getName(): x.getPeakUsage().getUsed() >> 20 for x in beans.getMemoryPoolMXBeans()}
        heap = beans.getMemoryMXBean().getHeapMemoryUsage().getUsed() >> 20
        code = sum(v for k, v in pools.items() if k.startswith("Code"))
        with open(path, "a") as out:
            print(request.node.name, f"heap {heap}", f"peak old {peak.get('G1 Old Gen', 0)}", f"metaspace {pools.get('Metaspace', 0)}", f"code {code}", f"resident {resident}", "MB", file=out)
        for x in beans.getMemoryPoolMXBeans():
            x.resetPeakUsage()
