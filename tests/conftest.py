import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from gaugelake.plans.split import HEADER_LINE  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("gaugelake-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        # Tiny inputs: compiling plans would take longer than running them.
        .config("spark.sql.codegen.wholeStage", "false")
        .config("spark.sql.codegen.factoryMode", "NO_CODEGEN")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "America/New_York")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def line(index, stamp, analogue=None, digital=None):
    """One CSV line of the contract, without its terminator."""
    values = analogue or ["1.5", "2.5", "3.5", "-0.5", "5.5", "60.0", "0.04"]
    states = digital or ["1.0", "0.0", "1.0", "0.0", "1.0", "1.0", "0.0", "1.0"]
    return ",".join([str(index), stamp, *values, *states])


def day_lines(day, count, start_index=0, step=10, first="00:00:00"):
    start = datetime.fromisoformat(f"{day} {first}")
    return [
        line(start_index + i, (start + timedelta(seconds=step * i)).strftime("%Y-%m-%d %H:%M:%S"))
        for i in range(count)
    ]


def write_object(root, day, lines, header=HEADER_LINE.rstrip("\r"), end="\r\n", name="data.csv", tail=None):
    """Write one raw daily object; ``tail`` replaces the last terminator."""
    folder = Path(root) / f"source_date={day}"
    folder.mkdir(parents=True, exist_ok=True)
    text = end.join([header, *lines]) + (end if tail is None else tail)
    (folder / name).write_bytes(text.encode("utf-8"))
    return folder
