import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def elements(spark):
    """Elements of pages given as dicts; what isn't named is null or a default."""
    from leafstack.schema import ELEMENTS

    names = [f.strip().split(" ")[0] for f in ELEMENTS.split(", ")]

    def make(*rows):
        seen = {}
        full = []
        for r in rows:
            page = (r.get("doc_id", "d"), r.get("page_number", 1))
            seen[page] = seen.get(page, -1) + 1
            box = dict(zip(("x", "y", "width", "height"), map(float, r.get("box", (0, 0, 0.1, 0.1)))))
            base = {"doc_id": "d", "page_number": 1, "ordinal": seen[page], "element_id": f"E{seen[page]}", "element_type": "text", "z_order": 1, **box} | {k: v for k, v in r.items() if k != "box"}
            full.append(tuple(base.get(n) for n in names))
        return spark.createDataFrame(full, ELEMENTS)

    return make


@pytest.fixture
def pages(spark):
    from leafstack.schema import PAGES

    return lambda *rows: spark.createDataFrame([(r.get("doc_id", "d"), r.get("page_number", 1), 960.0, 540.0, r.get("source_format"), r.get("layout_mode"), r.get("sheet_name")) for r in rows], PAGES)
