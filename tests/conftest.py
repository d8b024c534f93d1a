import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from inkloom.session import build_session

    session = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g",
        "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoint"))})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def field(spark):
    """Two images of different size, two plates, dense pseudo-random coverage; also as nested lists."""
    import random

    rng = random.Random(7)
    grids, rows = {}, []
    for image, w, h in (("a", 13, 9), ("b", 7, 11), ("c", 13, 9)):
        for plate in ("cyan", "black"):
            grid = [[round(rng.random() * (x > 1), 3) for x in range(w)] for _ in range(h)]
            grids[image, plate] = grid
            rows += [(image, w, h, plate, x, y, grid[y][x]) for y in range(h) for x in range(w)]
    df = spark.createDataFrame(rows, "image_id string, w int, h int, plate string, x int, y int, cov double")
    return df.repartition(5).cache(), grids
