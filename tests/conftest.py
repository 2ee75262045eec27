import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    from tessella.session import configure

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    return configure(session)


@pytest.fixture(scope="session")
def make_blocks(spark):
    """Arrays by image id -> block table."""

    def build(images: dict, block: int):
        from tessella.operators.blocks import BLOCK_FIELDS, split_image

        rows = []
        for key, arr in images.items():
            cut = split_image(arr, block)
            rows += [(key, *[bytearray(v) if isinstance(v, bytes) else int(v) for v in vals]) for vals in zip(*cut.values())]
        return spark.createDataFrame(rows, "image_id int, " + BLOCK_FIELDS)

    return build


@pytest.fixture(scope="session")
def read_blocks():
    """Block table -> arrays by image id."""
    import numpy as np

    def read(df, dtype=np.uint8):
        out = {}
        for r in df.collect():
            shape = (r.img_h, r.img_w) if r.nch == 1 else (r.img_h, r.img_w, r.nch)
            canvas = out.setdefault(r.image_id, np.zeros(shape, dtype=dtype))
            canvas[r.y0 : r.y0 + r.h, r.x0 : r.x0 + r.w] = np.frombuffer(r.data, dtype=dtype).reshape((r.h, r.w) + shape[2:])
        return out

    return read
