import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from keyloom.session import local_session
    session = local_session(4, 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


COUNTS = [
    ("WBGene00007063", 633, 451, 365, 388), ("WBGene00007064", 60, 57, 20, 23), ("WBGene00044951", 0, 0, 0, 1),
    ("WBGene00007066", 55, 266, 46, 39), ("WBGene00007067", 15, 13, 1, 0), ("WBGene00007069", 0, 2, 1, 0),
    ("WBGene00077502", 0, 0, 0, 0), ("WBGene00077503", 1, 4, 2, 0), ("WBGene00077504", 0, 0, 0, 0),
    ("WBGene00007071", 70, 48, 17, 7), ("WBGene00044022", 3, 3, 0, 0), ("WBGene00014997", 15, 34, 4, 1),
    ("WBGene00043988", 15051, 12595, 22027, 15639), ("WBGene00043989", 3305, 3177, 7997, 6097),
    ("WBGene00043990", 8731, 7951, 16470, 11985), ("WBGene00007074", 29, 22, 41, 19),
    ("WBGene00007075", 15056, 12746, 21686, 15470), ("WBGene00007076", 3422, 3155, 7919, 6242),
    ("WBGene00007077", 137, 138, 165, 103), ("WBGene00007078", 90, 60, 27, 12),
    ("WBGene00007079", 8642, 7859, 16265, 12146), ("WBGene00043987", 28, 22, 12, 24),
]
SAMPLES = ["cond1", "cond2", "cond3", "cond4"]


@pytest.fixture(scope="session")
def counts(spark):
    return spark.createDataFrame(COUNTS, "gene string, cond1 long, cond2 long, cond3 long, cond4 long").cache()


def rows(df, key=0):
    """key -> remaining values"""
    return {r[key]: tuple(v for i, v in enumerate(r) if i != key) for r in df.collect()}
