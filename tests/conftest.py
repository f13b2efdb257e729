import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from veilframe.session import local_session  # noqa: E402
from veilframe.sources.sheets import Sheet  # noqa: E402

AS_OF = dt.date(2024, 6, 30)
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    # The setting that a cluster would give.
    return local_session(8, settings={"spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})


@pytest.fixture
def sheet(spark):
    """Build a sheet from a schema and plain rows; positions follow the rows."""

    def build(schema, rows, name="sheet"):
        columns = f"_pos long, {schema}"
        return Sheet(name, spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], columns), "_pos")

    return build


def ordered(clean):
    """Cleaned rows in source order as plain tuples."""
    return [tuple(r)[1:] for r in clean.positioned.orderBy("_pos").collect()]


def stats(clean):
    return tuple(clean.stats.first())
