import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from ledgerloom.session import local_session

    session = local_session("4", shuffle_partitions=4, spark__driver__memory="4g")
    yield session
    session.stop()


@pytest.fixture
def candidates(spark):
    """Build candidates from (statement, page, row, {field: raw or (raw, suggested, final, confidence, indices)}, status) tuples."""
    from ledgerloom import schemas

    def build(rows, suggest=True):
        out = []
        for k, (doc, page, row, fields, *rest) in enumerate(rows):
            made = {}
            for name, v in (fields or {}).items():
                v = v if isinstance(v, tuple) else (v, v if suggest else None)
                raw, suggested, final, confidence, indices = (*v, *[None] * (5 - len(v)))
                made[name] = (raw, suggested, final, None, confidence, indices or [])
            status = rest[0] if rest else "unreviewed"
            duplicate = rest[1] if len(rest) > 1 else None
            order = rest[2] if len(rest) > 2 else None
            out.append((k, doc, page, row, "grid_v1", made if fields is not None else None, status, duplicate, order))
        return spark.createDataFrame(out, schemas.CANDIDATES)

    return build
