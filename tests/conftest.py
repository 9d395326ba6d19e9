import pytest

from leafmill.session import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", "local[4]", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


RECORDS = (
    "record_id BIGINT, paper_id STRING, source STRING, runner STRING, runner_version STRING, pdf_sha256 STRING, pages INT, wall_seconds DOUBLE, "
    "blocks ARRAY<STRUCT<page: INT, kind: STRING, text: STRING, bbox: ARRAY<DOUBLE>, `order`: INT>>, "
    "tables ARRAY<STRUCT<page: INT, `rows`: INT, cols: INT, cells: ARRAY<ARRAY<STRING>>, caption: STRING>>, "
    "chunks ARRAY<STRUCT<id: INT, text: STRING, block_ids: ARRAY<INT>, section: STRING, chars: INT>>, run_at TIMESTAMP, loaded_at TIMESTAMP, i STRING, child STRING"
)


@pytest.fixture(scope="session")
def records(spark):
    """Makes extraction records from dicts; what isn't given is null. The extra columns clash with names operators use."""
    import datetime

    def make(*rows):
        names = [f.split()[0].strip("`") for f in ("record_id paper_id source runner runner_version pdf_sha256 pages wall_seconds blocks tables chunks run_at loaded_at i child").split()]
        at = datetime.datetime(2024, 1, 1)
        return spark.createDataFrame([tuple({"loaded_at": at, "run_at": at, **r}.get(n) for n in names) for r in rows], RECORDS)

    return make


def block(text, kind="paragraph", page=1, order=0, bbox=None):
    return (page, kind, text, bbox, order)
