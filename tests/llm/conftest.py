import pytest

ROWS = "source_row long, channel string, file string, speaker string, start_time string, end_time string, text string, audio string, split string"


@pytest.fixture
def utterances(spark):
    def make(*rows, **extra):
        names = [c.split()[0] for c in ROWS.split(", ")]
        return spark.createDataFrame([tuple({"source_row": i, **r}.get(n) for n in names) for i, r in enumerate(rows)], ROWS)

    return make
