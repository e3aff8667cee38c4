import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
ROOT = os.path.dirname(HERE)
sys.path.insert(0, ROOT)
# Workers import plug-ins from the test modules.
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, HERE, os.environ.get("PYTHONPATH", "")])

from vectext.session import get_session, use_own_folder  # noqa: E402


# Started here, since columns can only be made while a session runs.
SESSION = get_session("local[8]", "vectext-tests", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
SESSION.sparkContext.setLogLevel("ERROR")
use_own_folder(SESSION)


@pytest.fixture(scope="session")
def spark():
    return SESSION


def fails(df, words: str) -> None:
    """The plan fails when run, with these words in its error."""
    with pytest.raises(Exception) as caught:
        df.collect()
    assert words in str(caught.value)
