import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from terrane.session import local_session

    session = local_session(cores=4, shuffle_partitions=2, memory="3g")
    session.conf.set("spark.sql.codegen.wholeStage", "false")  # tiny inputs: compiling costs more than it saves
    yield session
    session.stop()
