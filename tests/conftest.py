from __future__ import annotations

import pytest

from rankjobs.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("checkpoints"))
    session = local_session(4, shuffle_partitions=4, driver_memory="6g", checkpoint_dir=folder)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
