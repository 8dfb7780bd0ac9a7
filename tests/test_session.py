import os

import pytest

from kithloom import session as S


def test_kept_folders_are_removed(spark):
    with S.kept_folders(spark):
        kept = S.keep(spark.range(5), "gone")
        path = kept.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
        assert kept.count() == 5 and os.path.exists(path)
    assert not os.path.exists(path)


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, *_):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        S.shared_dir(Session())
