"""Where checkpoints go."""

from types import SimpleNamespace

import pytest

from codetally.sources.checkpoints import ensure_checkpoint_dir


class Context:
    def __init__(self, master, directory=None):
        self.master, self.directory = master, directory

    def getCheckpointDir(self):
        return self.directory

    def setCheckpointDir(self, directory):
        self.directory = directory


def session(master, configured=None, directory=None):
    conf = SimpleNamespace(get=lambda name, default: configured or default)
    return SimpleNamespace(conf=conf, sparkContext=Context(master, directory))


def test_the_configured_folder_is_used():
    spark = session("spark://host:7077", configured="/shared/ckpt")
    assert ensure_checkpoint_dir(spark) == "/shared/ckpt"
    assert spark.sparkContext.directory == "/shared/ckpt"


def test_a_folder_that_is_set_stays():
    spark = session("spark://host:7077", directory="/shared/mine")
    assert ensure_checkpoint_dir(spark) == "/shared/mine"
    assert spark.sparkContext.directory == "/shared/mine"


def test_local_mode_makes_its_own():
    spark = session("local[2]")
    folder = ensure_checkpoint_dir(spark)
    assert spark.sparkContext.directory == folder


def test_a_cluster_must_name_one():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(session("spark://host:7077"))
