"""Where intermediate tables go."""

import pytest

from lexweave import storage


class Conf(dict):
    def get(self, key, default=None):
        return super().get(key, default)

    set = dict.__setitem__


class Session:
    def __init__(self, master, **conf):
        own = Conf(conf)
        self.sparkContext = type("Context", (), {"master": master, "getConf": lambda self: own})()
        self.conf = own


def test_a_cluster_must_name_a_shared_folder():
    for master in ("spark://host:7077", "yarn", "k8s://host", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            storage.shared_dir(Session(master))
        assert storage.shared_dir(Session(master, **{"spark.checkpoint.dir": "/shared/"})) == "/shared"
    assert storage.shared_dir(Session("local[4]"))
