import numpy as np
import pyarrow as pa
import pytest

from prosegauge.llm import common
from prosegauge.llm.packing import WordIds
from prosegauge.llm.queries import tokenizer_path


class Conf:
    def get(self, *_):
        return None


class Context:
    def __init__(self, master, folder=None):
        self.master, self.folder = master, folder

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


class Session:
    conf = Conf()

    def __init__(self, *a):
        self.sparkContext = Context(*a)


def test_no_machine_local_folder_on_a_cluster(tmp_path):
    for master in ("spark://h:7077", "yarn", "k8s://x", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            common.shared_dir(Session(master))
        assert common.shared_dir(Session(master, "/shared/x/")) == "/shared/x"
    assert common.shared_dir(Session("local[4]")).startswith("/")


def test_paths_as_spark_names_them(tmp_path):
    for uri in (str(tmp_path), f"file:{tmp_path}", f"file://{tmp_path}"):
        assert common.open_store(uri)[1] == str(tmp_path)
    assert common.open_store("s3a://bucket/a/b?region=us-east-1")[1] == "bucket/a/b"


def test_memos_are_bounded_in_bytes():
    memo = common.WordMemo(len, limit=3)
    assert memo[b"x" * 65] == 65 and not memo
    assert [memo[bytes([97 + k])] for k in range(5)] == [1] * 5 and len(memo) <= 3
    ids = WordIds(tokenizer_path())
    long = ["y" * 65, "é" * 70 + "!?", "z9" * 80, "x" + "!" * 80]
    first = ids.of([" ".join([*long, "short"])])
    assert ids.of([" ".join([*long, "short"])]) == first
    assert b"".join(ids.of([w])[0] for w in [*long, "short"]) == first[0]
    assert max(map(len, [*ids.words, *ids.cores])) <= common.MEMO_LENGTH
    text = " ".join(long)
    want = ids.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ids.of([text])[0], "<u4").tolist() == want


@pytest.mark.parametrize("least", [1, 3, 100])
def test_whole_groups(least):
    rng = np.random.default_rng(least)
    keys = np.sort(rng.integers(0, 9, 60))
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[a:b]), pa.array(np.arange(a, b))], ["k", "n"]) for a, b in ((0, 5), (5, 5), (5, 31), (31, 60))]
    got = list(common.whole_groups(iter(batches), ["k"], least))
    assert np.concatenate([g["n"] for g in got]).tolist() == list(range(60))
    seen = [set(g["k"].tolist()) for g in got]
    assert sum(map(len, seen)) == len(set().union(*seen))


def test_what_a_worker_keeps_is_freed_by_other_operators():
    made = []
    keep = common.kept_by_worker(lambda key: made.append(key) or object())
    first = keep("a")
    assert keep("a") is first and made == ["a"]
    common.forget_kept()
    assert keep("a") is not first and made == ["a", "a"]
