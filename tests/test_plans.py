import importlib
import os

import pytest

from corpuslab import session
from corpuslab.plans.catalogue import QUERIES
from corpuslab.plans.oracle import ORACLE

DATA = "/root/testdata/sf0.001"
TABLES = ["documents", "benchmark", "conversations"]
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_entry_offers_the_catalogue():
    entry = importlib.import_module("__spark_entry__")
    assert entry.queries().items() >= QUERIES.items()
    assert entry.oracle_sql().items() >= ORACLE.items()
    assert set(QUERIES) - set(ORACLE) == {"bpe_train", "bpe_encode", "experiment_learned", "block_byte_pairs"}


@needs_data
@pytest.mark.parametrize(
    "name",
    ["prepared_corpus", "words_per_sequence", "token_counts", "topk_words", "topk_overlap",
     "prompts_in_vocab", "decode", "sequential_batches", "random_subsequences_part",
     "sequential_batches_part", "pad_batches", "perplexity",
     "generate_greedy", "similarity_by_run", "subword_longest_match", "block_longest_match", "causal_labels", "bpe_decode",
     "experiment_curve", "experiment_best"],
)
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    found = QUERIES[name](spark, DATA)
    columns = sorted(found.columns)
    got = sorted(tuple(map(str, (r[c] for c in columns))) for r in found.collect())
    want = connection.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE[name]})").fetchall()
    assert got == sorted(tuple(map(str, r)) for r in want)


@needs_data
def test_scans_read_only_what_they_need(spark):
    plan = plan_of(QUERIES["top_words"](spark, DATA))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    assert "TakeOrderedAndProject" in plan


@needs_data
def test_lists_are_coded_without_a_shuffle_of_lines(spark):
    for name in ("decode", "causal_labels", "subword_longest_match"):
        exchanges = [x for x in plan_of(QUERIES[name](spark, DATA)).splitlines() if "hashpartitioning" in x]
        assert not any("line_no" in x or "row#" in x for x in exchanges)


@needs_data
def test_top_k_is_cut_before_its_shuffle(spark):
    assert "WindowGroupLimit" in plan_of(QUERIES["topk_words"](spark, DATA))


@needs_data
def test_no_nested_loops_and_lists_derived_once(spark):
    for name in ("topk_overlap", "corpus_stats", "run_grid", "encode", "score_tokens", "token_counts"):
        plan = plan_of(QUERIES[name](spark, DATA))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    plan = plan_of(QUERIES["top_words"](spark, DATA))
    assert not any("Filter" in line and "regexp_replace" in line for line in plan.splitlines())


class FakeSession:
    """A session that records the checkpoint folder it is given."""

    def __init__(self, master, named):
        self.master, self.named, self.folder = master, named, None
        self.sparkContext = self.conf = self

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder

    def getConf(self):
        return {"spark.checkpoint.dir": self.named}

    def get(self, _name, default=None):
        return default


def test_the_named_checkpoint_folder_is_used():
    named = FakeSession("spark://host", "/shared/folder")
    session.ensure_checkpoint_dir(named)
    assert named.folder == "/shared/folder"
    named.folder = "/already/set"
    session.ensure_checkpoint_dir(named)
    assert named.folder == "/already/set"


def test_only_a_local_session_makes_its_own_checkpoint_folder():
    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(FakeSession("yarn", None))
    local = FakeSession("local[2]", None)
    session.ensure_checkpoint_dir(local)
    assert os.path.isdir(local.folder)
