import json

from pyspark.sql import functions as F

from corpuslab.operators.experiments import summarise_runs
from corpuslab.plans import tweet_flow
from corpuslab.sources import corpus, runs, sinks, tweets


def test_to_lines(spark):
    df = spark.createDataFrame([(1, "a\nb\n"), (2, ""), (3, "x\n\n"), (4, "one")], "id long, text string")
    got = [tuple(r) for r in corpus.to_lines(df).orderBy("id", "line_no").collect()]
    assert got == [(1, 0, "a"), (1, 1, "b"), (3, 0, "x"), (3, 1, ""), (4, 0, "one")]


def test_read_lines_numbers_lines_over_file_splits(spark, tmp_path):
    texts = {"a.txt": [f"line {i} " + "x" * (i % 50) for i in range(3000)], "b.txt": ["only", "", "three"]}
    for name, lines in texts.items():
        (tmp_path / name).write_text("".join(f"{l}\n" for l in lines))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000b")
    try:
        rows = corpus.read_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    for name, lines in texts.items():
        got = sorted((r.line_no, r.text) for r in rows if r.file.endswith(name))
        assert got == list(enumerate(lines))


def tweet_file(path, columns, rows):
    lines = [",".join(columns)]
    for row in rows:
        cells = ['"' + str(row[c]).replace('"', '""') + '"' if c in row else "" for c in columns]
        lines.append(",".join(cells))
    path.write_text("\n".join(lines) + "\n")


def test_tweets(spark, tmp_path):
    names = [c.split()[0] for c in tweets.TWEET_SCHEMA.split(",")]
    assert len(names) == 39
    one = {"row": 0, "id": 90000000417, "created_at": "1286445655000.0", "hour": "04", "retweet": "False",
           "date": "2010-10-07 10:00:55", "tweet": 'quoted, "twice"\nnext line', "search": "None"}
    tweet_file(tmp_path / "2010.csv", names, [one])
    tweet_file(tmp_path / "2011.csv", names, [{**one, "id": 7, "tweet": "second"}, one])
    table = tweets.read_tweets(spark, str(tmp_path / "*.csv"))
    rows = sorted(tweets.created(table).collect(), key=lambda r: (r.file, r.id))
    assert [(r.file, r.id) for r in rows] == [
        ("2010.csv", 90000000417), ("2011.csv", 7), ("2011.csv", 90000000417)
    ]
    assert rows[0].tweet == one["tweet"] and rows[0].hour == 4 and rows[0].retweet is False
    assert rows[0].created == rows[0].date and rows[0].place is None
    assert tweets.drop_repeats(table).count() == 2


def flow_files(folder):
    """Two files with repeated and null rows and ids, blank and missing tweets, and texts that lose all."""
    words = "amber birch cedar dune ember fjord".split()
    first = [{"row": i // 2, "id": 500 + i % 5, "tweet": f"{words[i % 6]} {words[i % 5]} #{words[i % 4]} {i}",
              "place": " " if i % 3 else "Ulm"} for i in range(41)]
    second = [{"tweet": t} for t in ("Zebra, 12", "   ", "https://a.example/x", "", "line\nbreak", "Zebra, 12")]
    second += [{"id": 7, "tweet": "seven"}, {"row": 3, "tweet": "three"}]
    tweet_file(folder / "2020.csv", ["row", "id", "tweet", "place"], first)
    tweet_file(folder / "2021.csv", ["row", "id", "tweet"], second)
    return [(str(folder / "2020.csv"), "row int, id long, tweet string, place string"),
            (str(folder / "2021.csv"), "row int, id long, tweet string")]


def test_tweet_flow(spark, tmp_path):
    groups = flow_files(tmp_path)
    cleaned = tweet_flow.clean_tweets(tweets.read_tweet_groups(spark, groups))
    rows = cleaned.collect()
    # The address stays as its placeholder word, as the strict rules only take off its signs.
    assert len(rows) == 41 + 6 and all(r.tweet_clean.strip() for r in rows)
    assert {r.place for r in rows} == {None, "Ulm"}
    key = lambda r: (r.file, r.row is not None, r.row or 0, r.id is not None, r.id or 0)
    for parity in (True, False):
        split = tweet_flow.split_tweets(cleaned, parity).collect()
        parts = [[r for r in split if r.split == name] for name in ("train", "val", "test")]
        assert [len(p) for p in parts] == ([23, 11, 11] if parity else [23, 12, 12])
        for before, after in zip(parts, parts[1:]):
            assert max(map(key, before)) <= min(map(key, after))
        assert set(split[0].asDict()) == {*cleaned.columns, "split"}
    again = tweet_flow.split_tweets(cleaned.repartition(7)).select("split", *cleaned.columns)
    assert sorted(map(str, again.collect())) == sorted(map(str, tweet_flow.split_tweets(cleaned).select("split", *cleaned.columns).collect()))


def test_tweet_flow_writes_the_table_and_its_splits(spark, tmp_path):
    groups = flow_files(tmp_path)
    combined, splits = str(tmp_path / "combined"), str(tmp_path / "splits")
    tweet_flow.prepare_tweets(spark, groups, combined, splits)
    csv = dict(header=True, multiLine=True, quote='"', escape='"')
    table = spark.read.options(**csv).csv(combined)
    assert table.count() == 47 and "tweet_clean" in table.columns
    parts = {name: spark.read.options(**csv).csv(f"{splits}/split={name}") for name in ("train", "val", "test")}
    assert {n: p.count() for n, p in parts.items()} == {"train": 23, "val": 11, "test": 11}
    assert parts["test"].columns == table.columns
    assert any("\n" in r.tweet for r in table.collect())
    # A combined table that exists already stays as it is.
    tweet_flow.prepare_tweets(spark, groups[:1], combined, splits)
    assert spark.read.options(**csv).csv(combined).count() == 47
    assert spark.read.options(**csv).csv(f"{splits}/split=train").count() == 20


def test_tweet_flow_of_no_tweets(spark, tmp_path):
    tweet_file(tmp_path / "none.csv", ["row", "id", "tweet"], [])
    empty = tweet_flow.clean_tweets(tweets.read_tweets(spark, str(tmp_path / "none.csv"), "row int, id long, tweet string"))
    assert tweet_flow.split_tweets(empty).count() == 0


def test_tweet_files_of_several_layouts(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,tweet\n1,one\n")
    (tmp_path / "b.csv").write_text("tweet,place\ntwo,here\n")
    a, b = "id long, tweet string", "tweet string, place string"
    table = tweets.read_tweet_groups(spark, [(str(tmp_path / "a.csv"), a), (str(tmp_path / "b.csv"), b)])
    got = {(r.id, r.tweet, r.place) for r in table.collect()}
    assert got == {(1, "one", None), (None, "two", "here")}


def test_training_sets(spark, tmp_path):
    (tmp_path / "train.csv").write_text(',content\n0,"a, b"\n1,c\n')
    (tmp_path / "val.csv").write_text(",content\n0,d\n")
    table = tweets.read_training_set(
        spark, {"train": str(tmp_path / "train.csv"), "val": str(tmp_path / "val.csv")}
    )
    assert sorted(map(tuple, table.collect())) == [("train", "a, b"), ("train", "c"), ("val", "d")]
    (tmp_path / "t.txt").write_text("one\n\n  \ntwo\n")
    lines = tweets.read_training_lines(spark, str(tmp_path / "t.txt"))
    assert [r.text for r in lines.collect()] == ["one", "two"]


def test_generated_files(spark, tmp_path):
    (tmp_path / "lstm_char.csv").write_text(",prompt,output\n0,So,So it\n")
    (tmp_path / "gru_word.csv").write_text(",prompt,output\n0,I,I am\n1,We,\n")
    (tmp_path / "_README.md").write_text("not,a,table\n")
    got = {tuple(r) for r in runs.read_generated(spark, str(tmp_path)).collect()}
    assert got == {("lstm_char", "So", "So it"), ("gru_word", "I", "I am"), ("gru_word", "We", None)}


LOG = """Starting run one with model='lstm' tokenization='word' epochs=3 num_hiddens=128 device=cuda:0
epoch 0 - val-ppl: 20.5, train-ppl: 30.1, elapsed_time=4.25s
<BOS> epoch 9 is nice <EOS>
epoch 1 - val-ppl: 10.5, train-ppl: inf, elapsed_time=1234.5s
Starting run one with model='lstm' tokenization='word' epochs=3 num_hiddens=128 device=cuda:0
Starting run one with model='lstm' tokenization='word' epochs=3 num_hiddens=128 device=cuda:0
epoch 0 - val-ppl: 7.0, train-ppl: 8.0, elapsed_time=9.00s
epoch 9 wonders never cease <EOS>
train results (ppl):
[1.5, 2.5]
------------------
"""


def test_logs(spark, tmp_path):
    (tmp_path / "a.log").write_text(LOG)
    (tmp_path / "b.log").write_text(LOG)
    table = runs.read_logs(spark, str(tmp_path))
    rows = sorted((r.file[-5:], r.start_line, r.epoch, r.val_ppl, r.train_ppl, r.seconds) for r in table.collect())
    one = [(0, 0, 20.5, 30.1, 4.25), (0, 1, 10.5, float("inf"), 1234.5), (5, 0, 7.0, 8.0, 9.0)]
    assert rows == [(f, *r) for f in ("a.log", "b.log") for r in one]
    first = table.first()
    assert (first.model, first.tokenizer, first.planned_epochs, first.hidden_units) == ("lstm", "word", 3, 128)
    best = summarise_runs(table, ["file", "start_line"]).filter("start_line = 0").first()
    assert (best.n_epochs, best.final_val_ppl) == (2, 10.5)


def test_log_lines_read_back(spark, tmp_path):
    start = LOG.splitlines()[0]
    epochs = spark.createDataFrame([(0, 2.25, 3.5, 1.0)], "epoch int, val_ppl double, train_ppl double, seconds double")
    line = sinks.log_lines(epochs).first().value
    assert line == "epoch 0 - val-ppl: 2.3, train-ppl: 3.5, elapsed_time=1.00s"
    (tmp_path / "x.log").write_text(f"{start}\n{line}\n")
    assert runs.read_logs(spark, str(tmp_path)).first().val_ppl == 2.3
    sinks.append_log(epochs, str(tmp_path / "log"))
    sinks.append_log(epochs, str(tmp_path / "log"))
    assert spark.read.text(str(tmp_path / "log")).count() == 2


def test_metrics(spark, tmp_path):
    history = [
        {"epoch": 1.0, "learning_rate": 0.1, "loss": 4.5, "step": 5},
        {"epoch": 1.0, "eval_loss": 0.0, "eval_runtime": 2.0, "step": 5},
        {"epoch": 2.0, "learning_rate": 0.1, "loss": 3.5, "step": 10},
        {"epoch": 3.0, "eval_loss": 1000.0, "step": 15},
    ]
    for run in ("fine_tuned", "scratch"):
        (tmp_path / run).mkdir()
        (tmp_path / run / "eval_results.json").write_text(json.dumps(history, indent=4))
    rows = runs.read_metrics(spark, str(tmp_path / "*" / "*.json")).orderBy("run", "epoch").collect()
    assert [(r.run, r.epoch) for r in rows][:3] == [("fine_tuned", e) for e in (1.0, 2.0, 3.0)]
    assert (rows[0].loss, rows[0].eval_loss, rows[0].perplexity) == (4.5, 0.0, 1.0)
    assert rows[1].perplexity is None and rows[2].perplexity == float("inf")
    sinks.append_metrics(runs.read_metrics(spark, str(tmp_path / "*" / "*.json")), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).count() == 6


def test_csv_sinks(spark, tmp_path):
    df = spark.createDataFrame([("train", 'a "b", c\nd'), ("val", "x")], "split string, text string")
    sinks.write_csv(df, str(tmp_path / "out"))
    sinks.write_csv(df.limit(0), str(tmp_path / "out"), only_if_absent=True)
    back = spark.read.options(**tweets.CSV).csv(str(tmp_path / "out"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    sinks.write_splits(df, str(tmp_path / "splits"))
    assert spark.read.options(**tweets.CSV).csv(str(tmp_path / "splits" / "split=val")).first()[0] == "x"


def test_generated_sink_replaces_only_its_runs(spark, tmp_path):
    schema = "run string, prompt string, sample_no long, output string"
    sinks.write_generated(spark.createDataFrame([("a", "p", 0, "x"), ("b", "p", 0, "y")], schema), str(tmp_path / "g"))
    sinks.write_generated(spark.createDataFrame([("a", "q", 0, "z")], schema), str(tmp_path / "g"))
    got = {(r.run, r.output) for r in spark.read.parquet(str(tmp_path / "g")).collect()}
    assert got == {("a", "z"), ("b", "y")}
