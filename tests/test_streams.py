"""Streams against batches: admission in event time, incremental facts, and the table functions of SQL."""

import random
import tempfile
from types import SimpleNamespace

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from codestrata.functions import tables
from codestrata.operators import python_facts
from codestrata.plans.analysis import Analysis
from codestrata.sources import corpus
from codestrata.streaming import admission, incremental

REQUESTS = "key string, id long, ms long, max_n int"


def _run(spark, folder, name, stream):
    q = stream.writeStream.format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/cp-{name}").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(120) and q.exception() is None


def test_event_time_admission_equals_batch_out_of_order(spark):
    """Files come one a micro-batch, with requests up to four minutes late; a far later request moves the watermark past all others."""
    folder = tempfile.mkdtemp(dir="/tmp")
    r = random.Random(7)
    rows = [(f"k{r.randrange(3)}", i, 1_000_000 + i * 20_000, 4) for i in range(150)]
    rows += [("k1", 500, rows[10][2], 4), ("k1", 501, rows[10][2], 4)]
    order = sorted(rows, key=lambda x: x[2] + r.randrange(240_000))
    last = [("end", 999, 10**9, 1)]
    files = [order[i : i + 40] for i in range(0, len(order), 40)] + [last]
    for i, part in enumerate(files):
        spark.createDataFrame(part, REQUESTS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(REQUESTS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        _run(spark, folder, "out", admission.admit_in_event_time(stream, "5 minutes", 300_000))
    finally:
        spark.conf.set(provider, before)
    columns = ["key", "id", "allowed", "remaining", "retry_after"]
    got = sorted(map(tuple, spark.read.parquet(f"{folder}/out").select(columns).collect()), key=repr)
    want = admission.admit(spark.createDataFrame(rows, REQUESTS), 300_000).select(columns)
    assert got == sorted(map(tuple, want.collect()), key=repr) and any(not x[2] for x in got)


class _State:
    """A key's state as the judge sees it; each call would go to the JVM and back."""

    def __init__(self):
        self.items, self.calls, self.timers = [], 0, set()

    def __getattr__(self, name):
        def call(*args):
            self.calls += 1
            match name:
                case "getListState" | "getValueState":
                    part = _State()
                    self.items.append(part)
                    return part
                case "registerTimer" | "deleteTimer":
                    (self.timers.add if name == "registerTimer" else self.timers.discard)(args[0])
                case "appendValue":
                    self.items.append(args[0])
                case "put":
                    self.items = list(args[0])
                case "update":
                    self.items = args[0]
                case "clear":
                    self.items = []
                case "get":
                    return self.items or None if isinstance(self.items, tuple) or not self.items else list(self.items)
            return None

        return call


def test_event_time_admission_calls_the_state_a_few_times_a_key(spark):
    """4 000 requests of one key in two batches: state calls and timers do not grow with the requests."""
    r = random.Random(4)
    rows = [(i, 1_000_000 + r.randrange(3_000_000), 9) for i in range(4000)]
    handle, judge = _State(), admission._Judge(300_000)
    judge.init(handle)
    waiting, state = handle.items
    waiting.get = lambda: iter(list(waiting.items))
    for half in (rows[:2000], rows[2000:]):
        list(judge.handleInputRows(("k",), iter([Row(key="k", id=i, ms=ms, max_n=most) for i, ms, most in half]), None))
    got, fired = [], 0
    for watermark in (2_000_000, 10_000_000):
        while handle.timers and (timer := min(handle.timers)) <= watermark:
            fired += 1
            handle.timers.discard(timer)
            at = SimpleNamespace(getCurrentWatermarkInMs=lambda w=watermark: w, getExpiryTimeInMs=lambda t=timer: t)
            got += [tuple(x[c] for c in ("id", "allowed", "remaining", "retry_after")) for x in judge.handleExpiredTimer(("k",), at, at)]
    want = admission.admit(spark.createDataFrame([("k", *x) for x in rows], "key string, id long, ms long, max_n int"), 300_000)
    assert sorted(got) == sorted(tuple(x)[1:] for x in want.collect()) and fired <= 3
    assert handle.calls + waiting.calls + state.calls < 40 and not handle.timers and not waiting.items and not state.items


EVENTS = "repo string, path string, content string, deleted boolean, seq long"


def test_incremental_stream_equals_batch(spark):
    """Edits, touches, deletions, a file that comes back, a restart, a batch that is given twice, and compaction."""
    folder = tempfile.mkdtemp(dir="/tmp")
    r = random.Random(5)
    live, seq, analysed, n = {}, 0, [], 0

    def analyse(files):
        facts = python_facts.syntax(files)
        analysed.append(files.count())
        return facts

    def put(events):
        spark.createDataFrame(events, EVENTS).coalesce(1).write.mode("append").parquet(f"{folder}/in")

    def run():
        stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        q = incremental.follow(stream, f"{folder}/store", f"{folder}/cp", analyse, compact_every=3)
        assert q.awaitTermination(200) and q.exception() is None

    def check():
        got = {(x.repo, x.path): (x.hash, x.facts) for x in incremental.snapshot(spark, f"{folder}/store").collect()}
        files = spark.createDataFrame([(*k, v) for k, v in live.items()], "repo string, path string, content string")
        want = {(x.repo, x.file): x for x in python_facts.syntax(files).collect()}
        assert got.keys() == want.keys() == live.keys() and all(got[k][1] == want[k] for k in want)

    for step in range(4):
        events = []
        for _ in range(12):
            seq += 1
            k = (f"r{r.randrange(2)}", f"m{r.randrange(9)}.py")
            if k in live and r.random() < 0.3:
                del live[k]
                events.append((*k, None, True, seq))
            else:
                live[k] = live[k] if k in live and r.random() < 0.3 else f"import os, m{seq}\ndef f{seq}(): g()\n"
                events.append((*k, live[k], False, seq))
        put(events)
        if step % 2:
            run()  # takes up two files, after a restart from the checkpoint
            check()
    done = list(analysed)
    store = f"{folder}/store"
    versions = spark.read.parquet(f"{store}/versions").orderBy("batch").collect()
    assert [v.batch for v in versions] == [0, 1, 2, 3] and versions[-1].base and len(versions[-1].deltas) < 3
    incremental.apply_batch(spark.createDataFrame([("r0", "x.py", "y = 1", False, 999)], EVENTS), 3, store, analyse)  # known already
    check()
    k, text = next(iter(live.items()))
    incremental.apply_batch(spark.createDataFrame([(*k, text, False, 1000)], EVENTS), 4, store, analyse)
    assert analysed[len(done) :] == [0]  # unchanged: nothing to analyse
    check()


def test_table_functions_give_the_facts_of_the_analysis(spark):
    files = corpus.code_files(spark, "/root/testdata/sf0.001").where("repo = 'src1/1'")
    tables.register(spark)
    files.createOrReplaceTempView("files_of_sql")
    a = Analysis(files)
    py = "f.path LIKE '%.py'"
    got = spark.sql(f"SELECT f.path, t.line, t.module FROM files_of_sql f, LATERAL python_imports(f.content) t WHERE {py}")
    want = a.imports.where("file LIKE '%.py'").select("file", "line", "module")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 5
    got = spark.sql(f"SELECT f.path, concat_ws('::', f.path, array_join(t.parents, '::'), t.name) AS id, t.name, t.line, t.end_line FROM files_of_sql f, LATERAL python_definitions(f.content) t WHERE {py}")
    got = [(p, i.replace("::::", "::"), *x) for p, i, *x in map(tuple, got.collect())]
    want = a.symbols.where("file LIKE '%.py' AND type <> 'module'").select("file", "id", "name", "line", "end_line")
    assert sorted(got) == sorted(map(tuple, want.collect()))
    assert spark.sql("SELECT t.* FROM (SELECT CAST(NULL AS STRING) AS c UNION ALL SELECT 'def (') x, LATERAL python_calls(x.c) t").collect() == []
