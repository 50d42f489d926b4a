import datetime as dt

from pyspark.sql import functions as F

from logloom import schemas
from logloom.operators import infer, memory as mem, reports as rp, verdict as vd
from logloom.operators.embed import hashing_embedder
from logloom.plans.triage import triage_logs
from logloom.sources import files, tables

FAILING = "[2024-06-01 10:00:00] TESTCASE: login FAILED\nError: Connection timeout after 30s\nError: Connection timeout after 31s\nStacktrace: a.py:1\n"
PASSING = "[2024-06-01 10:00:00] TESTCASE: a PASSED\n[2024-06-01 10:01:05] TESTCASE: b PASSED\n"
DAY = dt.datetime(2024, 6, 1)


def test_tips_last_write_wins(spark):
    tips = spark.createDataFrame(
        [("global_tips", "t", "old", DAY, "r1"), ("global_tips", "t", "new", DAY + dt.timedelta(1), "r0"), ("other", "t", "x", DAY, "r9")],
        schemas.TIPS,
    )
    latest = mem.latest_tips(tips)
    assert {(r.namespace, r.analysis) for r in latest.collect()} == {("global_tips", "new"), ("other", "x")}
    failures = spark.createDataFrame([("r", "t", 0), ("r", "unknown", 1)], "run_id string, test_name string, first_line long")
    assert [tuple(r) for r in mem.tips_for_failures(failures, latest).select("test_name", "analysis").collect()] == [("t", "new")]


def test_new_tips(spark):
    runs = spark.createDataFrame(
        [("f", "failed", "rep f", DAY), ("p", "passed", "rep p", DAY), ("u", "failed", "rep u", DAY), ("n", "failed", None, DAY)],
        "run_id string, test_status string, report string, updated_at timestamp_ntz",
    )
    failures = spark.createDataFrame(
        [("f", "t1", "why 1"), ("f", "t2", "why 2"), ("n", "t3", "why 3")], "run_id string, test_name string, explanation string"
    )
    got = {(r.key, r.analysis) for r in mem.new_tips(runs, failures).collect()}
    assert got == {("t1", "why 1"), ("t2", "why 2"), ("last_success", "rep p")}


def test_messages(spark):
    rows = [("r", 0, "a", "ai", "one"), ("r", 1, "b", "ai", "two"), ("r", 2, "a", "ai", "one again"), ("s", 5, "z", "ai", "z")]
    history = mem.merge_messages(spark.createDataFrame(rows, "run_id string, seq long, message_id string, role string, content string"))
    runs = spark.createDataFrame([("r", "sys", "hum"), ("empty", "sys", "hum")], "run_id string, system string, human string")
    got = [(r.run_id, r.seq, r.content) for r in mem.prompt_messages(history, runs).orderBy("run_id", "seq").collect()]
    assert got == [("empty", 0, "sys"), ("empty", 1, "hum"), ("r", 0, "sys"), ("r", 1, "one again"), ("r", 2, "two"), ("r", 3, "hum")]


def test_context_text(spark):
    runs = spark.createDataFrame([("a",), ("b",), ("c",)], "run_id string")
    hits = spark.createDataFrame(
        [("a", 2, "D2", None, None), ("a", 1, "D1", "S1", "R1")],
        "run_id string, rank int, document string, summary string, resolution string",
    )
    failures = spark.createDataFrame([("a", "t", 3), ("b", "u", 1)], "run_id string, test_name string, first_line long")
    tips = failures.where("run_id = 'a'").withColumn("analysis", F.lit("tip"))
    got = {r.run_id: r.historical_context for r in mem.assemble_context(runs, hits, tips, failures).collect()}
    assert got["a"] == (
        "--- Semantic Memory ---\nPast Issue: D1\nResolution/Analysis: R1\n\nPast Issue: D2\nResolution/Analysis: N/A\n\n"
        "\n\n--- Short-Term Memory (Global Tips) ---\nTip for t: tip"
    )
    assert got["b"] == "--- Short-Term Memory (Global Tips) ---" and got["c"] == ""


def test_error_details_and_tickets(spark):
    logs = spark.createDataFrame([("f", FAILING), ("p", PASSING), ("u", "no tests")], "run_id string, log_content string")
    lines = vd.explode_logs(logs)
    facts = vd.scan_lines(lines)
    outcomes = vd.per_test(vd.tests_of(facts))
    verdicts = vd.verdict(facts, outcomes)
    failures = vd.failed_tests(outcomes)
    details = rp.error_details(facts, failures)
    assert {(r.test_name, r.message, r.n) for r in details.collect()} == {
        ("login", "Error: Connection timeout after <NUM>", 2), ("login", "Stacktrace: a.py:<NUM>", 1),
    }
    explained = rp.test_explanations(failures, details)
    reports = {r.run_id: r.failure_report for r in rp.failure_reports(verdicts, explained).collect()}
    assert set(reports) == {"f", "u"} and "None identified" in reports["u"] and "likely causes: Application x1, Network x2" in reports["f"]
    passed = rp.pass_reports(verdicts, vd.run_times(lines)).collect()
    assert [r.run_id for r in passed] == ["p"] and "Execution time: 65 s" in passed[0].summary_report
    tickets = rp.plan_tickets(explained)
    texts = {r.run_id: r for r in rp.ticket_lists(verdicts, tickets).collect()}
    assert texts["f"].n_tickets == 1 and texts["u"].tickets_text == "No Tickets Created" == texts["p"].tickets_text
    planned, unplanned = rp.with_and_without_tickets(verdicts, tickets)
    assert [r.run_id for r in planned.collect()] == ["f"] and unplanned.count() == 2


def test_ticket_details_and_tool_results(spark):
    tickets = spark.createDataFrame(
        [("r", "T-1", "s", "d", "t", "created", 1, None, "trace")],
        "run_id string, ticket_id string, summary string, description string, testcase string, status string, first_line long, details string, error_details string",
    )
    text = rp.ticket_lists(tickets.select("run_id"), tickets).first().tickets_text
    assert "Details: trace" in text
    results = spark.createDataFrame(
        [("r", 0, "create_jira_ticket", '{"ticket_id": "T-1"}'), ("r", 1, "other", "{}"), ("r", 2, "create_jira_ticket", "plain")],
        "run_id string, seq int, name string, content string",
    )
    got = rp.ticket_results(results).select("seq", F.to_json("ticket").alias("t")).orderBy("seq").collect()
    assert [tuple(r) for r in got] == [(0, '{"ticket_id":"T-1"}'), (2, '{"raw":"plain"}')]


def test_batches_retry_wait_and_fail_alone(spark, tmp_path):
    waits = str(tmp_path / "waits")

    def make():
        calls = {}

        def model(prompts):
            key = tuple(prompts)
            calls[key] = calls.get(key, 0) + 1
            if "never" in prompts or ("second" in prompts and calls[key] < 2):
                raise RuntimeError("busy")
            return [p.upper() for p in prompts]

        return model

    def note(seconds):
        with open(waits, "a") as f:
            f.write(f"{seconds} ")

    words = ["a", "second", "c", "d", "never", "f", "g"]
    df = spark.createDataFrame(list(enumerate(words)), "i int, p string").coalesce(1)
    got = infer.batch_infer(df, "p", make, sleep=note).orderBy("i").collect()
    assert [r.response for r in got] == ["A", "SECOND", "C", None, None, None, "G"]
    assert [r.attempts for r in got] == [2, 2, 2, 3, 3, 3, 1] and got[4].error == "busy"
    ok, failed = infer.split_failed(infer.batch_infer(df, "p", make, sleep=lambda s: None))
    assert (ok.count(), failed.count()) == (4, 3)
    with open(waits) as f:
        assert sorted(f.read().split()) == ["1.0", "1.0", "2.0"]
    short = infer.batch_infer(df, "p", lambda: lambda prompts: [], sleep=lambda s: None).first()
    assert "0 replies" in short.error


def test_batches_by_key_do_not_depend_on_partitions(spark):
    make = lambda: lambda prompts: [str(len(prompts)) for _ in prompts]
    df = spark.createDataFrame([(i // 4, i, "p") for i in range(40)], "b int, i int, p string")
    runs = [
        sorted((r.i, r.response) for r in infer.batch_infer(df.repartition(n), "p", make, batch_key="b").collect())
        for n in (1, 5)
    ]
    assert runs[0] == runs[1] and {r for _, r in runs[0]} == {"3", "1"}


def test_batches_keep_null_keys_and_large_ids(spark):
    make = lambda: lambda prompts: [str(len(prompts)) for _ in prompts]
    rows = [(None, 2**53 + 1, "p"), (None, None, "p"), (None, 3, None), (None, 4, "p"), (7, 2**62 + 1, "p")]
    got = infer.batch_infer(spark.createDataFrame(rows, "b int, i long, p string"), "p", make, batch_key="b").collect()
    assert {(r.b, r.i, r.p) for r in got} == set(rows)
    assert sorted(r.response for r in got) == ["1", "1", "3", "3", "3"]
    assert infer.batch_infer(spark.createDataFrame([], "p string"), "p", make).count() == 0


def test_rows_of_a_large_key_or_without_one_are_dealt_to_tasks(spark):
    make = lambda: lambda prompts: [str(len(prompts)) for _ in prompts]
    rows = [(None if i % 2 else 5, i, "p") for i in range(400)] + [(9, 1, "p")] * 2
    df = spark.createDataFrame(rows, "b int, i int, p string")
    runs = []
    for n in (1, 7):
        found = infer.batch_infer(df.repartition(n), "p", make, batch_key="b", task_rows=30)
        assert found.columns == ["b", "i", "p", "response", "error", "attempts"]
        runs.append(sorted(((r.b or -1, r.i, r.response) for r in found.collect())))
    assert runs[0] == runs[1] and len(runs[0]) == 402 and {r[2] for r in runs[0]} <= {"1", "2", "3"}
    dealt = infer._dealt(df, "b", 30).select("b", infer.PART).distinct()
    assert {r.b: r["count"] for r in dealt.groupBy("b").count().collect()} == {None: 7, 5: 7, 9: 1}


def test_refused_replies_are_asked_for_again(spark):
    def make():
        asked = []

        def model(prompts):
            asked.append(1)
            return ["[1]" if len(asked) > 1 and "bad" not in p else "sorry" for p in prompts]

        return model

    df = spark.createDataFrame([("good",)], "p string").coalesce(1)
    call = lambda rows: infer.batch_infer(
        rows, "p", make, batch_size=1, first_wait=0, sleep=lambda s: None, accept=lambda reply: reply.startswith("[")
    ).first()
    assert (call(df).response, call(df).attempts, call(df).error) == ("[1]", 2, None)
    failed = call(df.selectExpr("'bad' AS p"))
    assert (failed.response, failed.attempts) == (None, 3) and "asked for" in failed.error


def test_files(spark, tmp_path):
    folder = tmp_path / "logs"
    (folder / "in ner").mkdir(parents=True)
    (folder / "a.log").write_bytes(b"line\xff one\nTESTCASE: x FAILED\n")
    (folder / "a.txt").write_text("same stem")
    (folder / "b.TXT").write_text("   \n")
    (folder / "in ner" / "a.log").write_text("same name")
    (folder / "plus+100%.log").write_text("odd name")
    (folder / "c.csv").write_text("ignored")
    uploaded = files.uploaded_logs(spark, str(folder))
    pasted = files.pasted_logs(spark, [("a.log", "pasted"), ("d", "only pasted"), ("e", None)])
    chosen = files.choose_input(pasted, uploaded)
    got = {r.run_id: r.log_content for r in chosen.collect()}
    assert got == {
        "a.log": "line one\nTESTCASE: x FAILED\n", "a.txt": "same stem", "b.TXT": "   \n", "plus+100%.log": "odd name",
        "d": "only pasted", "e": "",
    }
    kept, rejected = files.split_blank(chosen)
    assert {r.run_id for r in rejected.collect()} == {"b.TXT", "e"} and kept.count() == 4
    assert files.read_whole_logs(spark, str(folder)).count() == 5
    nested = files.uploaded_logs(spark.newSession(), f"file:{folder}/in ner")
    assert [r.run_id for r in nested.collect()] == ["a.log"]
    every = spark.read.option("recursiveFileLookup", True).format("text").load(str(folder)).select(files.run_name(str(folder)))
    assert {r.run_id for r in every.collect()} == {"a.log", "a.txt", "b.TXT", "c.csv", "plus+100%.log", "in ner/a.log"}


def test_line_mode_reads_big_files_in_splits(spark, tmp_path):
    folder = tmp_path / "big"
    folder.mkdir()
    texts = [f"line {i}" for i in range(2000)]
    (folder / "run.log").write_text("\n".join(texts) + "\n")
    (folder / "tiny.log").write_text("one\ntwo\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        got = files.read_log_lines(spark, str(folder)).where("run_id = 'run.log'").orderBy("line_no").collect()
        assert [r.line for r in got] == texts and [r.line_no for r in got] == list(range(2000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_sme_file(spark, tmp_path):
    path = tmp_path / "sme.csv"
    path.write_text("template,severity,causality,summary,resolution\na <NUM>,WARN,Auth,s,r\n")
    rows, message = files.read_sme(spark, str(path))
    assert rows.first().resolution == "r" and message.startswith("Successfully")
    path.write_text("severity,Template,summary,causality,resolution,more\nWARN,a <NUM>,s,Auth,r,x\n")
    row = files.read_sme(spark, str(path))[0].first()
    assert (row.template, row.severity, row.causality, row.summary, row.resolution) == ("a <NUM>", "WARN", "Auth", "s", "r")
    path.write_text("template,severity\na,WARN\n")
    rows, message = files.read_sme(spark, str(path))
    assert rows.count() == 0 and message == "Error loading SME table: no column causality, summary, resolution"
    for missing in (None, "", str(tmp_path / "none.csv")):
        rows, message = files.read_sme(spark, missing)
        assert rows.count() == 0 and message == "No SME reference data provided."


def test_triage_twice_uses_what_the_first_run_stored(spark, tmp_path):
    store = str(tmp_path)
    make, dim = hashing_embedder(32), 32

    def once(rows):
        logs = spark.createDataFrame(rows, "run_id string, log_content string")
        done = triage_logs(
            logs, tables.open_collection(spark, store + "/v"), tables.open_table(spark, store + "/t", schemas.TIPS), make, dim
        )
        runs = {r.run_id: r for r in done.runs.collect()}
        texts = {r.run_id: r for r in done.texts.collect()}
        tables.put_tips(done.tips, store + "/t")
        tables.put_tickets(done.tickets, store + "/k")
        tables.append_vectors(done.outcomes, store + "/v")
        return runs, texts, done

    runs, texts, done = once([("f", FAILING), ("p", PASSING), ("blank", " \n")])
    assert set(runs) == {"f", "p"} and [r.run_id for r in done.rejected.collect()] == ["blank"]
    assert runs["f"].historical_context == "--- Short-Term Memory (Global Tips) ---"  # nothing known yet
    assert runs["p"].historical_context is None and runs["p"].summary_report
    assert "- login" in texts["f"].status_text and texts["f"].n_tickets == 1
    stored = tables.open_collection(spark, store + "/v")
    assert {(r.record_kind, r.severity) for r in stored.collect()} == {("outcome", "high"), ("outcome", "low")}
    runs, _, _ = once([("f2", FAILING), ("f", FAILING)])
    for run in ("f", "f2"):
        assert "Past Issue: " + FAILING.strip() in runs[run].historical_context
        assert "Tip for login: 3 error lines of " in runs[run].historical_context
        assert "History:" in runs[run].failure_report
    assert tables.open_collection(spark, store + "/v").count() == 3
    assert mem.latest_tips(tables.open_table(spark, store + "/t", schemas.TIPS)).count() == 2
    assert tables.open_table(spark, store + "/k", schemas.TICKETS).count() == 3


def test_run_history(spark, tmp_path):
    path = str(tmp_path / "h")
    rows = [("th", "r1", DAY, "failed", "a"), ("th", "r2", DAY + dt.timedelta(1), "passed", "b"), ("x", "r3", DAY, "passed", "c")]
    tables.put_run_history(spark.createDataFrame(rows, schemas.RUN_HISTORY), path)
    latest = mem.latest_runs(tables.open_table(spark, path, schemas.RUN_HISTORY))
    assert {(r.thread_id, r.run_id) for r in latest.collect()} == {("th", "r2"), ("x", "r3")}


def test_reports_of_the_same_log_do_not_grow(spark, tmp_path):
    store = str(tmp_path)
    make, dim = hashing_embedder(16), 16
    log = "".join(f"TESTCASE: t{i} FAILED\nError: code {i}\n" for i in range(4))
    sizes = []
    for i in range(4):
        logs = spark.createDataFrame([(f"r{i}", log)], "run_id string, log_content string")
        stamp = F.lit(f"2024-06-0{i + 1}").cast("timestamp_ntz")
        done = triage_logs(
            logs, tables.open_collection(spark, store + "/v"), tables.open_table(spark, store + "/t", schemas.TIPS),
            make, dim, updated_at=stamp,
        )
        report = done.runs.first().failure_report
        tips = done.tips.collect()
        assert done.error_details.count() == 4
        tables.put_tips(done.tips, store + "/t")
        tables.append_vectors(done.outcomes, store + "/v")
        sizes.append((len(report), sum(len(t.analysis) for t in tips)))
    assert sizes[2][1] == sizes[3][1] == sizes[0][1] and sizes[3][0] == sizes[2][0]


def test_replies_leave_a_task_in_large_batches(spark, monkeypatch):
    import pyarrow as pa

    kept = []
    rows = spark.range(10).selectExpr("id", "CAST(id AS STRING) AS prompt")
    monkeypatch.setattr(type(rows), "mapInArrow", lambda self, run, schema: kept.append(run))
    infer.batch_infer(rows, "prompt", lambda: lambda prompts: [p * 2 for p in prompts], first_wait=0.0)
    batch = pa.table({"id": list(range(100)), "prompt": [str(i) for i in range(100)]}).to_batches()[0]
    made = list(kept[0](iter([batch, batch])))
    assert len(made) <= 3 and [x for b in made for x in b.column(2).to_pylist()] == [str(i) * 2 for i in range(100)] * 2
